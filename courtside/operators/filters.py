"""Lookups, gates and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import any_of, is_unset, names, ntz

# The shapes an e-mail address, a clock time and a date must have.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
TIME_PATTERN = r"^([0-1]\d|2[0-3]):([0-5]\d):([0-5]\d)$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
WEEK_DAYS = ["saturday", "sunday", "monday", "tuesday", "wednesday", "thursday", "friday"]


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """rows of ``table`` for each key row, joined on the shared columns."""
    return table.join(keys, [c for c in keys.columns if c in table.columns])


def authorized(requests: DataFrame, owners: DataFrame, on: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """split requests into those whose (user, object) pair exists in ``owners`` and the rest."""
    keys = names(on)
    held = owners.select(*keys).distinct()
    return requests.join(held, keys, "left_semi"), requests.join(held, keys, "left_anti")


def role_filter(users: DataFrame, roles: Sequence[str], facilitators: DataFrame | None = None) -> DataFrame:
    """users of the given types; facilitators also need their own row."""
    kept = users.filter(F.col("type").isin(*roles))
    if facilitators is not None and "facilitator" in roles:
        known = facilitators.select("user_id").distinct().withColumn("_known", F.lit(True))
        kept = kept.join(known, "user_id", "left").filter((F.col("type") != "facilitator") | F.col("_known")).drop("_known")
    return kept


def redact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop private columns."""
    return df.drop(*cols)


def _like_literal(needle: str) -> str:
    return "%" + needle.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"


def name_contains(df: DataFrame, cols: Sequence[str], needle: str) -> DataFrame:
    """case-insensitive containment in any of ``cols``; wildcards in the needle are literal."""
    return df.filter(any_of([F.col(c).ilike(_like_literal(needle)) for c in cols]))


def has_prefix(df: DataFrame, col: str, prefix: str, out: str = "is_img") -> DataFrame:
    """1 when text starts with ``prefix`` (image messages), else 0."""
    return df.withColumn(out, F.coalesce(F.col(col).startswith(prefix).cast("int"), F.lit(0)))


def between(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """inclusive range; an absent upper bound is the table's maximum plus one."""
    top = F.lit(hi) if hi is not None else df.agg(F.max(col) + 1).scalar()
    kept = df.filter(F.col(col) <= top)
    return kept.filter(F.col(col) >= lo) if lo is not None else kept


def enum_filter(df: DataFrame, **values) -> DataFrame:
    """equality on each named column."""
    for name, value in values.items():
        df = df.filter(F.col(name) == value)
    return df


def regex_valid(df: DataFrame, col: str, pattern: str, out: str = "valid") -> DataFrame:
    """whether text has the given shape."""
    return df.withColumn(out, F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(DATE_PATTERN) & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def on_date(df: DataFrame, ts: str, day: str) -> DataFrame:
    """rows of one calendar day, as a half-open range that still reaches the scan."""
    start = ntz(f"{day} 00:00:00")
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))


def contains_all(df: DataFrame, have: str, want: Sequence[str] | Column) -> DataFrame:
    """rows whose array ``have`` holds every wanted value."""
    if isinstance(want, Column):
        wanted = want
    elif want:
        wanted = F.array(*[F.lit(w) for w in want])
    else:
        return df
    return df.filter(F.size(F.array_except(wanted, F.col(have))) == 0)


def session_phase(df: DataFrame, phase: str, as_of: str) -> DataFrame:
    """upcoming, ongoing or completed sessions at ``as_of``."""
    now, start, end = ntz(as_of), F.col("start_time"), F.col("end_time")
    rules = {
        "upcoming": (start > now) & (end > now),
        "ongoing": (start <= now) & (end > now),
        "completed": (start < now) & (end <= now),
    }
    return df.filter(rules[phase])


def session_status(as_of: str) -> Column:
    """status label; unlike F12 a session is still ongoing at its very end, and no times mean completed."""
    now, start, end = ntz(as_of), F.col("start_time"), F.col("end_time")
    return F.when(start > now, "upcoming").when((start <= now) & (end >= now), "ongoing").otherwise("completed")


def default_unless_set(df: DataFrame, col: str, default) -> DataFrame:
    """NULL, empty and zero become ``default``."""
    return df.withColumn(col, F.when(is_unset(col), F.lit(default)).otherwise(F.col(col)))
