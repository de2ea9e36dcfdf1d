"""Row validation, integrity audit and cascading deletes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import any_of, flag
from courtside.functions.store import written
from courtside.functions.times import seconds_of
from courtside.operators.filters import TIME_PATTERN, WEEK_DAYS


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows passing all rules, and the others with the array ``failed`` of rule names."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("failed", failed)
    return marked.filter(F.size("failed") == 0).drop("failed"), marked.filter(F.size("failed") > 0)


def required(*cols: str) -> dict[str, Column]:
    from courtside.functions.common import is_unset

    return {f"missing_{c}": ~is_unset(c) for c in cols}


def allowed(col: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"invalid_{col}": F.col(col).isin(*values)}


def date_order(start: str = "start_date", end: str = "end_date") -> dict[str, Column]:
    """Start present and strictly before an end that may be open."""
    return {f"missing_{start}": F.col(start).isNotNull(), "date_order": F.col(end).isNull() | (F.col(start) < F.col(end))}


def hours_rules(strict_structure: bool = True) -> dict[str, Column]:
    """Weekly-hours rows: weekday, clock times, start before end, flag; open days need times, closed days none."""
    start, end = F.col("start_time"), F.col("end_time")
    shape = lambda c: c.isNull() | c.rlike(TIME_PATTERN)
    rules = {
        "week_day": F.col("week_day").isin(*WEEK_DAYS),
        "time_format": shape(start) & shape(end),
        "time_order": start.isNull() | end.isNull() | (seconds_of(start) < seconds_of(end)),
        "available": F.col("available").isin(0, 1),
    }
    if strict_structure:
        timed, untimed = start.isNotNull() & end.isNotNull(), start.isNull() & end.isNull()
        rules["structure"] = ~((untimed & (F.col("available") == 1)) | (timed & (F.col("available") == 0)))
    return rules


# Fixed values: (child table, column, parent table, parent key, deletes cascade) of the schema.
FOREIGN_KEYS = [
    ("amenities", "facility_id", "facilities", "facility_id", True),
    ("athletes", "user_id", "users", "user_id", True),
    ("books", "facility_id", "facilities", "facility_id", True),
    ("books", "trainer_id", "trainers", "trainer_id", True),
    ("books", "user_id", "users", "user_id", True),
    ("book_facilities", "facility_id", "facilities", "facility_id", True),
    ("book_facilities", "user_id", "users", "user_id", True),
    ("certificates", "trainer_id", "trainers", "trainer_id", True),
    ("chats", "friend_user_id", "users", "user_id", True),
    ("chats", "user_id", "users", "user_id", True),
    ("children", "parent_id", "parents", "parent_id", True),
    ("comments", "post_id", "posts", "post_id", True),
    ("comments", "user_id", "users", "user_id", True),
    ("comment_likes", "comment_id", "comments", "comment_id", True),
    ("comment_likes", "user_id", "users", "user_id", True),
    ("educations", "trainer_id", "trainers", "trainer_id", True),
    ("experiences", "trainer_id", "trainers", "trainer_id", True),
    ("facilitators", "user_id", "users", "user_id", True),
    ("facilitator_employees", "facilitator_id", "facilitators", "facilitator_id", True),
    ("facilitator_employees", "trainer_id", "trainers", "trainer_id", True),
    ("facilities", "facilitator_id", "facilitators", "facilitator_id", True),
    ("facility_availability_hours", "facility_id", "facilities", "facility_id", True),
    ("facility_employees", "facility_id", "facilities", "facility_id", True),
    ("facility_employees", "trainer_id", "trainers", "trainer_id", True),
    ("facility_img", "facility_id", "facilities", "facility_id", True),
    ("facility_sessions", "facility_id", "facilities", "facility_id", True),
    ("facility_sessions", "user_id", "users", "user_id", True),
    ("favorite_facilitator", "facilitator_id", "facilitators", "facilitator_id", True),
    ("favorite_facilitator", "user_id", "users", "user_id", True),
    ("favorite_facility", "facility_id", "facilities", "facility_id", True),
    ("favorite_facility", "user_id", "users", "user_id", True),
    ("favorite_trainer", "trainer_id", "trainers", "trainer_id", True),
    ("favorite_trainer", "user_id", "users", "user_id", True),
    ("follows", "followed_user_id", "users", "user_id", True),
    ("follows", "follower_user_id", "users", "user_id", True),
    ("likes", "post_id", "posts", "post_id", True),
    ("likes", "user_id", "users", "user_id", True),
    ("messages", "chat_id", "chats", "chat_id", True),
    ("notifications", "user_id", "users", "user_id", True),
    ("not_notified_users", "notification_id", "notifications", "notification_id", True),
    ("not_notified_users", "user_id", "users", "user_id", True),
    ("parents", "user_id", "users", "user_id", True),
    ("payments", "book_id", "books", "book_id", False),
    ("payments_facility", "book_id", "book_facilities", "book_facility_id", False),
    ("posts", "user_id", "users", "user_id", True),
    ("post_img", "post_id", "posts", "post_id", True),
    ("review_facilitators", "facilitator_id", "facilitators", "facilitator_id", True),
    ("review_facilitators", "user_id", "users", "user_id", True),
    ("review_facilitator_img", "review_facilitator_id", "review_facilitators", "review_facilitator_id", True),
    ("review_facility", "facility_id", "facilities", "facility_id", True),
    ("review_facility", "user_id", "users", "user_id", True),
    ("review_facility_img", "review_facility_id", "review_facility", "review_facility_id", True),
    ("review_trainer", "trainer_id", "trainers", "trainer_id", True),
    ("review_trainer", "user_id", "users", "user_id", True),
    ("review_trainer_img", "review_trainer_id", "review_trainer", "review_trainer_id", True),
    ("token_management", "user_id", "users", "user_id", True),
    ("trainers", "user_id", "users", "user_id", True),
    ("trainer_availability_hours", "trainer_id", "trainers", "trainer_id", True),
    ("trainer_sessions", "facility_sessions_id", "facility_sessions", "facility_sessions_id", True),
    ("trainer_sessions", "trainer_id", "trainers", "trainer_id", True),
    ("unseen_messages", "message_id", "messages", "message_id", True),
    ("unseen_messages", "user_id", "users", "user_id", True),
    ("user_unseen_posts", "post_id", "posts", "post_id", True),
    ("user_unseen_posts", "user_id", "users", "user_id", True),
]
UNIQUE_KEYS = [("users", "user_id"), ("users", "email"), ("users", "socket_id"), ("users", "google_id"), ("trainers", "trainer_id"), ("facilities", "facility_id"),
               ("posts", "post_id"), ("chats", "chat_id"), ("messages", "message_id"), ("notifications", "notification_id"), ("comments", "comment_id"), ("payments", "book_id")]


def _parents_first(tables: Sequence[str], root: str) -> list[str]:
    order, left = [], set(tables)
    while left:
        ready = sorted((t for t in left if not any(c == t and p in left and p != t for c, _, p, _, _ in FOREIGN_KEYS)), key=lambda t: (t != root, t))
        if not ready:
            raise ValueError(f"cyclic foreign keys among {sorted(left)}")
        order += ready
        left -= set(ready)
    return order


def cascade_delete(tables: dict[str, DataFrame], root: str, keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables after deleting ``keys`` from ``root`` and everything that depends on it, and the keys whose deletion is refused.

    A foreign key that doesn't cascade refuses the deletion of what it refers to: a root key is kept, with all that depends on it, if a
    row that would go with it is still referred to in that way. Refusals are found from the leaves up, as one set of held keys for each
    table; then the doomed keys from the root down, one set for each table as well. A row lost through several parents is lost once, and a row
    that depends on a refused key goes if it also depends on an accepted one. Keys that the root does not have are ignored.
    """
    order = _parents_first(list(tables), root)
    used = [k for k in FOREIGN_KEYS if k[0] in tables and k[2] in tables]
    key_of = {p: key for _, _, p, key, _ in used}
    below, grown = {root}, True  # tables that a deletion can reach
    while grown:
        more = {c for c, _, p, _, cascades in used if p in below and cascades} - below
        below, grown = below | more, bool(more)

    held: dict[str, DataFrame] = {}
    for t in reversed(order):
        sets = []
        for child, col, parent, _, cascades in used:
            if parent == t and t in below:
                if not cascades:
                    sets.append(tables[child].select(F.col(col).alias("key")))
                elif child in held:
                    rows = tables[child].join(held[child].withColumnRenamed("key", key_of[child]), key_of[child], "left_semi")
                    sets.append(rows.select(F.col(col).alias("key")))
        if sets:
            held[t] = written(reduce(lambda x, y: x.union(y), sets).where("key IS NOT NULL").distinct(), "held")

    asked = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    refused = asked.join(held[root], "key", "left_semi") if root in held else asked.limit(0)
    accepted = asked.join(held[root], "key", "left_anti") if root in held else asked
    doomed, out = {root: written(accepted, "doomed")}, dict(tables)
    out[root] = tables[root].join(doomed[root].withColumnRenamed("key", keys.columns[0]), keys.columns[0], "left_anti")
    for t in order:
        if t == root or t not in below:
            continue
        marked, hits = tables[t], []
        for i, (child, col, parent, _, cascades) in enumerate(used):
            if child == t and parent in doomed and cascades:
                marked = flag(marked, doomed[parent].withColumnRenamed("key", col), [col], f"_doomed{i}")
                hits.append(F.col(f"_doomed{i}") == 1)
        if hits:
            out[t] = marked.where(~any_of(hits)).select(*tables[t].columns)
            if any(p == t and cascades for _, _, p, _, cascades in used):
                doomed[t] = written(marked.where(any_of(hits)).select(F.col(key_of[t]).alias("key")).distinct(), "doomed")
    return {t: out[t].select(*tables[t].columns) for t in tables}, refused.withColumnRenamed("key", keys.columns[0])


def audit_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of unique and foreign keys as rows (table, rule, column, value, n). Every table is read once.

    A row of a table becomes a row for each of its keys: of the values that have to be unique, of those that refer to a parent, and of those
    that children refer to. Equal ones are counted, first within each task; then a value's references and its parent meet. A value that most
    rows have is one row of each task by then.
    """
    parents = {(p, key) for c, _, p, key, _ in FOREIGN_KEYS if c in tables and p in tables}
    rows = []
    for table, df in tables.items():
        roles = [("unique", f"{table}.{col}", table, col, col) for t, col in UNIQUE_KEYS if t == table]
        roles += [("foreign_key", f"{p}.{key}", table, col, col) for c, col, p, key, _ in FOREIGN_KEYS if c == table and p in tables]
        roles += [("parent", f"{p}.{key}", table, key, key) for p, key in sorted(parents) if p == table]
        roles = [r for r in roles if r[4] in df.columns]
        if roles:
            entry = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r[:4], ("rule", "domain", "table_name", "column_name"), strict=True)], F.col(r[4]).cast("string").alias("value")) for r in roles]
            rows.append(df.select(F.explode(F.array(*entry)).alias("e")).select("e.*"))
    found = reduce(lambda a, b: a.unionByName(b), rows).where("value IS NOT NULL")
    counts = found.groupBy("rule", "domain", "table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    columns = ["table_name", "rule", "column_name", "value", "n"]
    # at most one row for each key of the schema meets at a value
    met = counts.groupBy("domain", "value").agg(F.max(F.col("rule") == "parent").alias("_known"), F.collect_list(F.struct(*columns)).alias("_all"))
    rows = met.select("_known", F.explode("_all").alias("x")).select("_known", "x.*")
    return rows.where("(rule = 'unique' AND n > 1) OR (rule = 'foreign_key' AND NOT _known)").select(columns)


def missing_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per NOT NULL column, in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in cols])).alias("x")).select("x.*").filter("n > 0")
