"""Quality rules: text statistics and a learned decision list, all as Spark expressions.

Statistics are computed inside the row, without a shuffle: repeated word windows are found by sorting the hashes of a text's own windows.

The decision list is learned by sequential covering. Values are cut at quantiles; the labelled rows become counts per cell of bins, and each
step of growing asks Spark for the labels on both sides of every cut among the rows that the rule still covers. A rule takes the test with
the highest information gain until it covers no good document, is pruned back to the prefix that does best on the rows held out for
pruning, and is kept if it is precise there; covered rows leave, and the next rule is grown on the rest.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.store import new_path

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
CUTS = 24  # quantiles tried for each statistic
RULES = 8
TESTS = 3  # conditions of a rule
PRECISION = 0.9  # of a rule on the rows held out for pruning

#: Statistics that rules may test, by name; each is a ratio or a count that grows with the text.
TESTED: dict[str, Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbol_share": lambda: _share("n_symbols", "word_chars"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "capital_share": lambda: _share("n_capitals", "word_chars"),
    "distinct_share": lambda: _share("n_distinct", "n_words"),
}


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words covered by windows that occur twice or more in the array ``words``."""
    hashed = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)]).alias("h"), i.alias("i")),
    )

    def begins(s: Column) -> Column:
        same = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

    def covered(b: Column) -> Column:
        return F.aggregate(F.transform(b, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(b, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    return let(F.array_sort(hashed), lambda s: let(begins(s), covered))


def statistics(text: Column) -> Column:
    """A struct of counts of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
        word_chars = F.length(F.translate(t, SPACES, ""))
        return let(words_of(t), lambda w: let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"), repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        )))

    return let(text, of)


@dataclass(frozen=True)
class Test:
    """``name`` above (or else at most at) ``cut``."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = TESTED[self.name]()
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Test, ...]


def matches(rule: Rule) -> Column:
    return reduce(operator.and_, [t.column() for t in rule])


def verdict(rules: list[Rule]) -> Column:
    """False for a row that some rule covers, else true; ``rule`` order decides which one it is (see ``rule_number``)."""
    return rule_number(rules).isNull()


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(matches(rules[i]), F.lit(i)).otherwise(out)
    return out


def learn_rules(stats: DataFrame, label: str, id_col: str = "doc_id") -> list[Rule]:
    """Rules that cover rows whose ``label`` is 0. ``stats`` has the columns of ``statistics`` and the label of every labelled row.

    A third of the rows (by a hash of ``id_col``) prunes, the others grow. Without rows of both labels there are no rules.
    """
    names = list(TESTED)
    values = stats.select(F.col(label).alias("label"), (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("prunes"), *[TESTED[n]().alias(n) for n in names])
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    # Quantiles of the bad rows as well: they may be few.
    found = values.groupBy("label").agg(*[F.percentile_approx(n, quantiles, 2000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return []
    cuts = {n: sorted({c for row in found for c in row[n]}) for n in names}
    bins = [reduce(operator.add, [(F.col(n) > c).cast("int") for c in cuts[n]]).alias(n) for n in names]
    path = new_path(stats.sparkSession, "rule-cells")
    values.select("label", "prunes", *bins).groupBy("label", "prunes", *names).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    cells = stats.sparkSession.read.parquet(path)

    def covers(rule: Rule) -> Column:
        places = [(F.col(t.name) > cuts[t.name].index(t.cut)) if t.above else (F.col(t.name) <= cuts[t.name].index(t.cut)) for t in rule]
        return reduce(operator.and_, places, F.lit(True))

    rules: list[Rule] = []
    while len(rules) < RULES:
        left = cells.where(~reduce(operator.or_, [covers(r) for r in rules], F.lit(False)))
        rule = _grow(left.where(~F.col("prunes")), covers, cuts, names)
        rule = _prune(left, covers, rule) if rule else ()
        if not rule:
            break
        rules.append(rule)
    return _tighten(stats, label, rules) if rules else rules


def _tighten(stats: DataFrame, label: str, rules: list[Rule]) -> list[Rule]:
    """Every cut moved half way to the nearest bad value that its test covers: no bad row is lost, good rows near the cut are spared."""
    tests = sorted({t for r in rules for t in r}, key=lambda t: (t.name, t.above, t.cut))
    ends = [(F.min if t.above else F.max)(F.when(t.column(), TESTED[t.name]())) for t in tests]
    row = stats.where(F.col(label) == 0).agg(*[c.alias(str(i)) for i, c in enumerate(ends)]).first()
    moved = {t: Test(t.name, t.above, (t.cut + end) / 2) for t, end in zip(tests, row, strict=True) if end is not None}
    return [tuple(moved.get(t, t) for t in r) for r in rules]


def _grow(cells: DataFrame, covers: Callable[[Rule], Column], cuts: dict[str, list[float]], names: list[str]) -> Rule:
    rule: Rule = ()
    for _ in range(TESTS):
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names])).alias("e")
        rows = cells.where(covers(rule)).select(each, "label", "n").groupBy("e.name", "e.bin").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, 0).otherwise(F.col("n"))).alias("good")).collect()
        bad, good = (sum(r[k] for r in rows if r["name"] == names[0]) for k in ("bad", "good"))
        if not bad or not good:
            break
        best = (0.0, None)
        for n in names:
            own = {r["bin"]: (r["bad"], r["good"]) for r in rows if r["name"] == n}
            p = q = 0
            for i, cut in enumerate(cuts[n]):
                p, q = p + own.get(i, (0, 0))[0], q + own.get(i, (0, 0))[1]
                for above, a, b in ((False, p, q), (True, bad - p, good - q)):
                    if a:
                        gain = a * (math.log2(a / (a + b)) - math.log2(bad / (bad + good)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Test(n, above, cut))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(cells: DataFrame, covers: Callable[[Rule], Column], rule: Rule) -> Rule:
    """The prefix of the rule with the highest precision on the pruning rows, if that is high enough there and on the others."""
    columns = []
    for k in range(1, len(rule) + 1):
        for part in (True, False):
            for bad in (True, False):
                columns.append(F.coalesce(F.sum(F.when(covers(rule[:k]) & (F.col("prunes") == part) & ((F.col("label") == 0) == bad), F.col("n"))), F.lit(0)).alias(f"c{k}_{part}_{bad}"))
    row = cells.agg(*columns).first()
    best: tuple[float, Rule] = (0.0, ())
    for k in range(1, len(rule) + 1):
        rates = [(row[f"c{k}_{part}_True"] + 1) / (row[f"c{k}_{part}_True"] + row[f"c{k}_{part}_False"] + 1) for part in (True, False)]
        if row[f"c{k}_True_True"] and min(rates) >= PRECISION and rates[0] > best[0] + 1e-9:
            best = (rates[0], rule[:k])
    return best[1]


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Per row: ``id_col``, the counts of ``statistics``, ``base_failed``, ``rule`` (number of the learned rule that covers it) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of them in repeated windows. ``kept`` is false for
    base_failed rows and rows that a rule covers. ``labels`` has ``id_col`` and ``label`` once per id. A null or empty text has no words and
    fails; rows with equal ids each get a row, a null id has no label; other columns are not read. Without labels no rule is learned.
    """
    path = new_path(docs.sparkSession, "statistics")
    docs.select(F.col(id_col).alias(id_col), statistics(F.col(text_col)).alias("s")).select(id_col, "s.*").write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    rules = learn_rules(stats.join(labels.select(id_col, label), id_col), label, id_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
