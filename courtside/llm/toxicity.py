"""Toxicity by class-conditional Kneser-Ney models over word pairs.

Both classes have an interpolated Kneser-Ney model: discounted counts of a pair (documents that have it), then of the contexts that a word
follows, then of the contexts of all words that begin like it (four bytes), then the shared backoff: contexts counted over both classes
together. A ``Gate`` says which expressions have a class-specific part: by default those seen five times or more, more often in one class
than chance explains (a G-test), and by a factor of six; any other one, and so every rare one, takes the probability of the level below,
in the end the shared one, and weighs the same for either class. ``PLAIN`` lets all expressions have their parts, which is the plain
interpolated model. (With a gate the terms of a class need not sum to one: the score is a likelihood ratio with a selected vocabulary.)

Counts are Spark aggregations over all labelled documents but the bounded sample that the curve is fitted on. The log-likelihood ratio of a text is a sum of terms that depend on one beginning,
word or pair; these terms are computed in Spark and sent to the scan of the documents in blocks of at most ``BLOCK_TERMS``. The ratio per word
becomes a probability by a logistic curve fitted on labelled documents that were not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.common import salted_join
from courtside.functions.store import new_path
from courtside.llm.blocks import BASE, find_words, hash_words, mixed, text_blocks, text_bytes
from courtside.llm.labelled import labelled, labelled_sample



@dataclass(frozen=True)
class Gate:
    """What an expression needs for a class-specific part. ``rare``: uses in both classes together, ``chance``: the G statistic (15: about one
    expression in 10,000 exceeds it by chance), ``factor``: how much likelier it has to be in one class than in the other."""

    rare: int = 5
    chance: float = 15.0
    factor: float = 6.0


GATE = Gate()
PLAIN = Gate(rare=1, chance=0.0, factor=1.0)
BLOCK_TERMS = 4_000_000  # terms in one pass over the documents (16 bytes each)
CALIBRATED = 2000  # documents of either label that the logistic curve is fitted on
START = np.uint64(1)  # the context of a first word

#: A-Z become a-z; other ASCII characters than letters and digits part words.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)

WORD, CONTEXT, PAIR, SEEN, STEM = range(5)
STEM_BYTES = 4


def expressions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words and of the words before them, and for every text (and the end) the number of its first word.

    The upper half of a number has the first bytes of the word, the lower half a hash.
    """
    data, offsets = text_bytes(column)
    data = FOLDED[data]
    starts, ends, first = find_words(data, offsets)
    words = hash_words(data, starts, ends) >> np.uint64(32)
    padded = np.concatenate([data, np.zeros(STEM_BYTES, np.uint8)])
    for k in range(STEM_BYTES):
        words |= np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    before = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    before[first[:-1][np.diff(first) > 0]] = START
    return words, before, first


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(before * BASE + words)


def count_expressions(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, gate: Gate = GATE) -> DataFrame:
    """``kind``, ``h``, ``w`` and counts over the labelled documents of either class: ``toxic`` and ``plain``, ``toxic_kinds``, ``plain_kinds``.

    PAIR: documents that have the pair, for pairs that are not rare. WORD: contexts that w follows. CONTEXT: pairs that begin with h, and
    how many different ones. SEEN: pairs that w (1, 2) documents have.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "text"):
            words, before, first = expressions(part.column("text"))
            document = np.repeat(np.arange(part.num_rows), np.diff(first))
            key = pair_key(before, words)
            _, once = np.unique(mixed(key + document.astype(np.uint64)), return_index=True)
            toxic = part.column("label").to_numpy()[document[once]] == 1
            _, at, inverse = np.unique(key[once], return_index=True, return_inverse=True)
            at = once[at]
            t, o = (np.bincount(inverse[x], minlength=len(at)) for x in (toxic, ~toxic))
            yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(t, pa.int64()), pa.array(o, pa.int64())], ["h", "w", "toxic", "plain"])

    known = labelled(docs, labels, label, id_col, text_col).select("text", "label")
    counted = known.mapInArrow(pairs, "h bigint, w bigint, toxic bigint, plain bigint").groupBy("h", "w").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    h, w, t, o, none = F.col("h"), F.col("w"), F.col("toxic"), F.col("plain"), F.lit(0).cast("bigint")

    def row(kind: int, h: Column, w: Column, *numbers: Column) -> Column:
        names = ("toxic", "plain", "toxic_kinds", "plain_kinds")
        return F.struct(F.lit(kind).alias("kind"), h.alias("h"), w.alias("w"), *[n.cast("bigint").alias(c) for c, n in zip(names, numbers, strict=True)])

    each = F.array(
        row(WORD, none, w, t > 0, o > 0, none, none), row(CONTEXT, h, none, t, o, t > 0, o > 0), F.when(t + o >= gate.rare, row(PAIR, h, w, t, o, none, none)),
        *[F.when((t == k) | (o == k), row(SEEN, none, F.lit(k).cast("bigint"), t == k, o == k, none, none)) for k in (1, 2)],
    )
    rows = counted.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select("r.*")
    return rows.groupBy("kind", "h", "w").agg(*[F.sum(c).alias(c) for c in ("toxic", "plain", "toxic_kinds", "plain_kinds")])


def model_terms(counts: DataFrame, gate: Gate = GATE) -> DataFrame | None:
    """``kind``, ``h``, ``w``, ``value``: parts of log P(w | h, toxic) - log P(w | h, plain). None unless both classes have words.

    A text's ratio is the sum of the STEM and WORD terms of its words and the PAIR terms of its pairs.
    """
    sides = ("toxic", "plain")
    words = counts.where(F.col("kind") == WORD).select("w", *sides)
    row = words.agg(
        F.count(F.lit(1)).alias("words"), *[F.sum(c).alias(c) for c in sides], *[F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds") for c in sides],
        *[F.sum((F.col(c) == k).cast("int")).alias(f"{c}{k}") for c in sides for k in (1, 2)],
    ).first()
    if not row["toxic"] or not row["plain"]:
        return None
    seen = {r["w"]: r for r in counts.where(F.col("kind") == SEEN).collect()}
    total = {c: row[c] for c in sides}

    def discount(once: float, twice: float) -> float:
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    low = {c: discount(row[f"{c}1"], row[f"{c}2"]) for c in sides}
    high = {c: discount(*[seen[k][c] if k in seen else 0 for k in (1, 2)]) for c in sides}
    everything = sum(total.values())
    stem, specific = F.shiftrightunsigned("w", 32).alias("stem"), differs(total["toxic"], total["plain"], gate)
    # How much likelier than in the shared model a specific beginning is in a class. Others have no row: few are left to be joined.
    lift = {c: (F.greatest(F.col(c) - low[c], F.lit(0.0)) / total[c] + low[c] * row[f"{c}_kinds"] / total[c] * (F.col("toxic") + F.col("plain")) / everything) / ((F.col("toxic") + F.col("plain")) / everything) for c in sides}
    stems = words.groupBy(stem).agg(*[F.sum(c).alias(c) for c in sides]).where(specific).select("stem", *[lift[c].alias(f"lift_{c}") for c in sides])
    shared = (F.col("toxic") + F.col("plain") + 0.5) / (everything + 0.5 * (row["words"] + 1))
    below = {c: shared * F.col(f"lift_{c}") for c in sides}
    at_word = {c: F.greatest(F.col(c) - low[c], F.lit(0.0)) / total[c] + low[c] * row[f"{c}_kinds"] / total[c] * below[c] for c in sides}
    words = salted_join(words.withColumn("stem", stem), stems, "stem", ["w"], how="left").fillna(1.0, [f"lift_{c}" for c in sides]).select("w", "lift_toxic", "lift_plain", *[F.when(specific, at_word[c]).otherwise(below[c]).alias(f"p_{c}") for c in sides])

    uses = counts.where(F.col("kind") == CONTEXT).agg(*[F.sum(c).alias(c) for c in sides]).first()
    pairs = counts.where((F.col("kind") == PAIR) & differs(uses["toxic"], uses["plain"], gate)).select("h", "w", *sides)
    contexts = counts.where(F.col("kind") == CONTEXT).select("h", *[F.col(x).alias(f"h_{x}") for c in sides for x in (c, f"{c}_kinds")])
    at_pair = {
        c: F.when(F.col(f"h_{c}") > 0, (F.greatest(F.col(c) - high[c], F.lit(0.0)) + high[c] * F.col(f"h_{c}_kinds") * F.col(f"p_{c}")) / F.col(f"h_{c}")).otherwise(F.col(f"p_{c}"))
        for c in sides
    }

    def log_ratio(p: dict[str, Column]) -> Column:
        return F.log(p["toxic"]) - F.log(p["plain"])

    stem_term, at_level = (log_ratio({c: F.col(f"{x}_{c}") for c in sides}) for x in ("lift", "p"))
    none = F.lit(0).cast("bigint")
    terms = (
        stems.select(F.lit(STEM).alias("kind"), none.alias("h"), F.col("stem").alias("w"), stem_term.alias("value"))
        .union(words.select(F.lit(WORD), none, "w", at_level - stem_term))
        .union(pairs.join(contexts, "h").join(words, "w").select(F.lit(PAIR), "h", "w", log_ratio(at_pair) - at_level))
    )
    return terms.where(F.abs("value") > 1e-6)


def differs(toxic: float, plain: float, gate: Gate = GATE) -> Column:
    """Whether the columns ``toxic`` and ``plain`` of an expression differ, given the totals of the classes, as far as the gate asks for."""
    n, share = F.col("toxic") + F.col("plain"), toxic / (toxic + plain)
    sides = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * q))).otherwise(0.0) for c, q in (("toxic", share), ("plain", 1 - share))]
    rate = (F.col("toxic") + 0.5) / toxic / ((F.col("plain") + 0.5) / plain)
    return (n >= gate.rare) & (2 * (sides[0] + sides[1]) >= gate.chance - 1e-9) & ((rate >= gate.factor) | (rate <= 1 / gate.factor))


class Terms:
    """One block of terms, by sorted keys."""

    def __init__(self, table: pa.Table):
        kind, h, w, value = (table.column(c).to_numpy() for c in ("kind", "h", "w", "value"))
        self.tables = []
        for k, key in ((STEM, w.view(np.uint64)), (WORD, w.view(np.uint64)), (PAIR, pair_key(h.view(np.uint64), w.view(np.uint64)))):
            some = np.flatnonzero(kind == k)
            some = some[np.argsort(key[some])]
            self.tables.append((key[some], value[some].astype(np.float32)))

    def ratio(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the terms in every text, and its words."""
        words, before, first = expressions(column)
        total = np.zeros(len(words))
        for (keys, values), wanted in zip(self.tables, (words >> np.uint64(64 - 8 * STEM_BYTES), words, pair_key(before, words)), strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                total += np.where(keys[at] == wanted, values[at], 0)
        running = np.concatenate([[0], np.cumsum(total)])[first]
        return np.diff(running), np.diff(first)


def ratios(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with a ``text`` column; that column gives way to ``ratio``, the log-likelihood ratio per word (0 without words)."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    keep = [f for f in rows.schema if f.name != "text"]
    held = T.StructType([*rows.schema.fields, T.StructField("sum", T.DoubleType())])
    done = T.StructType([*keep, T.StructField("ratio", T.DoubleType())])
    rows = rows.withColumn("sum", F.lit(0.0))
    for b in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("kind", "h", "w"), F.lit(blocks)) == b) if blocks > 1 else terms
        sent, last = spark.sparkContext.broadcast(Terms(some.toArrow())), b == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for part in text_blocks(batches, "text"):
                found, n = sent.value.ratio(part.column("text"))
                found = pa.array((found + part.column("sum").to_numpy()) / (np.maximum(n, 1) if last else 1))
                names = [f.name for f in keep] if last else [f.name for f in held][:-1]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], found], [*names, "ratio" if last else "sum"])

        rows = rows.mapInArrow(run, done if last else held)
        if not last:
            path = new_path(spark, "ratios")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
    return rows


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, each label weighing by its share."""
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    scale = max(float(np.abs(x).max()), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * beta * [1, 0]
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(max(beta[0], 0) / scale), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", gate: Gate = GATE) -> DataFrame:
    """Per row: ``id_col``, ``ratio`` (log-likelihood ratio per word) and ``score``, the probability of label 1.

    ``labels`` has ``id_col`` and ``label`` once per id; of a fifth (by a hash of the id) at most CALIBRATED ids of either label fit the curve, and
    all others are counted. A null or
    empty text has ratio 0. Rows with equal ids each get a row, other columns are not read. Without labels of both kinds every score is the
    share of label 1 (0.5 without any label), and every ratio 0.
    """
    spark = docs.sparkSession
    share = labels.agg(F.avg(label)).first()[0]
    fifth = labels.where(F.pmod(F.xxhash64(id_col), F.lit(5)) == 0)
    held = [fifth.where(F.col(label) == v).orderBy(F.xxhash64(id_col), id_col).limit(CALIBRATED) for v in (0, 1)]
    held = held[0].union(held[1])  # at most 2 * CALIBRATED rows
    path = new_path(spark, "expressions")
    counted = labels.join(F.broadcast(held.select(id_col)), id_col, "left_anti")
    count_expressions(docs, counted, label, id_col, text_col, gate).write.parquet(path)
    terms = model_terms(spark.read.parquet(path), gate)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if terms is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("ratio"), F.lit(0.5 if share is None else float(share)).alias("score"))
    path = new_path(spark, "terms")
    terms.write.parquet(path)
    terms = spark.read.parquet(path)
    sample = ratios(labelled_sample(docs, held, label, CALIBRATED, id_col, text_col), terms).select("ratio", "label").collect()
    x, y = np.array([r["ratio"] for r in sample]), np.array([r["label"] for r in sample])
    slope, offset = fit_curve(x, y, float(share)) if len(set(y.tolist())) == 2 else (1.0, math.log(max(share, 0.01) / max(1 - share, 0.01)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("ratio") * slope + offset))))
    return ratios(rows, terms).select(F.col("id").alias(id_col), "ratio", score.alias("score"))
