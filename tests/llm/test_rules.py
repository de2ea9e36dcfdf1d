import collections
import random

from common import ODD, docs_frame, prose, words
from pyspark.sql import functions as F

from courtside.llm.labelled import id_remainder, labels_of
from courtside.llm.rule_lists import quality_rules


def brute(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    return (*base, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def texts():
    r = random.Random(2)
    some = ["".join(r.choice("ab  \n\t#|<é") for _ in range(r.randrange(0, 300))) for _ in range(80)]
    return [*ODD, *some, "x " * 200, prose(1, 5000, 12), "l one\nl one\n l one\n\nl one", "a b c a b", "a a a a"]


def test_statistics_against_brute_force(spark):
    rows = [*enumerate(texts()), (0, "twice"), (None, "no id")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    got = quality_rules(docs_frame(spark, rows, extra=True), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(str((r["doc_id"], *[r[n] for n in names])) for r in got) == sorted(str((i, *brute(t))) for i, t in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in got)


def test_learned_list(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        w = [f"{'q' * r.randrange(2, 6)}{r.randrange(10_000)}" for _ in range(r.randrange(60, 120))]
        text = " ".join(w) if good else " ".join(x + "%%" for x in w) if i % 2 else " ".join(w[:8] * 9)
        rows.append((i, text))
        labels.append((i, int(good)))
    held = spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = quality_rules(docs_frame(spark, rows), held.where("doc_id < 600")).where("doc_id >= 600").collect()
    truth = dict(labels)
    assert sum(x["kept"] == bool(truth[x["doc_id"]]) for x in out) >= 0.98 * len(out)
    assert all(x["kept"] for x in out if truth[x["doc_id"]])


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality_rules(docs_frame(spark, [(1, prose(1, 80, 1000))]), none).collect()
    assert [(x["kept"], x["rule"]) for x in out] == [(True, None)]
    assert quality_rules(docs_frame(spark, []), none).count() == 0


def test_labels_and_remainders(spark):
    import zlib

    rows = [(1, 1, None), (1, 0, None), (2, 0, None), (3, None, None), (None, 1, None)]
    got = labels_of(spark.createDataFrame(rows, "doc_id bigint, quality int, x string"), "quality").collect()
    assert sorted((r["doc_id"], r["quality"]) for r in got) == [(1, 1), (2, 0)]
    ids = spark.range(200).select("id", id_remainder(F.col("id"), 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in ids)
