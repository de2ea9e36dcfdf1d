import zlib

import numpy as np
import pyarrow as pa
from common import ODD, docs_frame

from courtside.llm import quality_net as q

SF = "/root/testdata/sf0.01"


def random_net(seed=1):
    r = np.random.default_rng(seed)
    return q.Net(r.normal(0, 1, (q.WIDTH, 257, q.FILTERS)).astype(np.float32), r.normal(0, 1, q.FILTERS).astype(np.float32), r.normal(0, 1, q.FILTERS), r.normal(0, 1, q.FILTERS), 0.1)


def brute(net, text):
    data = (text or "").encode()
    n = max(1, len(data))
    padded = [*data, *[q.PAD] * (n - len(data) + q.WIDTH - 1)]
    answers = np.array([sum(net.filters[t, padded[i + t]] for t in range(q.WIDTH)) for i in range(n)]) + net.bias
    chunks = np.array([np.maximum(answers[a : a + q.CHUNK].max(0), 0) for a in range(0, n, q.CHUNK)])
    return 1 / (1 + np.exp(-(chunks.mean(0) @ net.mean + chunks.max(0) @ net.top + net.offset)))


def test_whole_texts_are_scored():
    net, texts = random_net(), [*ODD, "abc" * 700, "x" * q.CHUNK, "y" * (q.CHUNK + 1), "é" * 3000]
    got = q.scores(net, pa.array(texts, pa.string()))
    assert np.allclose(got, [brute(net, t) for t in texts], atol=1e-4)
    alone = np.concatenate([q.scores(net, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(got, alone, atol=1e-5)


def test_rows(spark):
    net = random_net()
    rows = [*enumerate(ODD), (1, "again"), (None, "no id"), (50, "long " * 100_000)]
    got = q.score_quality(docs_frame(spark, rows, extra=True), net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = q.keep_quality(docs_frame(spark, rows, extra=True), net, threshold=0.3)
    assert kept.count() == sum(r["score"] >= 0.3 for r in got) and kept.columns == docs_frame(spark, rows, extra=True).columns
    assert q.score_quality(docs_frame(spark, []), net).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = docs_frame(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert q.fit_quality(docs, none) == 0.5
    assert q.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], none.schema)) == 1.0
    assert [r["score"] for r in q.score_quality(docs, 0.25).collect()] == [0.25, 0.25]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    train = [(i, v) for i, v in labels.items() if zlib.crc32(str(i).encode()) % 5]
    net = q.fit_quality(docs, spark.createDataFrame(train, "doc_id bigint, quality int"))
    got = {r["doc_id"]: r["score"] for r in q.score_quality(docs, net).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(labels[i]) for i in held) >= 0.95 * len(held)
    assert all(got[i] >= 0.3 for i in held if labels[i])
