"""Quality classifier: a convolutional network over the bytes of a document, in numpy.

Filters of ``WIDTH`` bytes slide over the whole text, cut into chunks of ``CHUNK`` positions that overlap by a filter's width. The largest
answer of each filter in each chunk is kept; the mean and the maximum over the chunks make the document's features, and a logistic layer
combines them into one probability. Filters and layer are learned together by Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.blocks import text_blocks, text_bytes
from courtside.llm.labelled import labelled_sample

WIDTH = 6
FILTERS = 16
CHUNK = 512
PAD = 256
PER_CLASS = 1500  # labelled documents of either label that the network is fitted on
LONGEST = 1 << 16  # bytes of the longest document that it is fitted on
STEPS = 900
BATCH = 24


@dataclass
class Net:
    filters: np.ndarray  # WIDTH, 257, FILTERS
    bias: np.ndarray
    mean: np.ndarray
    top: np.ndarray
    offset: float


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of some documents with padding behind each; first position, positions and document of every chunk."""
    size = np.diff(offsets)
    room = np.maximum(size, 1) + WIDTH - 1
    begin = np.cumsum(room) - room
    symbols = np.full(int(room.sum()), PAD, np.int16)
    symbols[np.arange(len(data)) + np.repeat(begin - offsets[:-1], size)] = data
    positions = np.maximum(size, 1)
    count = -(-positions // CHUNK)
    document = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    return symbols, begin[document] + within * CHUNK, np.minimum(CHUNK, positions[document] - within * CHUNK), document


def pooled(net: Net, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of every filter in every chunk, and its position."""
    best, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
    for at in range(0, len(starts), 64):
        begin, length = starts[at : at + 64, None], lengths[at : at + 64, None]
        place = begin + np.minimum(np.arange(min(CHUNK, int(length.max()))), length - 1)
        answer = net.filters[0][symbols[place]]
        for t in range(1, WIDTH):
            answer += net.filters[t][symbols[place + t]]
        first = answer.argmax(1)
        best[at : at + 64] = np.take_along_axis(answer, first[:, None, :], 1)[:, 0]
        where[at : at + 64] = np.take_along_axis(place, first, 1)
    return best + net.bias, where


def combine(net: Net, best: np.ndarray, document: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of every document, and mean and maximum over its chunks."""
    first = np.searchsorted(document, np.arange(n))
    active = np.maximum(best, 0)
    mean = np.add.reduceat(active, first, 0) / np.diff(first, append=len(document))[:, None]
    top = np.maximum.reduceat(active, first, 0)
    return mean @ net.mean + top @ net.top + net.offset, mean, top


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, prior: float, steps: int = STEPS, seed: int = 5) -> Net:
    """Fit a network on equally many batches of either label; ``prior``, the share of label 1, then moves the log-odds."""
    random = np.random.default_rng(seed)
    net = Net(random.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), random.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(FILTERS, np.float32), 0.0)
    names = ("filters", "bias", "mean", "top", "offset")
    moments = {k: (np.zeros_like(np.asarray(getattr(net, k), np.float32)), np.zeros_like(np.asarray(getattr(net, k), np.float32))) for k in names}
    by_label = [np.flatnonzero(labels == v) for v in (0, 1)]
    for step in range(1, steps + 1):
        some = np.concatenate([random.choice(rows, BATCH // 2) for rows in by_label])
        offsets = np.cumsum([0, *(len(texts[i]) for i in some)])
        symbols, starts, lengths, document = chunks_of(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), offsets)
        best, where = pooled(net, symbols, starts, lengths)
        logit, mean, top = combine(net, best, document, len(some))
        error = ((sigmoid(logit) - labels[some]) / len(some)).astype(np.float32)
        count = np.bincount(document, minlength=len(some))
        active = np.maximum(best, 0)
        leads = active == top[document]
        ties = np.add.reduceat(leads, np.searchsorted(document, np.arange(len(some))), 0)[document]
        back = error[document, None] * (net.mean / count[document, None] + net.top * leads / ties) * (best > 0)
        grad = {"mean": mean.T @ error + 1e-4 * net.mean, "top": top.T @ error + 1e-4 * net.top, "offset": error.sum(), "bias": back.sum(0), "filters": np.zeros_like(net.filters)}
        column = np.broadcast_to(np.arange(FILTERS), back.shape)
        for t in range(WIDTH):
            np.add.at(grad["filters"][t], (symbols[where + t], column), back)
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        for k in names:
            m, v = moments[k]
            m[...] = 0.9 * m + 0.1 * grad[k]
            v[...] = 0.999 * v + 0.001 * np.square(grad[k])
            setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    net.filters = net.filters.astype(np.float32)
    net.offset = float(net.offset) + float(np.log(prior / (1 - prior)))
    return net


def scores(net: Net | float, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every text; a bare number stands for all of them."""
    if not isinstance(net, Net):
        return np.full(len(column), net)
    data, offsets = text_bytes(column)
    symbols, starts, lengths, document = chunks_of(data, offsets)
    best, _ = pooled(net, symbols, starts, lengths)
    return sigmoid(combine(net, best, document, len(column))[0].astype(np.float64))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Net | float:
    """Train on at most ``per_class`` documents of either label, none longer than LONGEST bytes.

    ``labels`` has ``id_col`` and ``label`` once per id. Without examples of both labels the result is the share of label 1 (0.5 without any).
    """
    share = labels.agg(F.avg(label)).first()[0]
    if share is None:
        return 0.5
    rows = labelled_sample(docs, labels, label, per_class, id_col, text_col).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    rows = sorted((r["id"], r["text"] or "", r["label"]) for r in rows.collect())
    known = np.array([r[2] for r in rows])
    if len(set(known.tolist())) < 2:
        return float(share)
    return train([r[1].encode() for r in rows], known, min(max(share, 0.01), 0.99))


def score_quality(docs: DataFrame, net: Net | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row, also where ids repeat or are null.

    A null text counts as empty, and an empty text is one chunk of padding; other columns are not read. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores(sent.value, part.column("text")))], ["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, net: Net | float, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, text_col):
            yield part.filter(pc.greater_equal(pa.array(scores(sent.value, part.column(text_col))), threshold))

    return docs.mapInArrow(run, docs.schema)
