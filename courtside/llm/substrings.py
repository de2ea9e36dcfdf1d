"""Removal of word passages that an earlier document already contains.

Every window of ``window`` consecutive words of every document gets a Rabin-Karp hash. The work is dealt twice:

1. Documents are shuffled into batches by a hash of the row. A batch keeps each of its window hashes once, with the smallest document
   id that has it, so a passage that a third of all documents share counts once per batch before the next shuffle.
2. The hashes, packed by range of the hash, are shuffled into buckets. A bucket counts the batches of each hash, finds the smallest
   document id over all batches, and answers each batch with one bit per hash: some other batch has it in an earlier document.
3. The answers meet the documents of the batch again (Spark reuses the shuffle of step 1), and the windows found merge into maximal
   intervals of words to remove.

Batches and buckets are sized from the corpus: at least ``BATCH_WORDS`` words, and growing with the square root of the corpus, so that
the number of packed rows stays in proportion to the number of windows. The hash has 64 bits; among n windows about n^2 / 2^65 pairs of
different windows are expected to collide (0.0005 at 135 million windows).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.blocks import INVERSE, find_words, hash_words, mixed, powers, text_blocks, text_bytes

BATCH_WORDS = 600_000
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than any other


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of the ``window`` words from each word on, as differences of one running sum."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(n), dtype=np.uint64)])
    # The first word of a window from s on weighs BASE^s in the sum; dividing by that makes the weights the same everywhere.
    return mixed((total[window:] - total[: n - window + 1]) * powers(n - window + 1, INVERSE))


class Batch:
    """The words and windows of some documents, smallest id first."""

    def __init__(self, table: pa.Table, window: int, id_col: str, text_col: str):
        ids = pc.fill_null(table.column(id_col), NO_ID).to_numpy().astype(np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(self.order)).combine_chunks()
        self.ids, self.rank = np.unique(ids[self.order], return_inverse=True)
        hashes, ranks, self.parts = [], [], []
        row = 0
        for part in text_blocks(self.table.to_batches(), text_col):
            data, offsets = text_bytes(part.column(text_col))
            starts, ends, first = find_words(data, offsets)
            rolled = window_hashes(hash_words(data, starts, ends), window)
            document = np.repeat(np.arange(part.num_rows), np.diff(first))
            begins = np.flatnonzero(np.arange(len(rolled)) + window <= first[document[: len(rolled)] + 1])
            hashes.append(rolled[begins])
            ranks.append(self.rank[row + document[begins]])
            self.parts.append((row, part.num_rows, begins))
            row += part.num_rows
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.ranks = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
        #: Each hash once, ascending; the first window that has it (smallest id); for each window the place of its hash.
        self.unique, self.first, self.place = np.unique(self.hashes, return_index=True, return_inverse=True)

    def bounds(self, buckets: int) -> np.ndarray:
        bucket = ((self.unique >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of six bytes, or of eight where one is larger."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = 6 if len(steps) < 2 or int(steps[1:].max()) < 1 << 48 else 8
    return values[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    if n == 1:
        return np.frombuffer(data, np.uint64)
    width = (len(data) - 8) // (n - 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(n - 1, width)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


PACKED = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("hashes", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("which", T.BinaryType()),
])
ANSWER = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())])
REPEATS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def pack_batch(table: pa.Table, window: int, buckets: int, id_col: str, text_col: str, batch_col: str) -> pa.Table:
    own = Batch(table, window, id_col, text_col)
    number = table.column(batch_col)[0].as_py()
    rank = own.ranks[own.first]
    out = {f.name: [] for f in PACKED}
    bounds = own.bounds(buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        low, high = bounds[b], bounds[b + 1]
        used, which = np.unique(rank[low:high], return_inverse=True)
        row = (b, number, high - low, pack(own.unique[low:high]), own.ids[used].tobytes(), which.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes())
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("which", pa.binary())]))


def answer_bucket(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    hashes = np.concatenate([unpack(r["hashes"], r["n"]) for r in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["which"], np.uint16 if len(r["which"]) == 2 * r["n"] else np.uint32)] for r in rows])
    order = np.argsort(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    smallest = np.minimum.reduceat(ids[order], starts)
    earlier = np.empty(len(ids), bool)
    earlier[order] = ids[order] > np.repeat(smallest, np.diff(starts, append=len(ids)))
    cut = np.cumsum([0, *(r["n"] for r in rows)])
    bits = [earlier[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    found = [i for i, x in enumerate(bits) if x.any()]
    return pa.table({
        "batch": pa.array([rows[i]["batch"] for i in found], pa.int32()), "bucket": pa.array([rows[i]["bucket"] for i in found], pa.int32()),
        "bits": pa.array([np.packbits(bits[i]).tobytes() for i in found], pa.binary()),
    })


def cut_batch(table: pa.Table, answers: pa.Table, window: int, buckets: int, id_col: str, text_col: str, out: pa.Schema) -> pa.Table:
    if not table.num_rows:
        return out.empty_table()
    own = Batch(table, window, id_col, text_col)
    earlier, bounds = np.zeros(len(own.unique), bool), own.bounds(buckets)
    for r in answers.to_pylist():
        low, high = bounds[r["bucket"]], bounds[r["bucket"] + 1]
        earlier[low:high] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=high - low).astype(bool)
    repeated = earlier[own.place] | (own.ranks > own.ranks[own.first][own.place])
    done, at = [], 0
    for row, n, begins in own.parts:
        part = own.table.slice(row, n)
        done.append(_cut(part, begins[repeated[at : at + len(begins)]], window, text_col, out))
        at += len(begins)
    return pa.concat_tables(done)


def _cut(part: pa.Table, begins: np.ndarray, window: int, text_col: str, out: pa.Schema) -> pa.Table:
    """The documents of a block without the words covered by the windows that begin at ``begins``."""
    column = part.column(text_col).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, offsets = text_bytes(column)
    starts, _, first = find_words(data, offsets)
    n = len(starts)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + window, -1)
    gone = np.cumsum(cover)[:n] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    document = np.repeat(np.arange(part.num_rows), np.diff(first))
    text = column
    if gone.any():
        after = np.append(starts[1:], len(data))
        last = first[1:][document] - 1 == np.arange(n)
        after = np.where(last, offsets[1:][document], after)  # up to the next word, or the end of the document
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, after[gone], -1)
        kept = np.cumsum(edge)[: len(data)] == 0
        size = np.concatenate([[0], np.cumsum(kept)])[offsets]
        text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[kept].tobytes()))
        text = pc.if_else(pc.is_null(column), pa.scalar(None, pa.large_string()), text)
    opens = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (document[1:] == document[:-1])])) if n else np.zeros(0, np.int64)
    closes = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (document[1:] == document[:-1]), [False]])) if n else np.zeros(0, np.int64)
    base = first[document[opens]] if n else opens
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(opens, first), pa.int32()),
        pa.StructArray.from_arrays([pa.array(opens - base, pa.int32()), pa.array(closes + 1 - base, pa.int32())], ["start", "end"]),
    )
    repeats = pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total[first]), pa.int64()), spans], ["n_words", "n_removed", "spans"])
    columns = [repeats if f.name == "repeats" else text.cast(f.type) if f.name == text_col else part.column(f.name).cast(f.type) for f in out]
    return pa.table(columns, schema=out)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", batch_words: int = BATCH_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated passages, and ``repeats``: n_words, n_removed, spans [start, end) in words.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are judged on the
    texts as given. What stands between the words that stay is kept as it was; a removed passage goes with the white space behind it.

    A null text stays null and has no words; an empty text, or one shorter than a window, stays as it is. Rows with the same id count as
    one document and take nothing from each other; a null id counts as larger than any id. An input column named ``repeats`` is replaced;
    other columns pass through unchanged. An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop("repeats")
    size = kept.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    words = size / 6
    per_batch = max(batch_words, math.sqrt(64 * words))
    batches, buckets = max(1, math.ceil(words / per_batch)), max(1, math.ceil(words / (3 * per_batch)))
    schema = T.StructType([*kept.schema.fields, T.StructField("repeats", REPEATS)])
    arrow = to_arrow_schema(schema)
    # Both uses of the batches read the same columns, so that Spark shuffles the documents once.
    batch = free_name(kept, "_batch")
    dealt = kept.withColumn(batch, F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).cast("int"))
    packed = dealt.groupBy(batch).applyInArrow(lambda t: pack_batch(t, window, buckets, id_col, text_col, batch), PACKED)
    answers = packed.groupBy("bucket").applyInArrow(answer_bucket, ANSWER)
    return dealt.groupBy(batch).cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: cut_batch(a, b, window, buckets, id_col, text_col, arrow), schema)
