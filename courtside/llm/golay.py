"""SimHash near-duplicates by Golay-code fuzzy hashing.

The perfect binary Golay code puts every 23-bit vector within 3 bits of exactly one of 4096 codewords. A vector at distance 3 has five
more codewords at distance 4; the numbers of its nearest codeword and of those five are its keys, and two vectors that differ in at most
two bits always share a key (one of them lies within one bit of a vector that lies within one bit of the other).

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Four differing bits fall in one of two ways:

* at most two in every segment: then some combination of one key from each segment is equal (36 bits, about 150 keys);
* three or more in one segment: then another segment is equal as it is and the third differs in at most one bit: its bits and a
  number of the third are equal (34 bits). Of two vectors that differ in one bit, the one with an even count of ones is
  given its nearest codeword only.

Equal keys are only candidates: every candidate pair is checked by counting its differing bits. Fingerprints are made distinct first, so
copies cost nothing; a key's fingerprints are compared inside one sorted stream of 8-byte numbers, and only the links of a spanning
forest leave it, so no pairs of a dense group are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.common import salted_join
from courtside.functions.store import new_path
from courtside.llm.blocks import text_blocks
from courtside.llm.components import components

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit and width
MAX_BITS = 4  # what the two kinds of keys cover
COMPARED = 2048  # rows of a comparison block
LARGE = 4 * COMPARED  # fingerprints of a key from which they are compared by blocks of bits


# Fingerprints


def simhash(text: str, words: int) -> int:
    """Bit i is one if it is set in more than half of the XXH64 hashes (seed 42) of the word shingles."""
    tokens = text.encode().lower().split()  # of bytes: only A-Z, and white space 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(tokens) - k + 1)
    return vote(hashes)


def vote(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (bigint, the 64 bits) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "text"):
            prints = np.fromiter((simhash(t.as_py() or "", words) for t in part.column("text")), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


# Keys


@cache
def code_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainders of the 23-bit vectors by byte, and for every remainder the error patterns of up to six codewords (-1: none)."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = np.array([remainder(1 << i) for i in range(23)])
    by_byte = []
    for low in (0, 8, 16):
        values, out = np.arange(256), np.zeros(256, np.int64)
        for i in range(min(8, 23 - low)):
            out ^= np.where(values >> i & 1, single[low + i], 0)
        by_byte.append(out)
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    near = {0: 0}
    for i in range(23):
        near[int(single[i])] = 1 << i
        for j in range(i):
            near[int(single[i] ^ single[j])] = 1 << i | 1 << j
    for rest, pattern in near.items():
        patterns[rest, 0], filled[rest] = pattern, 1
    for size in (3, 4):
        vectors = np.array([v for v in _patterns(size)])
        rests = by_byte[0][vectors & 255] ^ by_byte[1][vectors >> 8 & 255] ^ by_byte[2][vectors >> 16]
        for v, rest in zip(vectors.tolist(), rests.tolist(), strict=True):
            if rest not in near and filled[rest] < 6:
                patterns[rest, filled[rest]] = v
                filled[rest] += 1
    return by_byte, patterns


def _patterns(size: int) -> Iterator[int]:
    from itertools import combinations

    for bits in combinations(range(23), size):
        yield sum(1 << b for b in bits)


def codewords(vectors: np.ndarray) -> np.ndarray:
    """Numbers (0 to 4095) of the nearest codeword and, where that is 3 bits away, of the five at distance 4; -1: none."""
    by_byte, patterns = code_tables()
    rest = by_byte[0][vectors & 255] ^ by_byte[1][vectors >> 8 & 255] ^ by_byte[2][vectors >> 16]
    errors = patterns[rest]
    return np.where(errors >= 0, (vectors[:, None] ^ errors) >> 11, -1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of distinct fingerprints, as row numbers and keys. The two highest bits and a number tell the kinds of keys apart."""
    value = prints.view(np.uint64)
    parts = [(value >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [codewords(p) for p in parts]
    n = len(prints)
    three = (near[0][:, :, None, None] << 24) | (near[1][:, None, :, None] << 12) | near[2][:, None, None, :]
    valid = (near[0] >= 0)[:, :, None, None] & (near[1] >= 0)[:, None, :, None] & (near[2] >= 0)[:, None, None, :]
    rows, keys = [np.nonzero(valid.reshape(n, -1))[0]], [three.reshape(n, -1)[valid.reshape(n, -1)]]
    kind = 1
    for same in range(3):
        for close in range(3):
            if close != same:
                even = (np.bitwise_count(parts[close].astype(np.uint64)) % 2 == 0)[:, None]
                use = (near[close] >= 0) & (~even | (np.arange(6) == 0))
                key = (np.int64(kind) << 40) | (parts[same][:, None] << 12) | near[close]
                rows.append(np.nonzero(use)[0])
                keys.append(key[use])
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


# Links


def linked(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct fingerprints that differ in at most ``max_bits`` bits.

    Grows one component at a time: its newest members are compared in blocks with what is not yet reached.
    """
    rest, child, parent = members, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:COMPARED], front[COMPARED:]
            reached = []
            keep = np.ones(len(rest), bool)
            for at in range(0, len(rest), COMPARED):
                close = np.bitwise_count(some[:, None] ^ rest[None, at : at + COMPARED]) <= max_bits
                hit = close.any(0)
                child.append(rest[at : at + COMPARED][hit])
                parent.append(some[close.argmax(0)[hit]])
                reached.append(child[-1])
                keep[at : at + COMPARED] = ~hit
            rest = rest[keep]
            front = np.concatenate([front, *reached])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *child]), np.concatenate([empty, *parent])


def linked_large(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``linked``, for many fingerprints: two that differ in at most ``max_bits`` bits agree in one of ``max_bits + 1`` blocks of bits,
    so only those with a block in common are compared."""
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    child, parent = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        block = members >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(block, kind="stable")
        for group in np.split(members[order], np.flatnonzero(np.diff(block[order])) + 1):
            if len(group) > 1:
                a, b = linked(group, max_bits)
                child.append(a)
                parent.append(b)
    return np.concatenate(child), np.concatenate(parent)


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each key, from rows sorted by key; a key's rows may go on in the next batch."""
    held_key = np.zeros(0, np.int64)
    held_print = np.zeros(0, np.uint64)

    def found(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(starts, append=len(key))
        twos = starts[size == 2]
        near = np.bitwise_count(value[twos] ^ value[twos + 1]) <= max_bits if len(twos) else np.zeros(0, bool)
        a, b = [value[twos[near]]], [value[twos[near] + 1]]
        for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = (linked if n <= LARGE else linked_large)(value[s : s + n], max_bits)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a.view(np.int64), b.view(np.int64))), pa.array(np.minimum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        value = np.concatenate([held_print, batch.column("fingerprint").to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            yield found(key[:whole], value[:whole])
        held_key, held_print = key[whole:], value[whole:]
    if len(held_key):
        yield found(held_key, held_print)


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of <= ``max_bits`` bits.

    A text with fewer words than a shingle is hashed whole; one without words (null, empty) has fingerprint zero and is linked like any
    other. Rows with equal ids each get a row. A null id is never the smallest; where a component has no other id, it is null. Other
    columns are not read. The id is of any type that can be ordered. An empty table gives an empty table.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys cover at most {MAX_BITS} differing bits")
    spark = docs.sparkSession
    path = new_path(spark, "fingerprints")
    fingerprints(docs, words, id_col, text_col).write.parquet(path)
    prints = spark.read.parquet(path)
    classes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                value = batch.column(0).slice(at, 2000).to_numpy()
                row, key = keys_of(value)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value[row])], ["key", "fingerprint"])

    # a few bytes of fingerprints make many keys: they are not packed into few tasks
    dealt = classes.select("fingerprint").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    keys = dealt.mapInArrow(keyed, "key bigint, fingerprint bigint")
    links = keys.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _links(b, max_bits), "a bigint, b bigint").distinct()
    roots = components(links, "a", "b")
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by_print = salted_join(rooted, smallest, "root", ["fingerprint"], how="left")  # a component may hold a third of all fingerprints
    by_print = by_print.select("fingerprint", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(by_print, "fingerprint").select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
