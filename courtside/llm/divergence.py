"""Source divergence audit by chunk factorization.

Texts are cut at ASCII white space into chunks ("Word,"), which repeat far more often than they differ. Each task counts the chunks of
its documents, source by source, and leaves one row per language and chunk of a block of documents. Sorted by chunk, these rows meet:
every chunk that occurs anywhere is cut into terms once, and its terms take its counts along. Sorted by term, they are added up.

Distinct documents of a term: several chunks of one document may hold the same term, so document counts of chunks don't add up. Their
maximum and their sum bound the number, however, and settle nearly every term; those that stay open are looked up in the documents.

Counts by source travel as text (``name:count,name:count``): rows of one key are joined without being read, and only long ones and those
of kept terms are taken apart.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.llm.vectors import written

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a term (ASCII letters in lower case, all beyond ASCII) stay; the others become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 32 << 20  # text of the documents that are counted together
PIECE_BYTES = 4 << 20  # a longer text is cut at white space into pieces
ROWS = 1 << 15  # rows of an Arrow batch that leaves a task
LONG = 1 << 14  # bytes of counts by source from which they are added up before they go on
OPEN_TERMS = 200_000  # open terms that are looked up in one pass over the documents
TERMS = 2048  # terms of a group of the comparison, about
ONE = 1_000_000_000  # what the shares of a group add up to
COUNTED = "chunk string, lang string, n_docs bigint, sources string"
CUT = "term string, lang string, n_docs bigint, least bigint, sources string"


# Counting


def pieces_of(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space."""
    at = 0
    while len(text) - at > PIECE_BYTES and (found := SPACE.search(text, at + PIECE_BYTES)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def chunk_counts(texts: list[bytes]) -> tuple[Counter, Counter]:
    """Occurrences and documents of every chunk."""
    n, n_docs = Counter(), Counter()
    for text in texts:
        if len(text) <= PIECE_BYTES:
            chunks = text.split()  # of bytes: at 0x20 and 0x09-0x0D
            n.update(chunks)
            n_docs.update(set(chunks))
        else:
            found: set[bytes] = set()
            for piece in pieces_of(text):
                chunks = piece.split()
                n.update(chunks)
                found.update(chunks)
            n_docs.update(found)
    return n, n_docs


def quoted(source: str) -> str:
    return source.replace("%", "%25").replace(":", "%3A").replace(",", "%2C")


def unquoted(source: str) -> str:
    return source.replace("%2C", ",").replace("%3A", ":").replace("%25", "%")


def texts_of(names: pa.Array, n: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(names, pa.array(n).cast(pa.string()), ":")


def joined(texts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Runs of texts (which end at ``ends``) joined by commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), texts), ",")


def block_rows(docs: dict[str, dict[str, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    """COUNTED rows of a block of documents, by language and source."""
    for lang, sources in docs.items():
        keys, names, n, n_docs = [], [], [], []
        for source, texts in sources.items():
            count, count_docs = chunk_counts(texts)
            keys.append(pa.array(list(count), pa.binary()))
            names.append(np.full(len(count), len(names)))
            n.append(np.fromiter(count.values(), np.int64, len(count)))
            n_docs.append(np.fromiter(map(count_docs.__getitem__, count), np.int64, len(count)))
        coded = pa.chunked_array(keys, pa.binary()).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order, chunks = np.argsort(code, kind="stable"), coded.dictionary.cast(pa.string())
        if not len(chunks):
            continue
        code, name, count, count_docs = (x[order] for x in (code, np.concatenate(names), np.concatenate(n), np.concatenate(n_docs)))
        ends = np.cumsum(np.bincount(code, minlength=len(chunks)))
        texts = texts_of(pa.array([quoted(s) for s in sources]).take(pa.array(name)), count)
        total = np.add.reduceat(count_docs, np.concatenate([[0], ends[:-1]]))
        whole = pa.RecordBatch.from_arrays([chunks, pa.array([lang]).take(pa.array(np.zeros(len(chunks), int))), pa.array(total), joined(texts, ends)], ["chunk", "lang", "n_docs", "sources"])
        for at in range(0, len(chunks), ROWS):
            yield whole.slice(at, ROWS)


def count_chunks(docs: DataFrame) -> DataFrame:
    """COUNTED rows per block of documents, from the columns lang, source (no nulls) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[str, dict[str, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                value = text.as_py() or b""
                block[lang][source].append(value)
                held += len(value)
                if held >= BLOCK_BYTES:
                    yield from block_rows(block)
                    block.clear()
                    held = 0
        yield from block_rows(block)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, COUNTED)


# Adding up


def by_source(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Counts by source taken apart and added up: the text's number, the (quoted) source and the count, in order of the texts."""
    lists = pc.split_pattern(texts, ",")
    entry, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    parts = pc.split_pattern(entry, ":").flatten()
    coded = parts.take(pa.array(np.arange(0, len(parts), 2))).dictionary_encode()
    n = parts.take(pa.array(np.arange(1, len(parts), 2))).cast(pa.int64()).to_numpy()
    key = row.astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    different, place = np.unique(key, return_inverse=True)
    total = np.zeros(len(different), np.int64)
    np.add.at(total, place, n)
    return different // max(1, len(coded.dictionary)), coded.dictionary.take(pa.array(different % max(1, len(coded.dictionary)))), total


def shortened(texts: pa.Array) -> pa.Array:
    """The same counts with each source once, where the text is long."""
    long = np.flatnonzero(pc.binary_length(texts).to_numpy() > LONG)
    if not len(long):
        return texts
    row, source, n = by_source(texts.take(pa.array(long)))
    short = joined(texts_of(source, n), np.cumsum(np.bincount(row, minlength=len(long))))
    mask = np.zeros(len(texts), bool)
    mask[long] = True
    return pc.replace_with_mask(texts, pa.array(mask), short)


def by_key(batches: Iterator[pa.RecordBatch], key: str, fold: Callable[[pa.Table], pa.Table]) -> Iterator[pa.Table]:
    """Folded rows of sorted batches, so that each ``key`` and language ends up in one row; the last key is held until the next one begins."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = fold(pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not table.num_rows:
            continue
        first = int(np.argmax(pc.equal(table.column(key), table.column(key)[-1]).to_numpy(zero_copy_only=False)))
        if first:
            yield table.slice(0, first)
        held = table.slice(first)
    if held is not None and held.num_rows:
        yield held


def folder(key: str, most: tuple[str, ...] = ()) -> Callable[[pa.Table], pa.Table]:
    """Adds up ``n_docs``, takes the greatest of the columns ``most`` and joins ``sources`` over neighbouring rows of equal key and language."""

    def fold(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return table
        table = table.combine_chunks()
        same = np.ones(table.num_rows - 1, bool)
        for name in (key, "lang"):
            column = table.column(name).chunk(0)
            same &= pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        out = {name: table.column(name).take(pa.array(starts)) for name in (key, "lang")}
        out["n_docs"] = pa.array(np.add.reduceat(table.column("n_docs").to_numpy(), starts))
        out |= {name: pa.array(np.maximum.reduceat(table.column(name).to_numpy(), starts)) for name in most}
        out["sources"] = shortened(joined(table.column("sources").chunk(0), np.append(starts[1:], table.num_rows)))
        return pa.table(out)

    return fold


def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CUT rows of rows sorted by chunk. A term that a chunk holds more than once has a row for each, the further ones without documents."""
    for table in by_key(batches, "chunk", folder("chunk")):
        row, terms, again = [], [], []
        last, cut = None, []
        for i, chunk in enumerate(table.column("chunk").cast(pa.binary()).to_pylist()):
            if chunk != last:  # rows of several languages follow each other
                last, cut = chunk, sorted(chunk.translate(TERM_BYTES).split())
            for j, term in enumerate(cut):
                row.append(i)
                terms.append(term)
                again.append(j > 0 and term == cut[j - 1])
        row, first = np.array(row, np.int64), ~np.array(again, bool)
        for at in range(0, len(row), ROWS):
            some = pa.array(row[at : at + ROWS])
            n_docs = pa.array(np.where(first[at : at + ROWS], table.column("n_docs").take(some).to_numpy(), 0))
            columns = [pa.array(terms[at : at + ROWS], pa.binary()).cast(pa.string()), table.column("lang").take(some).combine_chunks(), n_docs, n_docs, table.column("sources").take(some).combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["term", "lang", "n_docs", "least", "sources"])


def kept_terms(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """``lang``, ``source``, ``term``, ``n`` and ``open`` of the terms whose chunks are in ``min_docs`` documents together, from rows sorted by term."""
    for table in by_key(batches, "term", folder("term", ("least",))):
        table = table.filter(pc.greater_equal(table.column("n_docs"), min_docs)).combine_chunks()
        for at in range(0, table.num_rows, ROWS):
            some = table.slice(at, ROWS).combine_chunks()
            row, source, n = by_source(some.column("sources").chunk(0))
            of = pa.array(row)
            open_ = pc.less(some.column("least"), min_docs).combine_chunks().take(of)
            names = source.dictionary_encode()
            clear = pa.array([unquoted(s) for s in names.dictionary.to_pylist()], pa.string()).take(names.indices)
            columns = [some.column("lang").chunk(0).take(of), clear, some.column("term").chunk(0).take(of), pa.array(n), open_]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "open"])


def look_up(docs: DataFrame, open_terms: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``n_docs``: documents of the open terms, read in passes of OPEN_TERMS terms about."""
    passes = -(-open_terms.count() // OPEN_TERMS)
    out = None
    for k in range(passes):
        wanted: dict[str, set[bytes]] = defaultdict(set)
        for lang, term in open_terms.where(F.pmod(F.xxhash64("lang", "term"), F.lit(passes)) == k).collect():
            wanted[lang].add(term.encode())
        wanted = dict(wanted)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            found = Counter()
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    if terms := wanted.get(lang):
                        in_text: set[bytes] = set()
                        for piece in pieces_of(text.as_py() or b""):
                            in_text |= terms.intersection(piece.translate(TERM_BYTES).split())
                        found.update((lang, t) for t in in_text)
            langs, terms = ([k[i] for k in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "term", "n"])

        some = docs.where(F.col("lang").isin(list(wanted))).select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, term string, n bigint")
        out = some if out is None else out.union(some)
    return out.groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: occurrences of every kept term (in ``min_docs`` documents of its language) where there are any."""
    cut = count_chunks(docs).repartition("chunk").sortWithinPartitions("chunk", "lang").mapInArrow(cut_chunks, CUT)
    sorted_terms = cut.repartition("term").sortWithinPartitions("term", "lang")
    found = written(sorted_terms.mapInArrow(lambda b: kept_terms(b, min_docs), "lang string, source string, term string, n bigint, open boolean"), "terms")
    open_ones = written(found.where("open").select("lang", "term").distinct(), "open")
    if open_ones.isEmpty():
        return found.select("lang", "source", "term", "n")
    dropped = open_ones.join(look_up(docs, open_ones).where(F.col("n_docs") >= min_docs), ["lang", "term"], "left_anti")
    return found.join(dropped, ["lang", "term"], "left_anti").select("lang", "source", "term", "n")


# Comparing


def shares(n: np.ndarray, total: np.ndarray, prior: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (n + prior) / (total + prior * terms)), exact."""
    if n.size and int(n.max()) + prior >= (1 << 63) // ONE:
        n, total = n.astype(object), total.astype(object)
    return 1 + ONE * (n + prior) // (total + prior * terms)


def compare(counts: pa.Table, lang: pa.Table, prior: int, top_terms: int) -> pa.Table:
    """For some terms of one language: sums of |p - q| by pairs of sources, and each source's ``top_terms`` terms above the language."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not counts.num_rows or not lang.num_rows:
        return schema.empty_table()
    row = lang.to_pylist()[0]
    groups = sorted((g["source"], g["total"]) for g in row["groups"])
    names, total = [g[0] for g in groups], np.array([g[1] for g in groups], np.int64)
    coded = counts.column("term").combine_chunks().dictionary_encode()
    terms, place = coded.dictionary, {s: i for i, s in enumerate(names)}
    n = np.zeros((len(names), len(terms)), np.int64)
    n[[place[s] for s in counts.column("source").to_pylist()], coded.indices.to_numpy()] = counts.column("n").to_numpy()
    p = shares(n, total[:, None], prior, row["terms"])
    q = shares(n.sum(0), np.array(row["total"]), prior, row["terms"])
    out = [pa.table([[row["lang"]] * len(names), [names[i]] * len(names), ["pair"] * len(names), names, np.abs(p - p[i]).sum(1).astype(np.int64)], schema=schema) for i in range(len(names))]
    item_order = np.argsort(np.argsort(np.array(terms.cast(pa.binary()).to_pylist(), object)))
    for i, name in enumerate(names):
        above = np.flatnonzero((n[i] > 0) & (p[i] > q))
        value = (p[i, above] - q[above]).astype(np.int64)
        first = np.lexsort((item_order[above], -value))[:top_terms]
        out.append(pa.table([[row["lang"]] * len(first), [name] * len(first), ["term"] * len(first), terms.take(pa.array(above[first])), value[first]], schema=schema))
    return pa.concat_tables(out)


def audit_sources(docs: DataFrame, min_docs: int = 30, prior: int = 5, top_terms: int = 50) -> DataFrame:
    """How the sources of each language differ in their terms: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    A group (language and source) and a whole language give every kept term of the language the share p of :func:`shares`. Part ``pair``: for
    every other source of the language the sum of |p - q| over all kept terms, q that source's share, all ranks. Part ``term``: |p - q| of the
    terms that occur in the group and have p above the language's q, ranks up to ``top_terms``. Ranks go by value, falling, then by item.

    Reads the columns text, lang and source only, null as empty. A language that keeps no terms has the value 0 in all its pairs; a group
    without terms gives each kept term the same share. Repeated rows count as often as they occur. An empty table gives an empty table.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    groups = rows.select("lang", "source").distinct()
    counts = written(term_counts(rows, min_docs), "divergence")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    sized = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", zero).alias("total"))
    sized = written(sized, "groups")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = terms.join(sized.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("groups")), "lang")  # the result has the square of it
    langs = written(langs.withColumn("parts", F.ceil(F.col("terms") / F.lit(TERMS)).cast("int")), "langs")

    dealt = counts.join(langs.select("lang", "parts"), "lang").withColumn("at", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).groupBy("lang", "at")
    whole = langs.withColumn("at", F.explode(F.expr("sequence(0, parts - 1)"))).select("lang", "at", "terms", "total", "groups").groupBy("lang", "at")
    schema = "lang string, source string, part string, item string, value bigint"
    found = written(dealt.cogroup(whole).applyInArrow(lambda a, b: compare(a, b, prior, top_terms), schema), "compared")

    apart = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = sized.select("lang", "source").join(sized.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(apart, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", place).select(columns).union(best.select(columns))
