"""Benchmark passages in documents, also slightly edited ones.

Words are runs of word characters of the lower-cased text. A document leaks an item if one of its passages lies within ``edits =
floor(tolerance * words)`` word edits of it: with ``passages`` any run of words, as long as the edits make it, else only windows of as many
words as the item has. The search runs inside the scan of the documents, without a shuffle:

1. The window (of as many words as the item) that begins where such a passage begins has all but ``edits`` of the words of its item, so
   also of its rarer words (those in few items); windows with too few are passed over (running counts; no passage within the distance is
   lost). It lies within 2 * ``edits`` of the item. Behind its last word a document is filled up with unknown words.
2. The CGK embedding sends a window through a random walk: at step j the symbol under the cursor is written down and the cursor moves
   on if a random bit of (j, symbol) says so. Windows at a small edit distance get strings at a small Hamming distance.
3. Bit sampling: each repetition compares ``SAMPLED`` places of the embedded strings with those of the items. The number of repetitions
   is raised until edited copies of the items themselves, at the largest allowed distance, are found with the target recall, those of
   each kind of edits by themselves. Every ``ROUND`` repetitions new walks are taken; if ``MOST_ROUNDS`` do not suffice, every window that
   has enough words of an item meets it, which loses nothing.
4. Every window that meets an item this way is checked by its exact edit distance; with ``passages`` by the least edit distance of the item
   to any passage of the window and the ``edits`` words on either side of it.

Bit sampling finds ever fewer copies as strings grow. An item of more than ``LONGEST`` words is therefore cut into parts of equal length:
of its edits, one of m parts has no more than the m-th part. Parts are searched as above, and where one is found, the whole item is checked.

Items are taken in blocks, bounded by the bytes of their texts and keys, each of which is sent to the executors and meets all documents. The
results of a block are written before the next one is sent.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.blocks import mixed, text_blocks
from courtside.llm.vectors import written

BLOCK_BYTES = 32 << 20  # of item texts and keys in one pass over the documents
LONGEST = 160  # words of an item that is searched as a whole
PART = 100  # words of a part of a longer one, about
SAMPLED = 3
SYMBOL_BITS = 21  # three symbols make a key
WALKS = 8  # independent embeddings of a round; repetitions take them in turn
ROUND = 256  # repetitions
MOST_ROUNDS = 8
COPIES = 512  # edited copies of the items of one length, at least
CELLS = 1 << 19  # words of the windows that are aligned at a time
RARE = 0.03  # words in at most this share of the items (or in one item) are rarer words
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def walk_numbers(length: int, first: int, steps: int) -> np.ndarray:
    """Random numbers of the walks of a round, ``first`` and those behind it: an odd factor and an addend for each walk and step.

    The highest bit of factor * h + addend, h a hash of a symbol, says whether a walk moves on.
    """
    out = np.random.default_rng((length, first)).integers(0, 1 << 32, (2, WALKS, steps), np.uint32)
    out[0] |= np.uint32(1)
    return out


class Sized:
    """The items of one length, and how to find them."""

    def __init__(self, length: int, edits: int, recall: float, items: np.ndarray, numbers: list[int], rare: np.ndarray, passages: bool):
        self.length, self.edits, self.items, self.numbers = length, edits, items, np.array(numbers)
        self.slack = self.edits if passages else 0  # words that a passage may have more or less than its item
        self.known = np.zeros(len(rare), bool)
        self.known[items.reshape(-1)] = True
        self.rare = self.known & rare
        self.least_rare = max(0, int(rare[items].sum(1).min()) - self.edits)
        self.steps = 2 * length
        random = np.random.default_rng(length)
        # Symbols of this length's items; all others count as one, 0. The end of a window is the last.
        self.compact = np.cumsum(self.known) * self.known
        self.end = int(self.compact.max()) + 1
        self.hashes = (mixed(np.arange(1, self.end + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        self.places, self.walks, self.keys = np.zeros((0, SAMPLED), np.int64), [], []
        tried, origin, kind = self.edited(random)
        found = np.zeros(len(tried), bool)
        for _ in range(MOST_ROUNDS):
            if self.more(random, tried, origin, kind, found, recall):
                return
        self.places, self.walks, self.keys = self.places[:0], [], None

    def more(self, random: np.random.Generator, tried: np.ndarray, origin: np.ndarray, kind: np.ndarray, found: np.ndarray, recall: float) -> bool:
        """Add a round of repetitions, or as many of it as it takes; whether the copies of each kind are ``found`` with the recall."""
        first = len(self.walks) * WALKS
        self.walks.append(walk_numbers(self.length, first, self.steps))
        self.places = np.concatenate([self.places, np.sort(random.integers(0, self.steps, (ROUND, SAMPLED)), 1)])
        own, embedded = (self.embed(self.compact[x], first) for x in (self.items, tried))
        for r in range(len(self.keys), len(self.keys) + ROUND):
            item_keys = self.key(own, r)
            order = np.argsort(item_keys, kind="stable")
            self.keys.append((item_keys[order], order.astype(np.int32)))
            found |= self.key(embedded, r) == item_keys[origin]
            if (r + 1) % WALKS == 0 and least_share(found, kind) >= recall:
                return True
        return False

    def edited(self, random: np.random.Generator, copies: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Copies of the items with as many edits as allowed, their items, and kinds of edits. None where no edit is allowed.

        Of passages a quarter each has words replaced, dropped, put in, and any of these; in windows a third each is replaced, dropped and put in.
        """
        some = np.arange(min(len(self.items), 256)) if self.edits else np.arange(0)
        out, origin, kinds = [], [], []
        copies = max(copies, 4 * math.ceil(COPIES / 4 / max(1, len(some))))
        for n, i in enumerate(np.repeat(some, copies).tolist()):
            words = self.items[i].tolist()
            for e in range(self.edits):
                at = int(random.integers(0, len(words)))
                if self.slack:
                    kind = n % 4 if n % 4 < 3 else int(random.integers(0, 3))
                else:
                    kind = 0 if e == self.edits - 1 and self.edits % 3 == 2 else e % 3
                if kind == 0:
                    words[at] = 0
                elif kind == 1:
                    words.pop(at)
                else:
                    words.insert(at, 0)
            out.append((words + [0] * self.length)[: self.length])
            origin.append(i)
            kinds.append(n % 4 if self.slack else 0)
        return np.array(out, np.int64).reshape(-1, self.length), np.array(origin, np.int64), np.array(kinds, np.int64)

    def embed(self, windows: np.ndarray, first: int = 0) -> np.ndarray:
        """Embedded strings of the walks of a round, ``first`` and those behind it: walk, step, window."""
        n = len(windows)
        padded = np.concatenate([windows, np.full((n, 1), self.end, windows.dtype)], 1).reshape(-1).astype(np.int32)
        hashes, (factor, addend) = self.hashes[padded], self.walks[first // WALKS]
        begin = np.arange(n) * (self.length + 1)
        last = begin + self.length
        out, step = np.empty((WALKS, self.steps, n), np.int32), np.empty(n, np.uint32)
        for w in range(WALKS):
            cursor = begin.copy()
            for j in range(self.steps):
                np.take(padded, cursor, out=out[w, j], mode="clip")
                np.take(hashes, cursor, out=step, mode="clip")
                step *= factor[w, j]
                step += addend[w, j]
                step >>= np.uint32(31)
                np.add(cursor, step, out=cursor, casting="unsafe")
                np.minimum(cursor, last, out=cursor)
        return out

    def key(self, embedded: np.ndarray, repetition: int) -> np.ndarray:
        a, b, c = embedded[repetition % WALKS, self.places[repetition]].astype(np.int64)
        return a << 2 * SYMBOL_BITS | b << SYMBOL_BITS | c

    def windows(self, words: np.ndarray, left: np.ndarray) -> np.ndarray:
        """First words of the windows that have enough words of the items; ``left``: words of the document from each word on.

        At the end of a document ``slack`` words of a window may lie behind it.
        """
        if len(words) < self.length:
            return np.zeros(0, np.int64)
        k = self.length
        total = np.concatenate([[0], np.cumsum(self.rare[words], dtype=np.int32)])
        some = np.flatnonzero((total[k:] - total[:-k] >= self.least_rare) & (left[: len(words) - k + 1] >= max(1, k - self.slack)))
        enough = [self.known[words[s[:, None] + np.arange(k)]].sum(1) >= k - self.edits for s in np.array_split(some, len(some) // 4096 + 1)]
        return some[np.concatenate(enough)]

    def matches(self, words: np.ndarray, before: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First words, item numbers, distances and lengths of the passages found; ``before``: words of the document in front of each word."""
        begins = self.windows(words, left)
        for at in range(0, len(begins), 4096):
            some = begins[at : at + 4096]
            windows = words[some[:, None] + np.arange(self.length)]
            window, item = self.meet(windows) if self.keys is not None else self.meet_all(windows)
            if self.slack:
                size = max(1, CELLS // (self.length + 2 * self.slack))
                for n in range(0, len(window), size):
                    at, which = some[window[n : n + size]], item[n : n + size]
                    start, length, distance = nearest(words, at, before[at], left[at], self.items[which], self.slack)
                    good = np.flatnonzero(distance <= self.edits)
                    yield start[good], self.numbers[which[good]], distance[good], length[good]
            elif len(window):
                distance = edit_distance(windows[window], self.items[item], self.edits)
                good = np.flatnonzero(distance <= self.edits)
                yield some[window[good]], self.numbers[item[good]], distance[good], np.full(len(good), self.length)

    def meet(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items that have a key in common."""
        embedded, pairs = None, [np.zeros(0, np.int64)]
        for r, (keys, order) in enumerate(self.keys):
            if r % ROUND == 0:
                embedded = self.embed(self.compact[windows], r // ROUND * WALKS)
            key = self.key(embedded, r)
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(low < high)
            size = high[hit] - low[hit]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.repeat(hit, size) * len(self.items) + order[np.repeat(low[hit], size) + within])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.items))

    def meet_all(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of which they have enough words."""
        window, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(self.items):
            has = np.zeros(len(self.known), bool)
            has[own] = True
            window.append(np.flatnonzero(has[windows].sum(1) >= self.length - self.edits))
            item.append(np.full(len(window[-1]), i))
        return np.concatenate(window), np.concatenate(item)


class Parted:
    """The items of one length beyond LONGEST, found by their parts."""

    def __init__(self, length: int, edits: int, recall: float, items: np.ndarray, numbers: list[int], rare: np.ndarray, passages: bool):
        self.length, self.edits, self.items, self.numbers, self.passages = length, edits, items, np.array(numbers), passages
        self.slack = edits  # of the alignment of a whole item
        count = math.ceil(length / PART)
        ends = [length * (i + 1) // count for i in range(count)]
        cuts = list(zip([0, *ends[:-1]], ends, strict=True))
        self.parts = []  # of one length each, with the place of every part in its item
        for size in sorted({b - a for a, b in cuts}):
            places = [a for a, b in cuts if b - a == size]
            own = np.concatenate([items[:, a : a + size] for a in places])
            self.parts.append((Sized(size, edits // count, recall, own, list(range(len(own))), rare, True), np.repeat(places, len(items))))

    def matches(self, words: np.ndarray, before: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As of Sized."""
        seen = [np.zeros((3, 0), np.int64)]
        for part, places in self.parts:
            for start, number, _, _ in part.matches(words, before, left):
                seen.append(np.stack([start - places[number], number % len(self.items), start]))  # where the item would begin without edits, and a word of the document
        begin, item, word = np.concatenate(seen, 1)
        _, first = np.unique(np.stack([begin, item]), axis=1, return_index=True)
        begin, item, word = begin[first], item[first], word[first]
        # of the document, counted from there; the item may begin before the document
        ahead, behind = before[word] - (word - begin), left[word] + (word - begin)
        size = max(1, CELLS // (self.length + 2 * self.slack))
        for n in range(0, len(begin), size):
            some = slice(n, n + size)
            if self.passages:
                start, length, distance = nearest(words, begin[some], ahead[some], behind[some], self.items[item[some]], self.slack)
                which = item[some]
            else:
                start = (begin[some, None] + np.arange(-self.slack, self.slack + 1)).ravel()
                fits = (ahead[some, None] + np.arange(-self.slack, self.slack + 1) >= 0) & (behind[some, None] - np.arange(-self.slack, self.slack + 1) >= self.length)
                start, which = np.unique(np.stack([start, np.repeat(item[some], 2 * self.slack + 1)])[:, fits.ravel()], axis=1)
                distance = np.concatenate([edit_distance(words[start[i : i + size, None] + np.arange(self.length)], self.items[which[i : i + size]], self.edits) for i in range(0, len(start), size)] or [np.zeros(0, np.int64)])
                length = np.full(len(start), self.length)
            good = np.flatnonzero(distance <= self.edits)
            yield start[good], self.numbers[which[good]], distance[good], length[good]


def nearest(words: np.ndarray, begins: np.ndarray, before: np.ndarray, left: np.ndarray, items: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and distance of the passage nearest to each item, in its window with ``slack`` words on either side.

    ``before`` and ``left``: words of the document in front of each beginning and from there on. Of several the first, of these the one
    whose length is nearest to the item's. No passage leaves its document.
    """
    size = items.shape[1]
    width = size + 2 * slack
    text = words[np.clip(begins[:, None] + np.arange(-slack, size + slack), 0, len(words) - 1)]
    column, unit = np.arange(width + 1), width + 1  # a cell holds its edits * unit + the column where its passage begins
    step, far = column * unit, (size + width + 2) * unit
    inside = (column >= slack - before[:, None]) & (column <= slack + left[:, None])
    row = np.where(inside, column, far)
    for i in range(size):
        new = row + unit
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + unit * (text != items[:, i, None]))
        row = np.minimum.accumulate(new - step, 1) + step
    row = np.where(inside, row, far)
    edits, first = np.divmod(row, unit)
    end = np.argmin(row * unit + np.abs(column - first - size), 1)
    rows = np.arange(len(begins))
    first, edits = first[rows, end], edits[rows, end]
    return begins - slack + first, end - first, edits


def least_share(found: np.ndarray, kind: np.ndarray) -> float:
    """The smallest share found of any kind; 1 where there is nothing to be found."""
    return min((float(found[kind == k].mean()) for k in np.unique(kind)), default=1.0)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of rows of equal length; ``most + 1`` stands for anything larger. Symbol 0 equals nothing in ``b``."""
    n, length = a.shape
    far = most + 1
    row = np.minimum(np.arange(length + 1), far)[None, :].repeat(n, 0).astype(np.int32)
    for i in range(1, length + 1):
        low, high = max(1, i - most), min(length, i + most)
        new = np.full_like(row, far)
        new[:, 0] = min(i, far)
        changed = row[:, low - 1 : high] + (a[:, i - 1, None] != b[:, low - 1 : high])
        best = np.minimum(changed, row[:, low : high + 1] + 1)
        for j in range(low, high + 1):
            new[:, j] = np.minimum(np.minimum(best[:, j - low], new[:, j - 1] + 1), far)
        row = new
    return row[:, length]


class Benchmark:
    """One block of items, by length."""

    def __init__(self, items: list[tuple[int, str | None]], tolerance: float, recall: float, passages: bool = False):
        vocabulary: dict[str, int] = defaultdict()
        vocabulary.default_factory = lambda: len(vocabulary) + 1
        by_length = defaultdict(list)
        for number, (_, text) in enumerate(items):
            if words := words_of(text):
                by_length[len(words)].append((number, [vocabulary[w] for w in words]))
        vocabulary.default_factory = None
        self.vocabulary = dict(vocabulary)
        self.ids = [i for i, _ in items]
        occurs = np.bincount(np.concatenate([np.zeros(0, np.int64), *(sorted(set(w)) for v in by_length.values() for _, w in v)]).astype(np.int64), minlength=len(vocabulary) + 1)
        rare = occurs <= max(1, RARE * len(items))
        rare[0] = False
        self.sized = [
            (Sized if k <= LONGEST else Parted)(k, math.floor(tolerance * k), recall, np.array([w for _, w in v]), [n for n, _ in v], rare, passages) for k, v in sorted(by_length.items())
        ]
        self.fill = max([s.slack for s in self.sized], default=0)

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """For each text and item found in it: their numbers, first word of the nearest passage (the first of these), its words, its distance."""
        number, fill = self.vocabulary.get, [0] * self.fill
        cut = [[number(w, 0) for w in words_of(t)] + fill for t in texts]
        ends = np.cumsum([0, *map(len, cut)])
        words = np.fromiter(chain.from_iterable(cut), np.int32, ends[-1])
        document = np.repeat(np.arange(len(cut)), np.diff(ends))
        before = np.arange(len(words)) - ends[document]
        left = ends[1:][document] - self.fill - np.arange(len(words))
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for sized in self.sized:
            for begins, items, distances, lengths in sized.matches(words, before, left):
                for start, row, item, edits, length in zip(before[begins].tolist(), document[begins].tolist(), items.tolist(), distances.tolist(), lengths.tolist(), strict=True):
                    found = (edits, start, abs(length - sized.length), length)
                    best[row, item] = min(best.get((row, item), found), found)
        return [(row, item, start, length, edits) for (row, item), (edits, start, _, length) in sorted(best.items())]


def item_blocks(items: DataFrame, tolerance: float, recall: float, id_col: str, text_col: str, passages: bool) -> Iterator[Benchmark]:
    """The items in blocks of about BLOCK_BYTES of text and keys, dealt by a hash of the row."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64 + 12 * ROUND)).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield Benchmark([tuple(r) for r in some.orderBy("id", "text").collect()], tolerance, recall, passages)


def find_leaks(
    docs: DataFrame, items: DataFrame, tolerance: float = 0.1, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    passages: bool = False,
) -> DataFrame:
    """One row per document row and item found in it: ``id_col``, ``item_id``, start, n_words, edits of the nearest passage (the first of these).

    With ``passages`` a passage may have more or fewer words than its item, else it is a window of as many words.
    A null or empty text has no words and leaks nothing; an item without words is never found; an item of k words allows floor(tolerance
    * k) edits, so a very short one must occur as it is. Items with equal words are all reported, as are rows with equal or null ids. Whole
    texts are searched. Other columns are not read. An empty benchmark or empty documents give no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_id, items.schema[item_id].dataType),
        T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("edits", T.IntegerType()),
    ])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out, waiting = spark.createDataFrame([], schema), None
    for benchmark in item_blocks(items, tolerance, recall, item_id, item_text, passages):
        if waiting:  # more than one block: the results of the last one are written, and it is taken back
            out = out.union(written(waiting[0], "leaks"))
            waiting[1].destroy()
        sent = spark.sparkContext.broadcast(benchmark)
        waiting = source.mapInArrow(_finder(sent, schema), schema), sent
    return out.union(waiting[0]) if waiting else out


def _finder(sent, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = sent.value
        for part in text_blocks(batches, "text"):
            found = benchmark.leaks(part.column("text").to_pylist())
            row, item, start, words, edits = zip(*found, strict=True) if found else ([],) * 5
            columns = [part.column("id").take(pa.array(row, pa.int64())), pa.array([benchmark.ids[i] for i in item], arrow.field(1).type), pa.array(start, pa.int32()), pa.array(words, pa.int32()), pa.array(edits, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, tolerance: float = 0.1, recall: float = 0.99, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", passages: bool = False) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged; see ``find_leaks``."""
    spark, last = docs.sparkSession, None
    for benchmark in item_blocks(items, tolerance, recall, item_id, item_text, passages):
        if last:  # what a block leaves is written before the next one is sent
            docs = written(docs, "clean")
            last.destroy()
        last = sent = spark.sparkContext.broadcast(benchmark)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in text_blocks(batches, text_col):
                found = {x[0] for x in sent.value.leaks(part.column(text_col).to_pylist())}
                yield part.filter(pa.array([i not in found for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
