"""Encoding and decoding with merge-type sentencepiece vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the piece that they would form (highest first, then the
leftmost) and merges until no pair forms a piece; symbols that are no piece become byte pieces. Texts are cut into stretches that no
piece can span, so that each distinct stretch passes through the agenda once while a worker remembers it. Short stretches keep their
agendas as rows of one matrix and merge side by side, long ones use a heap. Every stretch that passes through the agenda is compared
with the sentencepiece library before its ids are used, batch by batch.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from courtside.llm.blocks import text_blocks

SPACE = "▁"
CACHED = 350_000  # stretches in each of the two generations that a worker remembers
SHORT = 32  # symbols of a stretch whose agenda is a matrix row
NEVER = np.int32(1 << 30)
NUMBER = np.int32  # of a piece


def _one_mark_per_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_mark_per_byte", _one_mark_per_byte)


class Vocabulary:
    """A merge-type model file of the library, read through the library's own accessors."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(lib.get_piece_size())
        special = {i for i in ids if lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i)}
        self.bytes_from = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        self.id_of = {lib.id_to_piece(i): i for i in ids if i not in special and not lib.is_byte(i)}
        self.score_of = {piece: lib.get_score(i) for piece, i in self.id_of.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        if len(self.bytes_from) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        joined = {c for piece in self.id_of if len(piece) > 1 for c in piece} - {SPACE}
        letters = re.escape("".join(sorted(joined)))
        if any(SPACE in piece.lstrip(SPACE) for piece in self.id_of):  # pieces across words: nothing can be cut there
            self.stretch = re.compile(f"[ {letters}]+|.", re.DOTALL)
        else:
            self.stretch = re.compile(f" *[{letters}]+| +|.", re.DOTALL)
        self.special = special - {self.unknown}
        self.lead = {i for piece, i in self.id_of.items() if piece.startswith(SPACE)}
        self._pair_table()
        self.out = [b"" if i in special else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for value, i in self.bytes_from.items():
            self.out[i] = bytes([value])
        self.out[self.unknown] = " ⁇ ".encode()

    def _pair_table(self) -> None:
        """Sorted pairs of pieces that form a piece, that piece, and the rank of its score (equal scores share a rank)."""
        size, pairs = self.library.get_piece_size(), {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.formed = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        order = {s: r for r, s in enumerate(sorted(set(self.score_of.values()), reverse=True))}
        rank = np.full(size, NEVER, np.int32)
        for piece, i in self.id_of.items():
            rank[i] = order[self.score_of[piece]]
        self.rank = rank[self.formed]
        self._fill_slots()
        self.id_of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.id_of_char[ord(piece)] = i

    def _fill_slots(self) -> None:
        """The pairs as a hash table: a pair that finds its slot taken stands in one of the slots behind it."""
        bits = int(len(self.pairs)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        home = self._home(self.pairs)
        self.slot = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_pair = np.full(len(self.slot), -1, np.int64)
        waiting, self.behind = np.arange(len(self.pairs)), 0
        while len(waiting):
            at = home[waiting] + self.behind
            free = np.flatnonzero(self.slot[at] < 0)
            put, first = np.unique(at[free], return_index=True)
            self.slot[put] = waiting[free[first]]
            self.slot_pair[put] = self.pairs[self.slot[put]]
            waiting = np.setdiff1d(waiting, self.slot[put])
            self.behind += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of adjacent symbols; NEVER where they form none."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.library.get_piece_size() + b, -2)
        rank, formed = np.full(key.shape, NEVER, np.int32), np.full(key.shape, -1, np.int32)
        key, rank_, formed_ = key.ravel(), rank.reshape(-1), formed.reshape(-1)
        at = self._home(key)
        open_ = None  # at first all
        for step in range(self.behind):
            here, wanted = (at + step, key) if open_ is None else (at[open_] + step, key[open_])
            there = self.slot_pair[here]
            hit = np.flatnonzero(there == wanted)
            rows, pair = (hit if open_ is None else open_[hit]), self.slot[here[hit]]
            rank_[rows], formed_[rows] = self.rank[pair], self.formed[pair]
            more = np.flatnonzero((there != wanted) & (there >= 0))
            open_ = more if open_ is None else open_[more]
            if not len(open_):
                break
        return rank, formed

    def merge_all(self, stretches: list[str]) -> list[list[int]]:
        """Ids of every stretch."""
        out: list[list[int]] = [[]] * len(stretches)
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for low, high in ((1, 1), (2, 6), (7, 10), (11, 16), (17, SHORT)):
            rows = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                for row, ids in zip(some.tolist(), self._merge_rows([stretches[r] for r in some.tolist()], high), strict=True):
                    out[row] = ids
        for row in np.flatnonzero(lengths > SHORT).tolist():
            out[row] = self.merge(stretches[row])
        return out

    def _merge_rows(self, stretches: list[str], width: int) -> list[list[int]]:
        """The agendas of short stretches as rows of a matrix: in each round every row merges its best pair."""
        n = len(stretches)
        chars = np.array(stretches, f"U{width}").view(np.uint32).reshape(n, width)
        lengths = np.fromiter(map(len, stretches), np.int64, n)
        symbols = np.where(np.arange(width) < lengths[:, None], self.id_of_char[chars], -2).astype(np.int32)
        odd = (symbols == -1).any(1)  # characters that are no piece become byte pieces
        result: list[list[int]] = [[]] * n
        if width > 1:
            agenda, formed = self._look_up(symbols[:, :-1], symbols[:, 1:])
            agenda = np.concatenate([agenda, np.full((n, 1), NEVER, np.int32)], 1)
            formed = np.concatenate([formed, np.full((n, 1), -1, np.int32)], 1)
            live, column = np.arange(n), np.arange(width)
            work = symbols
            while len(live):
                best = agenda.argmin(1)
                going = agenda[np.arange(len(live)), best] < NEVER
                if not going.all():
                    symbols[live[~going]] = work[~going]
                    live, best, agenda, formed, work = live[going], best[going], agenda[going], formed[going], work[going]
                    if not len(live):
                        break
                row = np.arange(len(live))
                piece = formed[row, best]
                after = column + (column > best[:, None])  # what stands right of the pair moves one place left
                last = after >= width
                after = np.minimum(after, width - 1)
                work = np.where(last, -2, np.take_along_axis(work, after, 1))
                agenda = np.where(last, NEVER, np.take_along_axis(agenda, after, 1))
                formed = np.where(last, -1, np.take_along_axis(formed, after, 1))
                work[row, best] = piece
                right = np.where(best + 1 < width, work[row, np.minimum(best + 1, width - 1)], -2)
                agenda[row, best], formed[row, best] = self._look_up(piece, right)
                left = best > 0
                agenda[row[left], best[left] - 1], formed[row[left], best[left] - 1] = self._look_up(work[row[left], best[left] - 1], piece[left])
        kept = (symbols != -2).sum(1).tolist()
        for i, (ids, k) in enumerate(zip(symbols.tolist(), kept, strict=True)):
            result[i] = ids[:k]
        for i in np.flatnonzero(odd).tolist():
            result[i] = self.merge(stretches[i])
        return result

    def merge(self, stretch: str) -> list[int]:
        """Ids of a stretch by the agenda of adjacent pairs."""
        symbols: list[str | None] = list(stretch)
        n = len(symbols)
        if n == 1:
            return self._ids(stretch)
        score = self.score_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score[p], i, i + 1, p) for i in range(n - 1) if (p := stretch[i : i + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(piece):
                continue  # a part of this pair has been merged meanwhile
            symbols[left], symbols[right] = piece, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if (p := piece + symbols[nxt]) in score:
                    heapq.heappush(agenda, (-score[p], left, nxt, p))
            prev = before[left]
            if prev >= 0 and (p := symbols[prev] + piece) in score:
                heapq.heappush(agenda, (-score[p], prev, left, p))
        return [i for s in symbols if s is not None for i in self._ids(s)]

    def _ids(self, symbol: str) -> list[int]:
        found = self.id_of.get(symbol)
        return [found] if found is not None else [self.bytes_from[b] for b in symbol.encode()]

    def stretches(self, text: str) -> list[str]:
        """The text with a leading space, cut where no piece can span. Space marks stand as spaces: in Latin texts these take half the memory."""
        return self.stretch.findall(" " + text.replace(SPACE, " ")) if text else []

    def decode(self, ids: list[int]) -> str:
        """As the library: the first space mark goes, bytes that form no character become one mark each."""
        while ids and ids[-1] in self.special:
            ids = ids[:-1]
        if not self.special.isdisjoint(ids):  # byte pieces on both sides of a control piece form no character
            cut = [i for i, x in enumerate(ids) if x in self.special]
            runs = [ids[a + 1 : b] for a, b in zip([-1, *cut], [*cut, len(ids)], strict=True)]
        else:
            runs = [ids]
        text = "".join([b"".join(map(self.out.__getitem__, r)).decode("utf-8", "one_mark_per_byte") for r in runs])
        first = next((r[0] for r in runs if r), None)
        return text[1:] if first in self.lead else text


class Encoder:
    """Ids of stretches, remembered as packed numbers; new ones are compared with the library."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Packed ids of stretches that the younger memory doesn't hold."""
        fresh = {s: ids for s in missing if (ids := self.older.get(s)) is not None}
        new = [s for s in missing if s not in fresh]
        marked = [s.replace(" ", SPACE) for s in new]
        own = self.vocabulary.merge_all(marked)
        flat, ends = np.fromiter(chain.from_iterable(own), NUMBER), np.cumsum([0, *map(len, own)])
        self._compare(marked, own, flat, ends)
        packed, width = flat.tobytes(), NUMBER().itemsize
        cuts = (ends * width).tolist()
        fresh.update(zip(new, [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        if len(self.known) + len(fresh) > CACHED:
            self.older, self.known = self.known, {}
        self.known.update(fresh)
        return fresh

    def _compare(self, new: list[str], own: list[list[int]], flat: np.ndarray, ends: np.ndarray) -> None:
        """The library puts a space mark before what it encodes: it stands for the stretch's own, or before a line break that is cut off again."""
        library, start = self.vocabulary.library, [self.vocabulary.id_of[SPACE], self.vocabulary.bytes_from[10]]
        led = [i for i, s in enumerate(new) if s[0] == SPACE and s != SPACE]
        rest = [i for i, s in enumerate(new) if s[0] != SPACE]
        for rows, before, texts in ((led, [], [new[i][1:] for i in led]), (rest, start, ["\n" + new[i] for i in rest])):
            if not rows:
                continue
            theirs = library.encode(texts, num_threads=1)
            rows, sizes = np.array(rows), np.fromiter(map(len, theirs), np.int64, len(theirs))
            all_theirs, k = np.fromiter(chain.from_iterable(theirs), NUMBER, int(sizes.sum())), len(before)
            begin = np.cumsum(sizes) - sizes
            ours = ends[rows + 1] - ends[rows]
            good = bool((sizes == ours + k).all())
            if good:
                step = np.arange(int(ours.sum())) - np.repeat(np.cumsum(ours) - ours, ours)
                good = bool((all_theirs[np.repeat(begin + k, ours) + step] == flat[np.repeat(ends[rows], ours) + step]).all())
                good = good and all((all_theirs[begin + j] == before[j]).all() for j in range(k))
            if not good:
                i, ids = next((i, x) for i, x in zip(rows.tolist(), theirs, strict=True) if before + own[i] != x)
                raise ValueError(f"{new[i]!r} gives {own[i]}, the library gives {ids}")

    def rest(self) -> None:
        """Gives back the older memory between tasks."""
        self.older = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = list(map(self.vocabulary.stretches, texts))
        flat = list(chain.from_iterable(cut))
        found = list(map(self.known.get, flat))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            fresh = self.learn({flat[i] for i in at})
            for i in at:
                found[i] = fresh[flat[i]]
        end, ends = NUMBER(self.vocabulary.end).tobytes(), np.cumsum([0, *map(len, cut)]).tolist()
        return [np.frombuffer(b"".join([*found[a:b], end]), NUMBER) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(model_file: str) -> Encoder:
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(Vocabulary(model_file))
    return _ENCODERS[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` (end id last) and ``decoded``, the text that these ids decode to.

    A null or empty text has the end id only and decodes to an empty text. Ids may repeat or be null; each row is treated by itself.
    Other columns are not read. ``model_file`` must exist on every machine. A text larger than a block is encoded alone.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_file)
        for part in text_blocks(batches, "text"):
            ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            decoded = [encoder.vocabulary.decode(x.tolist()) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
        encoder.rest()

    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
