import random

import numpy as np
import pytest
from common import ODD, docs_frame, prose, words

from courtside.llm.substrings import pack, remove_repeats, unpack, window_hashes


def brute(rows, k):
    """Removed word positions of every row."""
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, np.inf), np.inf if i is None else i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (np.inf if i is None else i):
                gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    shared = [prose(s, 9, 1000) for s in range(4)]
    rows = [(i, " ".join(r.choice([prose(1000 + i * 7 + j, r.randrange(1, 12), 500), *shared]) for j in range(r.randrange(0, 6)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(7, rows[7][1]), (None, rows[9][1]), (None, shared[0]), (200, prose(5, 3000, 6)), (201, prose(5, 3000, 6))]
    return rows


@pytest.mark.parametrize("batch_words", [40, 600_000])
def test_against_brute_force(spark, batch_words):
    rows = corpus()
    got = remove_repeats(docs_frame(spark, rows), window=5, batch_words=batch_words).collect()
    assert sorted(((r["doc_id"], r["repeats"]["n_words"], r["repeats"]["n_removed"], " ".join(words(r["text"]))) for r in got), key=str) == brute(rows, 5)


def test_spans_are_maximal_and_texts_keep_their_spacing(spark):
    rows = [(1, "a b c d e f"), (2, "x\n\na b  c d\ty  z"), (3, "a b c q c d e")]
    got = {r["doc_id"]: r for r in remove_repeats(docs_frame(spark, rows), window=3).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["repeats"]["spans"] == []
    assert got[2]["text"] == "x\n\ny  z" and [tuple(s) for s in got[2]["repeats"]["spans"]] == [(1, 5)]
    assert got[3]["text"] == "q " and [tuple(s) for s in got[3]["repeats"]["spans"]] == [(0, 3), (4, 7)]


def test_nulls_extra_columns_and_empty_tables(spark):
    df = docs_frame(spark, [(1, None), (2, ""), (None, None)], extra=True)
    got = remove_repeats(df).collect()
    assert sorted(str(r["text"]) for r in got) == ["", "None", "None"] and all(r["repeats"]["n_words"] == 0 and r["n_words"] == "x9" and r["_batch"] == "x10" for r in got)
    assert remove_repeats(docs_frame(spark, [])).count() == 0


def test_packing_and_rolling():
    r = np.random.default_rng(1)
    for n in (1, 2, 500):
        for top in (1 << 20, 1 << 63):
            v = np.sort(r.integers(0, top, n).astype(np.uint64))
            assert (unpack(pack(v), n) == v).all()
    w = r.integers(0, 1 << 62, 40).astype(np.uint64)
    w[20:30] = w[0:10]
    h = window_hashes(w, 10)
    assert h[0] == h[20] and len(set(h.tolist())) == len(h) - 1
    assert set(window_hashes(w[5:], 10).tolist()) <= set(h.tolist())  # the same wherever a window stands
