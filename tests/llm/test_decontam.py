import random

import numpy as np
import pytest
from common import ODD, docs_frame, prose

from courtside.llm import decontam
from courtside.llm.decontam import Benchmark, drop_leaks, edit_distance, find_leaks, words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(words, edits, r):
    words = list(words)
    for _ in range(edits):
        kind, at = r.randrange(3), r.randrange(len(words))
        if kind == 0:
            words[at] = "zz"
        elif kind == 1 and len(words) > 1:
            words.pop(at)
        else:
            words.insert(at, "yy")
    return words


def brute(docs, items, tolerance):
    out = set()
    for i, text in docs:
        d = words_of(text)
        for k, item in items:
            w = words_of(item)
            most = int(tolerance * len(w))
            near = [(distance(d[s : s + len(w)], w), s) for s in range(len(d) - len(w) + 1)] if w else []
            if near and min(near)[0] <= most:
                out.add((i, k, min(near)[1], len(w), min(near)[0]))
    return out


def benchmark():
    return [(i, prose(i, n, 300)) for i, n in enumerate([14, 20, 20, 35, 48, 59])] + [(6, "one two three"), (7, ""), (8, None), (9, "!!!"), (10, "one two three")]


def test_edit_distance():
    r = np.random.default_rng(1)
    a, b = r.integers(1, 6, (200, 12)), r.integers(1, 6, (200, 12))
    got = edit_distance(a, b, 5)
    assert got.tolist() == [min(distance(x, y), 6) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_against_brute_force(spark):
    r, items = random.Random(5), benchmark()
    docs = [(i, t) for i, t in enumerate(ODD)] + [(90, "One, two THREE"), (91, "one two"), (None, items[3][1])]
    for n in range(120):
        words = words_of(items[n % 6][1])
        most = int(0.1 * len(words))
        inside = edited(words, r.choice([0, 0, 1, most, most + 2]), r)
        docs.append((100 + n, prose(n, r.randrange(0, 60), 400) + " " + " ".join(inside).upper() + ". " + prose(n + 1, r.randrange(0, 60), 400)))
    docs += [(300, prose(300, 400, 300)), (301, "w1 " * 500), (302, items[5][1] + " " + items[5][1])]
    got = {tuple(x) for x in find_leaks(docs_frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id bigint, text string"), tolerance=0.1).collect()}
    want = brute(docs, items, 0.1)
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    exact = {x for x in want if x[4] == 0}
    assert exact <= got and len(got & want) >= 0.97 * len(want) and len(want) > 80
    kept = drop_leaks(docs_frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id bigint, text string"), tolerance=0.1)
    found = {x[0] for x in got}
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(i) for i, _ in docs if i not in found)


def test_recall_at_the_largest_distance():
    r = random.Random(9)
    items = [(i, prose(1000 + i, r.randrange(20, 60), 2000)) for i in range(40)]
    found = tried = 0
    known = Benchmark(items, 0.1, 0.99)
    for i, text in items * 5:
        words = words_of(text)
        changed = [w if n not in set(r.sample(range(len(words)), int(0.1 * len(words)))) else "zz" for n, w in enumerate(words)]
        if distance(changed, words) <= int(0.1 * len(words)):
            tried += 1
            found += any(x[1] == i for x in known.leaks([" ".join(changed)]))
    assert found >= 0.98 * tried > 0


def nearest_passage(document, item, most):
    """(edits, start) of the passage nearest to the item, of any length."""
    d, w = words_of(document), words_of(item)
    return min((distance(d[s : s + n], w), s) for n in range(max(1, len(w) - most), len(w) + most + 1) for s in range(max(1, len(d) - n + 1)))


def test_passages_with_words_dropped_and_put_in(spark):
    r, items = random.Random(11), [(i, prose(50 + i, n, 900)) for i, n in enumerate([10, 14, 19, 20, 26, 35, 48, 59])]
    docs, want = [], {}
    for n in range(96):
        k, text = items[n % 8]
        words, most = words_of(text), len(words_of(text)) // 10
        for _ in range(most + (n % 5 == 4)):
            at = r.randrange(len(words))
            words[at : at + (n // 8 % 4 != 1)] = [[], ["zz"], ["zz"], []][n // 8 % 4]
        around = [prose(n * 2 + i, r.choice([0, 0, 3, 12]), 900) for i in (0, 1)]
        docs.append((n, " ".join([around[0], *words, around[1]])))
        edits, start = nearest_passage(docs[-1][1], text, most)
        if edits <= most:
            want[n, k] = (edits, start)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in find_leaks(docs_frame(spark, docs), frame, tolerance=0.1, passages=True).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 70
    for (n, k), x in got.items():
        passage = words_of(docs[n][1])[x["start"] : x["start"] + x["n_words"]]
        assert len(passage) == x["n_words"] and distance(passage, words_of(items[k][1])) == x["edits"] and (x["edits"], x["start"]) == want[n, k]
    kept = drop_leaks(docs_frame(spark, docs), frame, tolerance=0.1, passages=True)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({n for n, _ in docs} - {n for n, _ in got})


def test_recall_does_not_fall_with_the_number_of_items():
    r = random.Random(21)
    items = [(i, " ".join(f"w{r.randrange(30_000)}" for _ in range(20))) for i in range(6000)]
    for passages in (False, True):
        known = Benchmark(items, 0.1, 0.99, passages)
        found, tried = 0, r.sample(items, 1500)
        texts = []
        for n, (_, text) in enumerate(tried):
            words = words_of(text)
            for at in sorted(r.sample(range(20), 2), reverse=True):
                words[at : at + 1] = [] if passages and n % 2 else ["zz"]
            texts.append(" ".join(words))
        found = {(x[0], x[1]) for x in known.leaks(texts)}
        assert sum((n, i) in found for n, (i, _) in enumerate(tried)) >= 0.98 * len(tried)


def test_short_items_and_a_recall_out_of_reach(monkeypatch):
    assert [x[:2] for x in Benchmark([(1, "one two three")], 0.1, 0.99, True).leaks(["zero one two three", "one two"])] == [(0, 0)]
    monkeypatch.setattr(decontam, "ROUND", decontam.WALKS)
    items = [(i, prose(i, 59, 3000)) for i in range(20)]
    known = Benchmark(items, 0.1, 0.99, True)
    assert len(known.sized[0].keys) > decontam.ROUND and len(known.leaks([items[3][1]])) == 1
    # where the repetitions don't reach the recall, every window with enough words is checked, which finds all
    monkeypatch.setattr(decontam, "MOST_ROUNDS", 0)
    r, texts = random.Random(4), []
    for n, (_, text) in enumerate(items):
        words = words_of(text)
        for _ in range(5):
            at = r.randrange(len(words))
            words[at : at + (n % 3 != 1)] = [[], ["zz"], ["zz"]][n % 3]
        texts.append(" ".join(words))
    exact = Benchmark(items, 0.1, 0.9999, True)
    assert exact.sized[0].keys is None
    assert {(x[0], x[1]) for x in exact.leaks(texts)} == {(n, n) for n in range(20)}


LONG = [5, 161, 300, 1000]


@pytest.mark.parametrize("passages", [True, False])
def test_items_of_any_length(passages):
    """Copies with as many edits as allowed, of each kind, in front, in the middle and at the end of documents."""
    r = random.Random(31)
    items = [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(n))) for i, n in enumerate(LONG * 2)]
    known = Benchmark(items, 0.1, 0.99, passages)
    texts, of, kinds = [], [], []
    for n in range(64 if passages else 16):
        i, kind = n % len(items), n // len(items) % 4
        words = words_of(items[i][1])
        for e in range(len(words) // 10):
            at, do = r.randrange(len(words)), kind if kind < 3 and passages else (0 if not passages else r.randrange(3))
            words[at : at + (do != 2)] = [["zz"], [], ["yy"]][do]
        before, after = (prose(n, r.choice([0, 0, 40]), 900), prose(-n - 1, r.choice([0, 0, 40]), 900))
        texts.append(" ".join([before, *words, after]))
        of.append(i)
        kinds.append(kind)
    found = {(x[0], x[1]): x for x in known.leaks(texts)}
    hit = [(n, i) in found for n, i in enumerate(of)]
    assert np.mean(hit) >= 0.98, [(LONG[i % 4], k) for i, k, h in zip(of, kinds, hit, strict=True) if not h]
    assert set(found) <= set(enumerate(of))
    for (n, i), (_, _, start, length, edits) in found.items():
        passage, item = words_of(texts[n])[start : start + length], words_of(items[i][1])
        assert len(passage) == length and (passages or length == len(item)) and edits <= len(item) // 10
        assert distance(passage, item) == edits
    assert known.leaks([prose(1, 3000, 4000), " ".join(words_of(items[3][1])[:500])]) == []


def test_what_is_sent_stays_small():
    import pickle

    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(50_000)}" for _ in range(n))) for i, n in enumerate([20, 500, 2000, 5000] * 3)]
    known = Benchmark(items, 0.1, 0.99, True)
    assert len(pickle.dumps(known)) < 16 << 20
    assert [x[:2] for x in known.leaks([items[3][1]])] == [(0, 3)]


def test_empty_tables(spark):
    none, items = docs_frame(spark, []), spark.createDataFrame(benchmark(), "item_id bigint, text string")
    assert find_leaks(none, items).count() == 0
    assert find_leaks(docs_frame(spark, [(1, "one two three")]), items.limit(0)).count() == 0
    assert drop_leaks(docs_frame(spark, [(1, "one two three")]), items.limit(0)).count() == 1
