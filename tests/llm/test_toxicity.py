import random

import numpy as np
import pyarrow as pa
from common import ODD, docs_frame, prose

from courtside.llm import toxicity as x

BAD = ["vile", "rotten", "wretch"]


def corpus(n=900, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, r.randrange(20, 150), 400).split()
        toxic = i % 6 == 0
        for _ in range(r.randrange(3, 8) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) if r.random() < 0.7 else r.choice(["skumo", "skumer", "Skuming,", f"skum{r.randrange(99)}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_words_and_contexts():
    words, before, first = x.expressions(pa.array(["One, two!", None, "", "one TWO three", "é x"]))
    assert first.tolist() == [0, 2, 2, 2, 5, 7]
    assert words[0] == words[2] and words[1] == words[3] and len(set(words.tolist())) == 5
    assert before[0] == before[2] == before[5] == x.START and before[1] == words[0] and before[6] == words[5]
    assert (words[0] >> np.uint64(32)) == int.from_bytes(b"one\0", "big")


def test_held_out(spark):
    rows, labels = corpus()
    docs, known = docs_frame(spark, rows), spark.createDataFrame([v for v in labels if v[0] % 4], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in x.score_toxicity(docs, known).collect()}
    held = [(i, t) for i, t in labels if i % 4 == 0]
    assert sum((got[i] >= 0.7) == bool(t) for i, t in held) >= 0.95 * len(held)
    assert sum(got[i] >= 0.7 for i, t in held if not t) <= 0.01 * len(held)
    new = docs_frame(spark, [(1, prose(5000, 60, 400)), (2, prose(5000, 60, 400) + " skumness skumy skumest skuma skumb"), (3, "VILE wretch " + prose(5001, 20, 400))])
    score = {r["doc_id"]: r["score"] for r in x.score_toxicity(docs.union(new.selectExpr("doc_id + 10000", "text")), known).where("doc_id > 10000").collect()}
    assert score[10001] < 0.7 <= min(score[10002], score[10003])  # beginnings carry over to words never seen


def test_blocks_of_terms_add_up(spark, monkeypatch):
    rows, labels = corpus(400)
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    whole = {r["doc_id"]: r["ratio"] for r in x.score_toxicity(docs, known).collect()}
    monkeypatch.setattr(x, "BLOCK_TERMS", 3)
    parts = {r["doc_id"]: r["ratio"] for r in x.score_toxicity(docs, known).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-6 for i in whole) and any(whole.values())


def test_counts_against_brute_force(spark):
    rows, labels = corpus(60)
    counts = x.count_expressions(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"), "toxic", "doc_id", "text").collect()
    truth, pairs = dict(labels), {}
    for i, text in rows:
        w, b, _ = x.expressions(pa.array([text]))
        for key in set(zip(b.view(np.int64).tolist(), w.view(np.int64).tolist(), strict=True)):
            pairs.setdefault(key, [0, 0])[truth[i]] += 1
    got = {(r["h"], r["w"]): [r["plain"], r["toxic"]] for r in counts if r["kind"] == x.PAIR}
    assert got == {k: v for k, v in pairs.items() if sum(v) >= x.GATE.rare}
    contexts = {}
    for (_, w), (plain, toxic) in pairs.items():
        c = contexts.setdefault(w, [0, 0])
        c[0] += plain > 0
        c[1] += toxic > 0
    assert {r["w"]: [r["plain"], r["toxic"]] for r in counts if r["kind"] == x.WORD} == contexts


def test_odd_rows(spark):
    rows, labels = corpus(200)
    odd = [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1]), (None, "vile"), (2000, "vile " * 100_000)]
    out = x.score_toxicity(docs_frame(spark, rows + odd, extra=True), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["ratio"] for r in out if r["doc_id"] in (1000, 1001, 1002, 1003)} == {0.0}
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in x.score_toxicity(docs_frame(spark, rows[:2]), none).collect()] == [0.5, 0.5]
    assert x.score_toxicity(docs_frame(spark, []), spark.createDataFrame(labels, none.schema)).count() == 0


def test_many_labels_are_shuffled(spark, monkeypatch):
    from courtside.llm import labelled

    rows, labels = corpus(120)
    docs, known = docs_frame(spark, [*rows, (None, "x"), (5, "again")]), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sent = sorted(map(tuple, labelled.labelled(docs, known, "toxic").collect()))
    monkeypatch.setattr(labelled, "SENT_ROWS", 1)
    assert sent == sorted(map(tuple, labelled.labelled(docs, known, "toxic").collect())) and len(sent) == 121


def twin(pairs, gate):
    """Terms of the models by the formulas, in plain Python: pairs -> documents of (plain, toxic) that have them."""
    import math
    from collections import defaultdict

    sides = (1, 0)  # toxic, plain
    word, uses, kinds = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, w), n in pairs.items():
        for c in sides:
            word[w][c] += n[c] > 0
            uses[h][c] += n[c]
            kinds[h][c] += n[c] > 0
    total = [sum(v[c] for v in word.values()) for c in (0, 1)]
    pair_total = [sum(v[c] for v in uses.values()) for c in (0, 1)]

    def discount(counts):
        one, two = counts.count(1), counts.count(2)
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5

    low = [discount([v[c] for v in word.values()]) for c in (0, 1)]
    high = [discount([v[c] for v in pairs.values()]) for c in (0, 1)]
    n_kinds = [sum(v[c] > 0 for v in word.values()) for c in (0, 1)]

    def specific(n, totals):
        q = totals[1] / sum(totals)
        g = 2 * sum(n[c] * math.log(n[c] / (sum(n) * (q if c else 1 - q))) for c in sides if n[c])
        rate = (n[1] + 0.5) / totals[1] / ((n[0] + 0.5) / totals[0])
        return sum(n) >= gate.rare and g >= gate.chance - 1e-9 and (rate >= gate.factor or rate <= 1 / gate.factor)

    stem = lambda w: (w & (1 << 64) - 1) >> 32
    stems = defaultdict(lambda: [0, 0])
    for w, n in word.items():
        for c in sides:
            stems[stem(w)][c] += n[c]
    lift = {}
    for s, n in stems.items():
        if specific(n, total):
            base = sum(n) / sum(total)
            lift[s] = [(max(n[c] - low[c], 0) / total[c] + low[c] * n_kinds[c] / total[c] * base) / base for c in (0, 1)]
    terms, p = {(x.STEM, 0, s): math.log(v[1]) - math.log(v[0]) for s, v in lift.items()}, {}
    for w, n in word.items():
        shared = (sum(n) + 0.5) / (sum(total) + 0.5 * (len(word) + 1))
        up = lift.get(stem(w), [1.0, 1.0])
        below = [shared * up[c] for c in (0, 1)]
        p[w] = [max(n[c] - low[c], 0) / total[c] + low[c] * n_kinds[c] / total[c] * below[c] for c in (0, 1)] if specific(n, total) else below
        terms[x.WORD, 0, w] = math.log(p[w][1] / p[w][0]) - math.log(up[1] / up[0])
    for (h, w), n in pairs.items():
        if sum(n) >= gate.rare and specific(n, pair_total):
            q = [(max(n[c] - high[c], 0) + high[c] * kinds[h][c] * p[w][c]) / uses[h][c] if uses[h][c] else p[w][c] for c in (0, 1)]
            terms[x.PAIR, h, w] = math.log(q[1] / q[0]) - math.log(p[w][1] / p[w][0])
    return {k: v for k, v in terms.items() if abs(v) > 1e-6}


def test_model_terms_against_the_formulas(spark):
    rows, labels = corpus(80, seed=6)
    truth, pairs = dict(labels), {}
    for i, text in rows:
        w, b, _ = x.expressions(pa.array([text]))
        for key in set(zip(b.view(np.int64).tolist(), w.view(np.int64).tolist(), strict=True)):
            pairs.setdefault(key, [0, 0])[truth[i]] += 1
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    for gate in (x.GATE, x.PLAIN, x.Gate(2, 3.0, 2.0)):
        counts = x.count_expressions(docs_frame(spark, rows), known, "toxic", "doc_id", "text", gate)
        got = {(r["kind"], r["h"], r["w"]): r["value"] for r in x.model_terms(counts, gate).collect()}
        want = twin(pairs, gate)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert len(got) > (1000 if gate == x.PLAIN else 0)


def test_only_the_sample_of_the_curve_is_not_counted(spark, monkeypatch):
    rows, labels = corpus(300)
    seen = []
    monkeypatch.setattr(x, "CALIBRATED", 5)
    original = x.count_expressions
    monkeypatch.setattr(x, "count_expressions", lambda docs, known, *a: (seen.append(known.count()), original(docs, known, *a))[1])
    x.score_toxicity(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count()
    assert seen == [290]
