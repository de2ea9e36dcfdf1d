"""Source divergence against plain Python counts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from courtside.llm import divergence
from courtside.llm.divergence import audit_sources, by_source, pieces_of, quoted, texts_of, unquoted

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute(rows, min_docs, prior, top):
    docs = [[t or "" for t in r[1:4]] for r in rows]
    in_docs, groups, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        in_docs[lang].update(set(terms))
        groups[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in in_docs.items()}
    for (lang, _), c in groups.items():
        total[lang].update(c)

    def shares(counts, terms):
        n = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + prior) // (n + prior * len(terms)) for t in terms}

    out = []
    for lang, source in groups:
        terms = kept[lang]
        p, q = shares(groups[lang, source], terms), shares(total[lang], terms)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                r = shares(groups[lang, other], terms)
                pairs.append((-sum(abs(p[t] - r[t]) for t in terms), other.encode()))
        above = sorted((q[t] - p[t], t.encode()) for t in terms if groups[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", above)):
            out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def answer(spark, rows, extra=False, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {c}" for c in ("chunk", "term", "n", "item", "value", "rank", "n_docs", "groups")])
    return sorted(tuple(r) for r in audit_sources(df, **more).collect())


def random_rows(n, seed=3):
    r = random.Random(seed)
    ends = ["", ",", ".", "!", "'s", "-a", "\x00b", "\x7f"]
    rows = []
    for i in range(n):
        words = ["".join(r.choice([str.upper, str.lower, str.title])(r.choice(["ab", "cd", "é", "ßx", "日本", "q"]) * r.randint(1, 2))) + r.choice(ends) for _ in range(r.randint(0, 12))]
        text = r.choice([" ", "\n", "\t", "\xa0", "  "]).join(words)
        rows.append((i, r.choice([text, text, text, None, ""]), r.choice(["en", "de", None]), r.choice(["s1", "s2", "a,b:c%2C", "", None])))
    return rows


@pytest.mark.parametrize("min_docs", [1, 4, 9])
def test_equals_plain_counts(spark, min_docs):
    rows = random_rows(120)
    assert answer(spark, rows * 2, extra=True, min_docs=min_docs, prior=5, top_terms=3) == brute(rows * 2, min_docs, 5, 3)


def test_open_terms_are_looked_up(spark, monkeypatch):
    # "x" is in 4 documents, each chunk of it in at most 2 of them; "y" in 3 documents, though its chunks sum to 5.
    texts = ["x, X y Y, y.", "x, y", "X! Y,", "x."]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    monkeypatch.setattr(divergence, "OPEN_TERMS", 1)
    assert answer(spark, rows, min_docs=4) == brute(rows, 4, 5, 50)
    assert {r[3] for r in answer(spark, rows, min_docs=4) if r[2] == "term"} <= {"x"}


def test_long_and_odd_texts(spark):
    rows = [(1, "a" * 3_000_000 + " b", "en", "s"), (2, "c d " * 1_200_000, "en", "t"), (2, "\x00\x01 1 2 3", "en", "u"), (None, None, None, None)]
    assert answer(spark, rows, min_docs=1) == brute(rows, 1, 5, 50)


def test_no_kept_terms_and_empty(spark):
    rows = [(1, "a", "en", "s"), (2, "b", "en", "t")]
    assert answer(spark, rows, min_docs=30) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert answer(spark, [], min_docs=1) == []


def test_many_sources_of_one_chunk_are_shortened(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LONG", 8)
    rows = random_rows(80, seed=5)
    assert answer(spark, rows, min_docs=2) == brute(rows, 2, 5, 50)


def test_helpers():
    import numpy as np
    import pyarrow as pa

    text = b"ab " * 3_000_000
    assert b" ".join(pieces_of(text)).split() == text.split()
    odd = ["a,b", "c:d%", "%2C", ""]
    assert [unquoted(quoted(s)) for s in odd] == odd
    texts = pa.array([",".join(texts_of(pa.array(["s", "t", "s"]), np.array([1, 2, 3])).to_pylist()), ":4"])
    row, source, n = by_source(texts)
    assert sorted(zip(row.tolist(), source.to_pylist(), n.tolist(), strict=True)) == [(0, "s", 4), (0, "t", 2), (1, "", 4)]
