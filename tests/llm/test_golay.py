import random

import numpy as np
import pytest
import xxhash
from common import ODD, docs_frame, prose, words

from courtside.llm import golay
from courtside.llm.components import components, forest


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("bits", range(5))
def test_keys_miss_nothing(bits):
    r = np.random.default_rng(bits)
    a = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, bits, replace=False)) for _ in range(len(a))], np.uint64)
    sides = [set(zip(*(x.tolist() for x in golay.keys_of((v).view(np.int64))), strict=True)) for v in (a, a ^ flips)]
    assert {row for row, _ in sides[0] & sides[1]} == set(range(len(a)))


def test_code_is_perfect():
    _, patterns = golay.code_tables()
    assert sorted(np.unique((patterns >= 0).sum(1), return_counts=True)[1].tolist()) == [277, 1771]


def test_documents_against_brute_force(spark):
    r = random.Random(4)
    texts = [prose(i, r.randrange(1, 90), 60) for i in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:15] + [t.upper() for t in texts[30:35]]
    rows = list(enumerate(texts)) + [(500 + i, t) for i, t in enumerate(ODD)]
    got = {x["doc_id"]: x for x in golay.near_duplicates(docs_frame(spark, rows, extra=True)).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert {i: got[i]["component_id"] for i, _ in rows} == brute_components([i for i, _ in rows], prints, 4)


def test_dense_groups_and_chains(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(golay, "COMPARED", 7)
    centre = r.getrandbits(64)
    members = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 7))) for _ in range(150)}
    members |= {r.getrandbits(64) for _ in range(20)}
    v = np.array(sorted(members), np.uint64)
    a, b = golay.linked(v, 4)
    node, root = forest(a, b)
    found = dict(zip(v.tolist(), v.tolist(), strict=True)) | dict(zip(node.tolist(), root.tolist(), strict=True))
    assert found == brute_components(v.tolist(), v.tolist(), 4) and len(a) < len(v)


def test_repeated_and_missing_ids(spark):
    text = prose(1, 30)
    got = golay.near_duplicates(docs_frame(spark, [(3, text), (3, text), (None, text), (9, prose(2, 30)), (None, prose(3, 30))])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("9", "9"), ("None", "3"), ("None", "None")]
    assert golay.near_duplicates(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        golay.near_duplicates(docs_frame(spark, []), max_bits=5)


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)] + [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(40)] + [(None, 1), (5, 5)]
    r.shuffle(edges)
    nodes = sorted({x for e in edges for x in e if x is not None})
    parent = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {x["node"]: x["root"] for x in components(df, "a", "b").collect()}
    assert {n: got.get(n, n) for n in nodes} == parent


def test_large_keys_are_compared_by_blocks():
    from courtside.llm.golay import linked, linked_large

    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(600)]
    members = np.unique(centres[rng.integers(0, 40, 600)] ^ np.array(flips, np.uint64))

    def groups(links):
        root = {int(m): int(m) for m in members}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*(x.tolist() for x in links), strict=True):
            assert (a ^ b).bit_count() <= 4
            root[find(a)] = find(b)
        out = {}
        for m in members.tolist():
            out.setdefault(find(m), set()).add(m)
        return sorted(map(sorted, out.values()))

    assert groups(linked_large(members, 4)) == groups(linked(members, 4))
