"""Radius paging and joins against brute force, with crowds, poles and the date line."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtside.operators.radius import radius_page, within_radius

R, RADIUS = 6370986.0, 16093.4


def meters(a, b):
    p1, l1, p2, l2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def scatter(rng, n):
    """A third at one spot, a third crowded in one town, the rest anywhere odd."""
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.33:
            out.append((40.75, -73.99))
        elif kind < 0.66:
            out.append((40.75 + rng.uniform(-0.3, 0.3), -73.99 + rng.uniform(-0.3, 0.3)))
        elif kind < 0.75:
            out.append((rng.uniform(89.8, 90.0), rng.uniform(-180, 180)))
        elif kind < 0.85:
            out.append((rng.uniform(-0.2, 0.2), rng.choice([-1, 1]) * rng.uniform(179.85, 180.0)))
        elif kind < 0.95:
            out.append((rng.uniform(-60.2, -59.9), rng.uniform(20.0, 20.4)))
        else:
            out.append((rng.uniform(-90, 90), rng.uniform(-180, 180)))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    items = [(i, rng.randrange(5), *p) for i, p in enumerate(scatter(rng, 700))] + [(9001, 4, None, 10.0)]
    users = [(i, *p) for i, p in enumerate(scatter(rng, 120))] + [(9002, None, None)]
    schema = "latitude DOUBLE, longitude DOUBLE"
    return items, users, spark.createDataFrame(items, f"item_id BIGINT, score INT, {schema}"), spark.createDataFrame(users, f"user_id BIGINT, {schema}")


def brute(items, users):
    near = {}
    for u in users:
        if u[1] is None:
            continue
        near[u[0]] = [i for i in items if i[2] is not None and meters(u[1:], i[2:]) <= RADIUS]
    return near


def test_pairs_equal_brute_force(world):
    items, users, di, du = world
    got = {(r.user_id, r.item_id) for r in within_radius(di, du).select("user_id", "item_id").collect()}
    want = {(u, i[0]) for u, hits in brute(items, users).items() for i in hits}
    assert got == want


@pytest.mark.parametrize("page,limit", [(1, 10), (2, 7), (1, 300), (3, 1)])
def test_pages_equal_brute_force(world, page, limit):
    items, users, di, du = world
    got = {}
    order = [-F.col("score"), F.col("item_id")]
    for r in radius_page(di, du, order, "item_id", page, limit).collect():
        got.setdefault(r.user_id, []).append((r.position, r.item_id))
    for u, hits in brute(items, users).items():
        ranked = sorted(hits, key=lambda i: (-i[1], i[0]))
        want = [(n + 1, i[0]) for n, i in enumerate(ranked)][(page - 1) * limit : page * limit]
        assert sorted(got.get(u, [])) == want


def test_everywhere_items_join_the_page(world):
    items, users, di, du = world
    extra = di.filter("score = 4")
    got = {}
    for r in radius_page(di.filter("score < 3"), du, [F.col("item_id")], "item_id", 1, 12, extra=extra).collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    anywhere = [i[0] for i in items if i[1] == 4]
    near = brute([i for i in items if i[1] < 3], users)
    for u, hits in near.items():
        assert sorted(got[u]) == sorted(set(anywhere) | {i[0] for i in hits})[:12]
