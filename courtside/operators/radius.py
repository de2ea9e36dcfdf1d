"""Radius search: all pairs, and the first k items per centre without forming all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import ranked, salted_join
from courtside.functions.geo import SEARCH_RADIUS_M, Grid, haversine_m

SLACK_M = 0.01  # rounding guard of the cell tests; the final distance test is exact
SPOT = ["latitude", "longitude"]


def _located(df: DataFrame) -> DataFrame:
    return df.filter("latitude IS NOT NULL AND longitude IS NOT NULL")


def within_radius(items: DataFrame, centers: DataFrame, radius_m: float = SEARCH_RADIUS_M, distance: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every (centre, item) pair within ``radius_m``: equi join on grid cells, then the exact distance.

    Centre columns other than the coordinates are kept; centre coordinates come out as
    ``center_latitude``/``center_longitude``. Columns in ``by`` (of both sides) have to be equal, too. The result is as large as the
    number of pairs; use ``radius_page`` when only a page per centre is wanted.
    """
    grid = Grid(radius_m)
    probes = _located(centers).withColumnsRenamed({"latitude": "center_latitude", "longitude": "center_longitude"})
    probes = grid.explode_around(probes, "center_latitude", "center_longitude", f"{radius_m + SLACK_M}D")
    spots = grid.place(_located(items))
    pairs = salted_join(spots, probes, ["_row", "_col", *by], [c for c in items.columns])
    pairs = pairs.withColumn("_dist", F.expr(haversine_m("latitude", "longitude", "center_latitude", "center_longitude"))).filter(F.col("_dist") <= radius_m)
    if distance:
        pairs = pairs.withColumnRenamed("_dist", distance)
    return pairs.drop("_row", "_col", "_dist")


def radius_page(
    items: DataFrame,
    requests: DataFrame,
    order: Sequence[Column],
    item_key: str,
    page: int = 1,
    limit: int = 10,
    radius_m: float = SEARCH_RADIUS_M,
    extra: DataFrame | None = None,
    cards: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One page of the items around every request row, exact at any density.

    ``order`` is a list of non-null numeric columns, smaller first, ending in a unique key. Returns the
    request columns plus ``item_key`` and ``position``.

    Requests at one spot share one answer and items at one spot are all in or all out, so work is done on
    spots and on fine cells (an eighth of the radius) holding them:
      1. keep the k best items per spot (pruned before the shuffle);
      2. cell pairs whose farthest points are within the radius need no distance test: the k best of those
         items give each request cell a k-th key that any further item has to beat;
      3. items of cells cut by the circle are tested per spot, but only if they beat that key, and items
         that beat no key around them are dropped before any pairing.
    A crowded cell therefore contributes about k rows, not its whole contents times its visitors. (A request
    cell with fewer than k sure items has no such key and tests all spots of the cells its circle cuts; ranks
    that follow the map, such as best in the north, weaken the key and cost more tests, too.)
    ``extra`` adds items that match everywhere (their k best are merged into every page). ``cards`` (one row
    per item) adds display columns to the answers, before these are repeated for every request at a spot.
    ``by`` names filter classes: columns of items, requests and ``extra`` that have to be equal. An item has a row for each class that it
    is in; everything above, the keys to beat included, is then kept for each class by itself.
    """
    top, by = page * limit, list(by)
    grid = Grid(radius_m / 8)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    best_first = [F.col("_key")]
    in_cell, at_spot, at_cell = ["_row", "_col", *by], [*SPOT, *by], ["_vrow", "_vcol", *by]
    spots = ranked(_located(items).select(item_key, *at_spot, key.alias("_key")), at_spot, best_first, top, "_spot_rank").drop("_spot_rank")
    spots = grid.place(spots)
    cell_top = ranked(spots, in_cell, best_first, top, "_cell_rank").select(*in_cell, item_key, "_key")

    places = grid.place(_located(requests).select(*at_spot).distinct(), "_vrow", "_vcol")

    # cell pairs: occupied item cells around occupied request cells, found through a coarser grid
    coarse = Grid(radius_m)
    cells = places.select(*at_cell).distinct()
    cells = cells.selectExpr(*at_cell, f"{grid.center_lat('_vrow')} AS _vlat", f"{grid.center_lon('_vrow', '_vcol')} AS _vlon", f"{grid.reach('_vrow')} AS _vreach")
    cells = coarse.explode_around(cells, "_vlat", "_vlon", f"_vreach + {radius_m + grid.max_reach() + SLACK_M}D").withColumnsRenamed({"_row": "_crow", "_col": "_ccol"})
    used = cell_top.select(*in_cell).distinct()
    used = used.selectExpr(*in_cell, f"{grid.center_lat('_row')} AS _ilat", f"{grid.center_lon('_row', '_col')} AS _ilon", f"{grid.reach('_row')} AS _ireach")
    pairs = cells.join(coarse.place(used, "_crow", "_ccol", "_ilat", "_ilon"), ["_crow", "_ccol", *by])
    apart = haversine_m("_vlat", "_vlon", "_ilat", "_ilon")
    pairs = pairs.selectExpr(*at_cell, "_row", "_col", f"{apart} AS _mid", f"_vreach + _ireach + {SLACK_M}D AS _slop")
    sure = pairs.filter(f"_mid + _slop <= {radius_m}D").drop("_mid", "_slop")
    cut = pairs.filter(f"_mid + _slop > {radius_m}D AND _mid - _slop <= {radius_m}D").drop("_mid", "_slop")

    inside = ranked(sure.join(cell_top, in_cell), at_cell, best_first, top, "_n").select(*at_cell, item_key, "_key", "_n")
    bar = inside.filter(F.col("_n") == top).select(*at_cell, F.col("_key").alias("_bar"))

    cut = cut.join(bar, at_cell, "left")
    # the weakest bar around an item cell drops most of a crowd before it meets any request cell
    weakest = cut.groupBy(*in_cell).agg(F.max("_bar").alias("_weakest"), F.max(F.col("_bar").isNull()).alias("_open"))
    able = spots.join(weakest, in_cell).filter("_open OR _key < _weakest").drop("_weakest", "_open")
    able = able.withColumnsRenamed({"latitude": "_ilat", "longitude": "_ilon"})
    edge = cut.join(able, in_cell).filter("_bar IS NULL OR _key < _bar").select(*at_cell, item_key, "_key", "_ilat", "_ilon")
    candidates = inside.select(*at_cell, item_key, "_key").unionByName(edge, allowMissingColumns=True)
    hits = salted_join(places, candidates, at_cell, SPOT, salts=4)
    hits = hits.filter(f"_ilat IS NULL OR {haversine_m('_ilat', '_ilon', 'latitude', 'longitude')} <= {radius_m}D").select(*at_spot, item_key, "_key")
    if extra is not None:
        if by:
            # the k best of each class for every place of the class
            best = ranked(extra.select(*by, item_key, key.alias("_key")), by, best_first, top, "_n").drop("_n")
            everywhere = salted_join(places.select(*at_spot), best, by, SPOT).select(*at_spot, item_key, "_key")
        else:
            # the k best of the everywhere items, as one bounded array from a scalar subquery
            best = extra.select(F.col(item_key), key.alias("_key")).orderBy("_key").limit(top)
            packed = best.agg(F.collect_list(F.struct(item_key, "_key")).alias("a"))
            everywhere = places.select(*SPOT, F.explode(packed.scalar()).alias("_x")).select(*SPOT, "_x.*")
        hits = hits.unionByName(everywhere).distinct()
    answers = ranked(hits, at_spot, best_first, top, "position")
    if page > 1:
        answers = answers.filter(F.col("position") > top - limit)
    answers = answers.select(*at_spot, item_key, F.col("position").cast("bigint").alias("position"))
    if cards is not None:
        answers = salted_join(answers, cards.withColumnsRenamed({c: f"card_{c}" for c in SPOT}), item_key, SPOT, salts=4)
    return salted_join(requests, answers, at_spot, requests.columns, salts=4)
