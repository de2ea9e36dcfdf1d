"""Searches with a needle or a set of wanted values in every request (F05, F11, R06-R08), without forming pairs of requests and items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import salted_join

GRAM = 3  # characters of a gram; shorter needles are grams themselves


def _grams(text: str, lengths: str) -> str:
    """SQL: the distinct grams of ``text`` with the given lengths; none where the text is shorter."""
    one = f"transform(sequence(1, greatest(length({text}) - n + 1, 1)), i -> substring({text}, i, n))"
    return f"array_distinct(flatten(transform({lengths}, n -> CASE WHEN n = 0 THEN array('') WHEN length({text}) >= n THEN {one} ELSE array() END)))"


def containing(values: DataFrame, value: str, needles: DataFrame, needle: str) -> DataFrame:
    """F05 for many needles: every distinct (``needle``, ``value``) where the value contains the needle, upper and lower case alike.

    Values are posted under their grams of one to GRAM characters, and once under the empty gram. A needle looks into the list of its
    rarest gram only and the values found there are compared exactly; a needle with a gram that no value has is dropped. A long list is
    split over tasks. An empty needle is contained in every value; a null needle or value matches nothing. Wildcards are plain characters.
    """
    texts = values.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct().withColumn("_low", F.lower("value"))
    asked = needles.select(F.col(needle).alias("needle")).where("needle IS NOT NULL").distinct().withColumn("_find", F.lower("needle"))
    used = f"array(least(length(_find), {GRAM}))"
    wants = asked.select("needle", "_find", F.explode(F.expr(_grams("_find", used))).alias("_gram"))
    posted = texts.select("value", "_low", F.explode(F.expr(_grams("_low", f"sequence(0, {GRAM})"))).alias("_gram"))
    posted = posted.join(wants.select("_gram").distinct(), "_gram", "left_semi")  # lists that nobody opens go
    sizes = posted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = wants.join(sizes, "_gram", "left").fillna({"_n": 0})
    rarest = counted.groupBy("needle", "_find").agg(F.min(F.struct("_n", "_gram")).alias("_r")).where("_r._n > 0").select("needle", "_find", "_r._gram")
    found = salted_join(posted, rarest, "_gram", ["value"]).where("contains(_low, _find)")
    return found.select("needle", "value").withColumnsRenamed({"needle": needle, "value": value})


def search_items(items: DataFrame, cols: Sequence[str], requests: DataFrame, needle: str) -> DataFrame:
    """The items (with all columns) that contain a request's needle in any of ``cols``, once per needle and item.

    The texts of the items are searched once each, however many items share them.
    """
    hits = []
    for c in cols:
        pairs = containing(items, c, requests, needle)
        hits.append(salted_join(items, pairs, c, [x for x in items.columns if x != c]).select(needle, *items.columns))
    return hits[0] if len(hits) == 1 else reduce(lambda a, b: a.union(b), hits).distinct()


def containing_all(items: DataFrame, item: str, element: str, requests: DataFrame, wanted: str) -> DataFrame:
    """F11 for many sets: every (``wanted``, ``item``) where the item has all elements of the wanted array.

    ``items`` has a row per item and element; items without elements are rows with a null element. Equal sets are answered once: a set
    looks at the items of its rarest element; of these, items whose 64 bits, one for each element by its hash, lack a bit of the set are dropped at
    once, and those that have as many of its elements as it counts are found. The empty set fits
    every item; an element that no item has makes a set fit none; null elements of a set and repeated ones don't count. A null set is
    the empty set.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(wanted), F.array().cast(requests.schema[wanted].dataType)), lambda x: x.isNotNull())))
    asked = requests.select(F.col(wanted).alias("wanted"), clean.alias("_set")).distinct()
    sets = asked.select("_set").distinct()
    # one shuffle by item serves the distinct rows, the marks and the last join
    has = items.select(F.col(item).alias("item"), F.col(element).alias("_e")).repartition("item").distinct()
    some = has.where("_e IS NOT NULL")
    parts = sets.select("_set", F.explode("_set").alias("_e"))
    # a bit for each element: an item without all bits of a set lacks an element of it
    mark = F.expr("shiftleft(1L, CAST(pmod(xxhash64(_e), 64) AS INT))")
    marked = some.join(some.groupBy("item").agg(F.bit_or(mark).alias("_bits")), "item")
    needs = parts.groupBy("_set").agg(F.bit_or(mark).alias("_needs"))
    sizes = some.join(parts.select("_e").distinct(), "_e", "left_semi").groupBy("_e").agg(F.count(F.lit(1)).alias("_n"))
    rarest = parts.join(sizes, "_e", "left").fillna({"_n": 0}).groupBy("_set").agg(F.min(F.struct("_n", "_e")).alias("_r")).where("_r._n > 0")
    rarest = rarest.select("_set", F.col("_r._e").alias("_e")).join(needs, "_set")
    found = salted_join(marked, rarest, "_e", ["item"]).where("_bits & _needs = _needs").select("_set", "item")
    # every other wanted element has to be met, too
    rest = found.where(F.size("_set") > 1).select("_set", "item", F.explode("_set").alias("_e"))
    full = rest.join(some, ["item", "_e"]).groupBy("_set", "item").agg(F.count(F.lit(1)).alias("_n")).where("_n = size(_set)").select("_set", "item")
    met = found.where(F.size("_set") == 1).union(full)
    # the empty set: one row of it at most meets all items
    every = has.select("item").distinct().withColumn("_set", F.array().cast(sets.schema["_set"].dataType))
    met = met.unionByName(salted_join(every, sets.where(F.size("_set") == 0), "_set", ["item"]))
    return salted_join(met, asked, "_set", ["item"]).select(F.col("wanted").alias(wanted), F.col("item").alias(item))
