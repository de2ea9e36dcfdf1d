"""Finding trainers and facilities around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import deal_in_runs, first_image, flag, for_keys, is_unset, page_by, rating_summary, salted_join, with_rating
from courtside.operators.filters import contains_all, name_contains
from courtside.operators.radius import radius_page, within_radius
from courtside.operators.search import containing_all, search_items

CARD = ["trainer_id", "profile_picture", "img", "first_name", "last_name", "specialization", "specialization_level", "hourly_rate"]
PLACE = ["facility_id", "hourly_rate", "name", "latitude", "longitude"]


def trainer_users(users: DataFrame, trainers: DataFrame) -> DataFrame:
    """Trainers with their user attributes; the user id is kept as ``trainer_user_id``."""
    people = users.select("user_id", "profile_picture", "img", "first_name", "last_name", "type", "latitude", "longitude")
    return trainers.join(people, "user_id").withColumnRenamed("user_id", "trainer_user_id")


_PLACE_OUT = [f"{'card_' if c in ('latitude', 'longitude') else ''}{c} AS {c}" for c in PLACE]


def _facility_cards(facilities, review_facility, facility_img) -> DataFrame:
    cards = with_rating(facilities.select(*PLACE), review_facility, "facility_id")
    return cards.join(first_image(facility_img, "facility_id"), "facility_id", "left")


def _centers(req: DataFrame) -> DataFrame:
    return req.select("user_id", "latitude", "longitude")


def featured_trainers(users, trainers, review_trainer, favorite_trainer, req, page=1, limit=10) -> DataFrame:
    """Trainers around each viewer, most students first.

    ``is_favorite`` is NULL for viewers of type facilitator (the card has no such field for them).
    """
    cards = trainer_users(users, trainers)
    order = [-F.coalesce(F.col("no_of_students"), F.lit(0)), F.col("trainer_id")]
    shown = with_rating(cards.select(*CARD), review_trainer, "trainer_id")
    got = radius_page(cards, req.select("user_id", "type", "latitude", "longitude"), order, "trainer_id", page, limit, cards=shown)
    got = flag(got, favorite_trainer, ["user_id", "trainer_id"], "is_favorite")
    mark = F.when(F.col("type") != "facilitator", F.col("is_favorite"))
    return got.select("user_id", "position", *CARD, "avg_rating", mark.alias("is_favorite"))


def top_trainers(users, trainers, review_trainer, req, page=1, limit=10) -> DataFrame:
    """Trainers around each viewer, best average rating first."""
    cards = with_rating(trainer_users(users, trainers), review_trainer, "trainer_id")
    order = [-F.col("avg_rating"), F.col("trainer_id")]
    shown = ["trainer_id", "profile_picture", "img", "first_name", "last_name", "avg_rating"]
    got = radius_page(cards, _centers(req), order, "trainer_id", page, limit, cards=cards.select(*shown))
    return got.select("user_id", "position", *shown)


def nearby_facilities(facilities, facility_img, review_facility, req, page=1, limit=10) -> DataFrame:
    """Facilities around each viewer with one image and the average rating."""
    cards = _facility_cards(facilities, review_facility, facility_img)
    got = radius_page(facilities, _centers(req), [F.col("facility_id")], "facility_id", page, limit, cards=cards)
    return got.selectExpr("user_id", "position", *_PLACE_OUT, "img", "avg_rating")


def home_summary(chats, req) -> DataFrame:
    """new_messages of each user's first chat, 0 without a chat."""
    first = chats.groupBy("user_id").agg(F.min_by("new_messages", "chat_id").alias("new_messages"))
    return req.select("user_id").join(first, "user_id", "left").fillna({"new_messages": 0})


def filter_trainers(
    users, trainers, review_trainer, favorite_trainer, trainer_hours, req, *,
    specialization: str, gender: str, available: str,
    starting_hourly_rate=None, ending_hourly_rate=None, starting_ratings=None, ending_ratings=None, page=1, limit=10,
) -> DataFrame:
    """Trainers around each viewer passing every filter; trainers without reviews drop out."""
    lo_rate, lo_rating, hi_rating = starting_hourly_rate or 1, starting_ratings or 0, ending_ratings or 5
    hi_rate = F.lit(ending_hourly_rate) if ending_hourly_rate else trainers.agg(F.max("hourly_rate") + 1).scalar()
    open_day = trainer_hours.filter((F.col("week_day") == available) & (F.col("available") == 1))
    good = trainers.filter((F.col("specialization") == specialization) & (F.col("gender") == gender))
    good = good.filter((F.col("hourly_rate") >= lo_rate) & (F.col("hourly_rate") <= hi_rate))
    good = good.join(open_day, "trainer_id", "left_semi")
    cards = trainer_users(users, good).join(rating_summary(review_trainer, "trainer_id", n=None), "trainer_id")
    cards = cards.filter(F.col("avg_rating").between(lo_rating, hi_rating))
    order = [-F.col("avg_rating"), F.col("trainer_id")]
    got = radius_page(cards, _centers(req), order, "trainer_id", page, limit, cards=cards.select(*CARD, "avg_rating"))
    got = flag(got, favorite_trainer, ["user_id", "trainer_id"], "is_favorite")
    return got.select("user_id", "position", *CARD, "avg_rating", "is_favorite")


def filter_facilities(facilities, review_facility, facility_img, amenities, facility_hours, want_amenities, want_days) -> DataFrame:
    """Facilities that have all wanted amenities and are open on all wanted days."""
    # a facility with no open day drops out even when no day is asked for
    good = facility_hours.filter(F.col("available") == 1).select("facility_id", "week_day")
    if want_days:
        days = good.filter(F.col("week_day").isin(*want_days)).groupBy("facility_id").agg(F.collect_set("week_day").alias("days"))
        good = contains_all(days, "days", want_days)
    if want_amenities:
        has = amenities.filter(F.col("name").isin(*want_amenities)).groupBy("facility_id").agg(F.collect_set("name").alias("has"))
        good = good.join(contains_all(has, "has", want_amenities), "facility_id", "left_semi")
    cards = facilities.select(*PLACE).join(good, "facility_id", "left_semi")
    cards = with_rating(cards, review_facility, "facility_id").join(first_image(facility_img, "facility_id"), "facility_id", "left")
    return cards.select(*PLACE, "avg_rating", "img")


def search_facilities(facilities, facility_img, review_facility, name: str, req) -> DataFrame:
    """Facilities whose name contains ``name`` around each distinct place, one row per image.

    The answer depends on the place only, so requests at one place share it.
    """
    places = req.select("latitude", "longitude").distinct()
    found = name_contains(facilities.select(*PLACE), ["name"], name)
    found = with_rating(found, review_facility, "facility_id").join(facility_img.select("facility_id", "img"), "facility_id", "left")
    return within_radius(found, places).select("center_latitude", "center_longitude", *PLACE, "img", "avg_rating")


def search_trainers(users, trainers, review_trainer, name: str, req, page=1, limit=10, strict_radius=False) -> DataFrame:
    """Trainers by name around each distinct place.

    AND binds tighter than OR in the rule, so a first-name match counts at any distance; with
    ``strict_radius`` both names need the radius.
    """
    places = req.select("latitude", "longitude").distinct()
    cards = trainer_users(users, trainers)
    order = [F.col("trainer_id")]
    shown = with_rating(name_contains(cards, ["first_name", "last_name"], name).select(*CARD), review_trainer, "trainer_id")
    if strict_radius:
        got = radius_page(name_contains(cards, ["first_name", "last_name"], name), places, order, "trainer_id", page, limit, cards=shown)
    else:
        anywhere = name_contains(cards, ["first_name"], name)
        got = radius_page(name_contains(cards, ["last_name"], name), places, order, "trainer_id", page, limit, extra=anywhere, cards=shown)
    got = got.withColumnsRenamed({"latitude": "center_latitude", "longitude": "center_longitude"})
    return got.select("center_latitude", "center_longitude", "position", *CARD, "avg_rating")


# Batches in which every request brings its own filters (requests parameters as columns)

RANGES = ["starting_hourly_rate", "ending_hourly_rate", "starting_ratings", "ending_ratings"]


def filter_trainers_each(users, trainers, review_trainer, favorite_trainer, trainer_hours, req, page=1, limit=10) -> DataFrame:
    """R05 for requests with filters of their own: columns user_id, latitude, longitude, specialization, gender, available and RANGES.

    Requests with equal filters form a class; a trainer has a row for each class that it fits, found by its specialization, gender and open
    days, and pages are searched class by class, so no viewer meets trainers that it has not asked for. An unset rate or rating bound takes
    its default (1, the highest rate and one more, 0, 5).
    """
    wanted = ["specialization", "gender", "available"]
    low, high, least, most = (F.when(is_unset(c), d).otherwise(F.col(c)).cast("double") for c, d in zip(RANGES, (F.lit(1.0), F.lit(None), F.lit(0.0), F.lit(5.0)), strict=True))
    bounds = {"_low": low, "_high": high, "_least": least, "_most": most}
    filters = req.select(*wanted, *[c.alias(n) for n, c in bounds.items()]).distinct()
    filters = filters.withColumn("_class", F.xxhash64(*filters.columns))
    highest = trainers.agg(F.max("hourly_rate") + 1).scalar()
    rated = trainers.join(rating_summary(review_trainer, "trainer_id", n=None), "trainer_id")
    open_days = trainer_hours.where("available = 1").select("trainer_id", F.col("week_day").alias("available")).distinct()
    fits = salted_join(rated.join(open_days, "trainer_id"), filters, wanted, ["trainer_id"], salts=4)
    fits = fits.where(F.col("hourly_rate").between(F.col("_low"), F.coalesce("_high", highest)) & F.col("avg_rating").between(F.col("_least"), F.col("_most")))
    places = trainer_users(users, trainers).select("trainer_id", "latitude", "longitude")
    items = fits.select("trainer_id", "avg_rating", "_class").join(places, "trainer_id")
    cards = trainer_users(users, trainers).select(*CARD).join(rated.select("trainer_id", "avg_rating"), "trainer_id")
    own = F.xxhash64(*wanted, *[c.alias(n) for n, c in bounds.items()])
    asked = req.select("user_id", "latitude", "longitude", own.alias("_class"))
    got = radius_page(items, asked, [-F.col("avg_rating"), F.col("trainer_id")], "trainer_id", page, limit, cards=cards, by=["_class"])
    got = flag(got, favorite_trainer, ["user_id", "trainer_id"], "is_favorite")
    return got.select("user_id", "position", *CARD, "avg_rating", "is_favorite")


def filter_facilities_each(facilities, review_facility, facility_img, amenities, facility_hours, req, digits: int | None = None) -> DataFrame:
    """R06 for requests with sets of their own: request_id, want_amenities, want_days (arrays, null for none).

    A facility fits if it has all wanted amenities and is open on all wanted days; one without an open day fits nobody. Both sets are
    one set of marked elements, and equal sets are answered once. With ``digits`` ratings are rounded, once for each facility and not for each row.
    """
    marked = lambda c, mark: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))
    asked = req.select("request_id", F.array_union(marked("want_amenities", "a:"), marked("want_days", "d:")).alias("_set"))
    open_days = facility_hours.where("available = 1").select("facility_id", F.concat(F.lit("d:"), "week_day").alias("element"))
    has = amenities.join(open_days.select("facility_id").distinct(), "facility_id", "left_semi").select("facility_id", F.concat(F.lit("a:"), "name").alias("element"))
    met = containing_all(open_days.union(has), "facility_id", "element", asked, "_set")
    cards = _facility_cards(facilities, review_facility, facility_img)
    if digits is not None:
        cards = cards.withColumn("avg_rating", F.round("avg_rating", digits))
    answers = salted_join(met, cards, "facility_id", ["_set"], salts=4)
    # as many rows as requests times their facilities: a run of requests meets one facility after the other, which takes little space
    parts, salts = int(req.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.array(*[F.lit(i) for i in range(64)])
    runs = deal_in_runs(asked, "_set", "request_id").groupBy("_set", "_lot", "_run").agg(F.array_sort(F.collect_list(F.struct("request_id"))).alias("_asked"))
    runs = runs.withColumn("_asked", F.col("_asked.request_id"))  # plain numbers, nulls among them
    runs = runs.withColumn("_salt", F.explode(salts)).repartition(parts, "_set", "_salt")
    answers = answers.withColumn("_salt", F.pmod(F.xxhash64("facility_id"), F.lit(64)).cast("int")).hint("merge")
    return runs.join(answers, ["_set", "_salt"]).select(F.explode("_asked").alias("request_id"), *PLACE, "avg_rating", "img")


def search_facilities_each(facilities, facility_img, review_facility, req) -> DataFrame:
    """R07 for requests with names of their own: rows of :func:`search_facilities` for each distinct latitude, longitude and name."""
    places = req.select("latitude", "longitude", "name").distinct().withColumnRenamed("name", "search")
    found = search_items(facilities.select(*PLACE), ["name"], places, "search")
    near = within_radius(found, places, by=["search"]).select("center_latitude", "center_longitude", "search", "facility_id")
    cards = with_rating(facilities.select(*PLACE), review_facility, "facility_id").join(facility_img.select("facility_id", "img"), "facility_id", "left")
    return salted_join(near, cards, "facility_id", ["center_latitude", "center_longitude", "search"], salts=4).select("center_latitude", "center_longitude", "search", *PLACE, "img", "avg_rating")


def search_trainers_each(users, trainers, review_trainer, req, page=1, limit=10, strict_radius=False) -> DataFrame:
    """R08 for requests with names of their own: pages of :func:`search_trainers` for each distinct latitude, longitude and name."""
    places = req.select("latitude", "longitude", F.col("name").alias("search")).distinct()
    cards = trainer_users(users, trainers)
    people = cards.select("trainer_id", "first_name", "last_name", "latitude", "longitude")
    shown = with_rating(cards.select(*CARD), review_trainer, "trainer_id")
    if strict_radius:
        found, anywhere = search_items(people, ["first_name", "last_name"], places, "search"), None
    else:
        found, anywhere = search_items(people, ["last_name"], places, "search"), search_items(people, ["first_name"], places, "search")
    got = radius_page(found, places, [F.col("trainer_id")], "trainer_id", page, limit, extra=anywhere, cards=shown, by=["search"])
    got = got.withColumnsRenamed({"latitude": "center_latitude", "longitude": "center_longitude"})
    return got.select("center_latitude", "center_longitude", "search", "position", *CARD, "avg_rating")


def favorite_trainers(favorite_trainer, trainers, users, req=None, page=1, limit=10) -> DataFrame:
    """The trainers a user marked, a page per user."""
    got = page_by(for_keys(favorite_trainer, req, "user_id").select("user_id", "trainer_id").distinct(), "user_id", [F.col("trainer_id")], page, limit)
    return got.join(trainer_users(users, trainers).select(*CARD), "trainer_id", "left").select("user_id", *CARD)


def favorite_facilities(favorite_facility, facilities, facility_img, review_facility, req=None, page=1, limit=10) -> DataFrame:
    """The facilities a user marked, one row per image, a page of rows per user."""
    marked = for_keys(favorite_facility, req, "user_id").select("user_id", "facility_id").distinct()
    got = marked.join(facility_img.select("facility_id", "img"), "facility_id", "left")
    got = page_by(got, "user_id", [F.col("facility_id"), F.col("img").asc_nulls_first()], page, limit)
    cards = with_rating(facilities.select(*PLACE), review_facility, "facility_id")
    return got.join(cards, "facility_id", "left").select("user_id", *PLACE, "img", "avg_rating")


def facility_suggestions(facilities, review_facility, facility_img, facility_hours, trainer_hours, req, page=1, limit=10, require_overlap=False) -> DataFrame:
    """Facilities around each request (trainer_id, latitude, longitude).

    By default hours are not compared. ``require_overlap`` applies the intended rule to the page: on every
    day the facility has hours, the trainer has hours too and the two do not miss each other.
    """
    cards = _facility_cards(facilities, review_facility, facility_img)
    got = radius_page(facilities, req.select("trainer_id", "latitude", "longitude"), [F.col("facility_id")], "facility_id", page, limit, cards=cards)
    if require_overlap:
        f = facility_hours.filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
        f = f.select("facility_id", "week_day", F.col("start_time").alias("fs"), F.col("end_time").alias("fe"))
        t = trainer_hours.select("trainer_id", "week_day", F.col("start_time").alias("ts"), F.col("end_time").alias("te"))
        days = got.select("trainer_id", "facility_id").join(f, "facility_id").join(t, ["trainer_id", "week_day"], "left")
        clash = days.filter(F.col("ts").isNull() | (F.col("te") < F.col("fs")) | (F.col("ts") > F.col("fe")))
        got = got.join(clash, ["trainer_id", "facility_id"], "left_anti")
    return got.selectExpr("trainer_id", "position", *_PLACE_OUT, "avg_rating", "img")


def facilitator_nearby_trainers(users, trainers, review_trainer, req) -> DataFrame:
    """Every trainer around each facilitator with the average review (NULL when none) and the count."""
    cards = trainer_users(users, trainers).select("trainer_id", "first_name", "last_name", "type", "profile_picture", "img", "latitude", "longitude")
    near = within_radius(cards, req.select("user_id", "latitude", "longitude")).drop("center_latitude", "center_longitude")
    reviews = rating_summary(review_trainer, "trainer_id", avg="avg_review")
    near = near.join(reviews, "trainer_id", "left").fillna({"no_of_reviews": 0})
    return near.select("user_id", *cards.columns, "avg_review", "no_of_reviews")
