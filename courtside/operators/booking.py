"""Availability overlap, bookings and slot allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import first_image, ranked, with_rating
from courtside.functions.times import clock, seconds_of, slot_times, week_day


def common_availability(facility_hours, trainer_hours, pairs) -> DataFrame:
    """Hours a facility and a trainer share, per requested (facility_id, trainer_id) and weekday.

    Requested pairs come first, so hours meet on ids and never on the weekday alone. GREATEST and LEAST
    skip NULL here but must not, hence the null guard.
    """
    f = facility_hours.filter(F.col("available") == 1).select("facility_id", "week_day", F.col("start_time").alias("fs"), F.col("end_time").alias("fe"))
    t = trainer_hours.filter(F.col("available") == 1).select("trainer_id", "week_day", F.col("start_time").alias("ts"), F.col("end_time").alias("te"))
    both = pairs.select("facility_id", "trainer_id").distinct().join(f, "facility_id").join(t, ["trainer_id", "week_day"])
    both = both.filter(F.col("fs").isNotNull() & F.col("fe").isNotNull() & F.col("ts").isNotNull() & F.col("te").isNotNull())
    both = both.select("facility_id", "trainer_id", "week_day", F.greatest("fs", "ts").alias("common_start_time"), F.least("fe", "te").alias("common_end_time"))
    return both.filter(F.col("common_start_time") < F.col("common_end_time"))


def all_bookings(books, book_facilities) -> DataFrame:
    """Bookings with and without trainer in one frame; ``kind`` tells the table."""
    cols = ["kind", "book_id", "user_id", "facility_id", "trainer_id", "time", "start_time", "end_time"]
    a = books.withColumn("kind", F.lit("trainer")).select(*cols)
    b = book_facilities.withColumn("kind", F.lit("facility")).withColumnRenamed("book_facility_id", "book_id")
    return a.unionByName(b.withColumn("trainer_id", F.lit(None).cast("bigint")).select(*cols))


def booking_summary(books, book_facilities, facilities, review_facility, facility_img, trainers, users) -> DataFrame:
    """Facility card, trainer and total (four places, and in cents) of every booking."""
    place = with_rating(facilities.select("facility_id", "name", "latitude", "longitude", "hourly_rate"), review_facility, "facility_id")
    place = place.join(first_image(facility_img, "facility_id"), "facility_id", "left")
    face = trainers.select("trainer_id", "user_id", F.col("hourly_rate").alias("trainer_rate")).join(
        users.select("user_id", "first_name", "last_name"), "user_id", "left").drop("user_id")
    rows = all_bookings(books, book_facilities).drop("start_time", "end_time").join(place, "facility_id").join(face, "trainer_id", "left")
    total = F.col("hourly_rate") + F.coalesce(F.col("trainer_rate"), F.lit(0.0))
    rows = rows.withColumn("total_amount", F.round(total, 4))
    return rows.withColumn("amount_cents", F.floor(total * 100 + 0.5).cast("bigint"))


def session_from_booking(books, book_facilities, users, facilities) -> DataFrame:
    """The session a paid booking turns into: ``first -> facility`` with start and end timestamps."""
    rows = all_bookings(books, book_facilities).join(users.select("user_id", "first_name"), "user_id", "left")
    rows = rows.join(facilities.select("facility_id", F.col("name").alias("place")), "facility_id", "left")
    at = lambda c: F.concat_ws(" ", F.col("time").cast("string"), F.col(c)).cast("timestamp_ntz")
    return rows.select("kind", "book_id", "user_id", "facility_id", "trainer_id", F.concat(F.coalesce("first_name", F.lit("null")), F.lit(" -> "), F.coalesce("place", F.lit("null"))).alias("name"),
                       F.lit("upcoming").alias("status"), at("start_time").alias("start_time"), at("end_time").alias("end_time"))


def allocate_slots(books, book_facilities, requests, facility_hours, trainer_hours, facilities=None, trainers=None) -> tuple[DataFrame, DataFrame]:
    """Decide all booking requests of a batch at once, in (ts, request_id) order.

    The n-th booking of a (facility, trainer, date) group gets the n-th hour of the common hours; a slot
    that runs past their end or past midnight is refused, and so is a second booking of one user for the
    same target and date. A group can win at most 24 slots, and a refusal for lack of hours refuses the whole
    group, so a hot group is cut to 24 rows per task before its shuffle.
    """
    asked = requests.withColumn("week_day", week_day(F.col("date")))
    asked = asked.withColumn("trainer_key", F.coalesce("trainer_id", F.lit(-1).cast("bigint")))
    taken = all_bookings(books, book_facilities).select("user_id", "facility_id", F.coalesce("trainer_id", F.lit(-1).cast("bigint")).alias("trainer_key"), F.col("time").alias("date"))
    target = ["facility_id", "trainer_key", "date"]
    open_hours = facility_hours.filter((F.col("available") == 1) & F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    alone = open_hours.select("facility_id", F.lit(-1).cast("bigint").alias("trainer_key"), "week_day", F.col("start_time").alias("common_start_time"), F.col("end_time").alias("common_end_time"))
    shared = common_availability(facility_hours, trainer_hours, asked.filter(F.col("trainer_id").isNotNull())).withColumnRenamed("trainer_id", "trainer_key")
    hours = alone.unionByName(shared)

    ok = asked.join(taken.distinct(), ["user_id", *target], "left_anti")
    ok = ranked(ok, ["user_id", *target], [F.col("ts"), F.col("request_id")], 1, "_first").drop("_first")
    # all requests of a target share its hours, so ranking first leaves at most 24 rows per target for the joins
    ok = ranked(ok, target, [F.col("ts"), F.col("request_id")], 24, "_n")
    if facilities is not None:
        ok = ok.join(facilities.select("facility_id").distinct(), "facility_id", "left_semi")
    if trainers is not None:
        known = trainers.select(F.col("trainer_id").alias("trainer_key")).union(trainers.sparkSession.range(-1, 0)).distinct()
        ok = ok.join(known, "trainer_key", "left_semi")
    ok = ok.join(hours, ["facility_id", "trainer_key", "week_day"])
    counts = taken.groupBy(*target).agg(F.count(F.lit(1)).alias("_existing"))
    ok = ok.join(counts, target, "left")
    slot = F.coalesce("_existing", F.lit(0)) + F.col("_n") - 1
    start, end = slot_times(F.col("common_start_time"), F.col("common_end_time"), slot)
    ok = ok.withColumn("_start", start).withColumn("_end", end)
    ok = ok.filter((F.col("_end") <= 24 * 3600 - 1) & (F.col("_end") <= seconds_of(F.col("common_end_time"))))
    accepted = ok.select("request_id", "user_id", "facility_id", "trainer_id", F.col("date").alias("time"), clock(F.col("_start")).alias("start_time"), clock(F.col("_end")).alias("end_time"))
    return accepted, requests.join(accepted.select("request_id"), "request_id", "left_anti")
