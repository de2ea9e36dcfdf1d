"""Profiles, reviews and cards of trainers, facilitators, facilities and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import attach_list, count_by, flag, for_keys, is_unset, page_by, with_rating
from courtside.operators.discovery import trainer_users
from courtside.operators.filters import authorized, redact

FACE = ["first_name", "last_name", "profile_picture", "img"]
PRIVATE = ["socket_id", "google_id", "level", "email", "password", "no_of_sessions", "phone"]


def faces(users: DataFrame, *more: str) -> DataFrame:
    return users.select("user_id", *FACE, *more)


def public_profile(users, req=None) -> DataFrame:
    """The profile without private columns."""
    return redact(for_keys(users, req, "user_id"), PRIVATE)


def trainer_profile(users, trainers, favorite_trainer, req) -> DataFrame:
    """Trainer card for each (user_id, trainer_id) request, with the viewer's favourite mark."""
    people = users.select(F.col("user_id").alias("trainer_user_id"), *FACE, "type", "latitude", "longitude", "short_description")
    cards = trainers.select("trainer_id", F.col("user_id").alias("trainer_user_id"), "hourly_rate").join(people, "trainer_user_id")
    asked = flag(req.select("user_id", "trainer_id"), favorite_trainer, ["user_id", "trainer_id"], "is_favorite")
    return asked.join(cards, "trainer_id")


def trainer_statistics(trainers, review_trainer, experiences, req=None) -> DataFrame:
    """Students, full years of the earliest listed experience, average rating, number of reviews."""
    first = experiences.groupBy("trainer_id").agg(F.min_by(F.struct("start_date", "end_date"), "experience_id").alias("e"))
    years = first.select("trainer_id", F.expr("timestampdiff(YEAR, e.start_date, e.end_date)").alias("years_of_experience"))
    out = for_keys(trainers, req, "trainer_id").select("trainer_id", "no_of_students").join(years, "trainer_id", "left")
    out = out.fillna({"no_of_students": 0, "years_of_experience": 0})
    return with_rating(out, review_trainer, "trainer_id", count=True)


def availability(hours, owner_key: str, req=None) -> DataFrame:
    """Weekly hours of trainers or facilities."""
    return for_keys(hours, req, owner_key).select(owner_key, "week_day", "start_time", "end_time", "available")


def trainer_reviews(users, review_trainer, review_trainer_img, req=None, page=1, limit=5) -> DataFrame:
    """Newest reviews of each trainer with author and images."""
    known = for_keys(review_trainer, req, "trainer_id").join(users.select("user_id"), "user_id", "left_semi")
    got = page_by(known, "trainer_id", [F.col("time").desc(), F.col("review_trainer_id")], page, limit)
    got = attach_list(got, review_trainer_img, "review_trainer_id", "review_trainer_id", "img", "review_images")
    author = faces(users).withColumnRenamed("img", "user_img")
    got = got.join(author, "user_id")
    return got.select("trainer_id", "user_id", "user_img", "profile_picture", "first_name", "last_name",
                      "review_trainer_id", "rating", "time", "content", "review_images")


def trainer_profile_completion(trainers, certificates, educations, experiences, req=None) -> DataFrame:
    """Share of nine profile parts that are filled, six of which always are."""
    out = for_keys(trainers, req, "trainer_id").select("trainer_id")
    for i, part in enumerate((certificates, educations, experiences)):
        out = flag(out, part, ["trainer_id"], f"_p{i}")
    filled = F.lit(6) + F.col("_p0") + F.col("_p1") + F.col("_p2")
    return out.select("trainer_id", (filled / 9 * 100).alias("profile_completion"))


def trainer_info(trainers, users, req=None) -> DataFrame:
    """Name, image and rate."""
    people = users.select("user_id", "first_name", "last_name", "img")
    return for_keys(trainers, req, "trainer_id").join(people, "user_id", "left").select("trainer_id", "first_name", "last_name", "img", "hourly_rate")


def trainer_credentials(experiences, certificates, educations, req=None) -> DataFrame:
    """Experiences, certificates and educations of each trainer as rows of one shape.

    ``kind`` tells the table, ``title`` what, ``place`` where and ``detail`` the job type or study status.
    """
    parts = [
        (experiences, "experience", "designation", "company_name", "job_type"),
        (certificates, "certificate", "title", "organization", None),
        (educations, "education", "course_name", "institute_name", "study_status"),
    ]
    out = None
    for table, kind, title, place, detail in parts:
        rows = for_keys(table, req, "trainer_id").select(
            "trainer_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("item_id"), F.col(title).alias("title"), F.col(place).alias("place"),
            (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"), "start_date", "end_date")
        out = rows if out is None else out.unionByName(rows)
    return out


def trainer_credential(table, key: str, req) -> DataFrame:
    """R22, one item: the row with ``key`` if it belongs to the requested trainer."""
    return table.join(req.select("trainer_id", key).distinct(), ["trainer_id", key], "left_semi")


def facilitator_summary(facilitators, facilities, req=None) -> DataFrame:
    """Earliest founding year of a facilitator's facilities, professionals and certification."""
    first = facilities.groupBy("facilitator_id").agg(F.min("established_in").alias("established_in"))
    out = for_keys(facilitators, req, "facilitator_id").join(first, "facilitator_id")
    return out.select("facilitator_id", "user_id", "established_in", "no_of_professionals", "iso_certified")


def facilitator_profile_completion(users, facilitators, req=None) -> DataFrame:
    """100 minus the share of empty parts; the divisor stays six whatever the number of parts."""
    parts = [*FACE, "latitude", "longitude", *(["customer_id"] if "customer_id" in users.columns else []), "no_of_professionals"]
    joined = for_keys(facilitators, req, "facilitator_id").join(users, "user_id")
    empty = sum(F.when(is_unset(c), 1).otherwise(0) for c in parts)
    return joined.select("facilitator_id", "user_id", F.round(100 - empty / 6 * 100, 2).alias("profile_completion"))


def facility_list(facilities, req=None, page=1, limit=5) -> DataFrame:
    """Ids and names of each facilitator's facilities."""
    rows = for_keys(facilities, req, "facilitator_id").select("facilitator_id", "facility_id", "name")
    return page_by(rows, "facilitator_id", [F.col("facility_id")], page, limit)


def facilitator_reviews(review_facilitators, users, review_facilitator_img, req=None, page=1, limit=5) -> DataFrame:
    """Newest reviews of each facilitator with images, one row per review."""
    got = page_by(for_keys(review_facilitators, req, "facilitator_id"), "facilitator_id", [F.col("time").desc(), F.col("review_facilitator_id")], page, limit)
    got = attach_list(got, review_facilitator_img, "review_facilitator_id", "review_facilitator_id", "img", "images")
    return got.join(faces(users), "user_id", "left").select("facilitator_id", "review_facilitator_id", *FACE, "rating", "content", "time", "images")


def facility_basic(facilities, facilitators, req) -> DataFrame:
    """The facility row for (user_id, facility_id) requests by its owner."""
    owners = facilities.select("facility_id", "facilitator_id").join(facilitators.select("facilitator_id", "user_id"), "facilitator_id")
    ok, _ = authorized(req.select("user_id", "facility_id").distinct(), owners, ["user_id", "facility_id"])
    cols = ["facility_id", "name", "hourly_rate", "description", "latitude", "longitude", "capacity"]
    return ok.join(facilities.select(*cols), "facility_id").select("user_id", *cols)


def facility_gallery(facility_img, req=None, page=1, limit=5) -> DataFrame:
    """A page of images per facility."""
    rows = for_keys(facility_img, req, "facility_id").select("facility_id", "facility_img_id", "img")
    return page_by(rows, "facility_id", [F.col("facility_img_id")], page, limit)


def facility_images(facility_img, req=None) -> DataFrame:
    """All distinct images of each facility, one row each."""
    return for_keys(facility_img, req, "facility_id").select("facility_id", "img").distinct()


def facility_reviews(review_facility, users, review_facility_img, req=None, page=1, limit=10) -> DataFrame:
    """Newest reviews of each facility with images and the total number of reviews."""
    asked = for_keys(review_facility, req, "facility_id")
    got = page_by(asked, "facility_id", [F.col("time").desc(), F.col("review_facility_id")], page, limit)
    got = attach_list(got, review_facility_img, "review_facility_id", "review_facility_id", "img", "images")
    got = got.join(count_by(asked, "facility_id", "no_of_reviews"), "facility_id").join(faces(users), "user_id", "left")
    return got.select("facility_id", "review_facility_id", *FACE, "rating", "time", "content", "images", "no_of_reviews")


def facilitator_details(facilitators, users, req=None) -> DataFrame:
    """Facilitator card (the facilities join of the original only repeats the row)."""
    people = users.select("user_id", "first_name", "last_name", "latitude", "longitude")
    rows = for_keys(facilitators, req, "facilitator_id").join(people, "user_id", "left")
    return rows.select("facilitator_id", "first_name", "last_name", "no_of_professionals", "latitude", "longitude")


def facilitator_employees(employees, trainers, users, req=None) -> DataFrame:
    """Staff of each facilitator."""
    cards = trainer_users(users, trainers).select("trainer_id", *FACE)
    return for_keys(employees, req, "facilitator_id").select("facilitator_id", "trainer_id").join(cards, "trainer_id", "left")


def facility_details(facilities, facilitators, users, review_facility, amenities, favorite_facility, req) -> DataFrame:
    """Full facility card for each (user_id, facility_id) request."""
    owner = users.select(F.col("user_id").alias("owner_user_id"), *FACE, "phone")
    cards = facilities.select("facility_id", "facilitator_id", "name", "description", "hourly_rate", "latitude", "longitude")
    asked = flag(req.select("user_id", "facility_id").distinct(), favorite_facility, ["user_id", "facility_id"], "is_favorite")
    cards = cards.join(facilitators.select("facilitator_id", F.col("user_id").alias("owner_user_id")), "facilitator_id", "left")
    cards = with_rating(cards.join(owner, "owner_user_id", "left"), review_facility, "facility_id", count=True)
    cards = attach_list(cards, amenities, "facility_id", "facility_id", "name", "amenities")
    return asked.join(cards.drop("facilitator_id"), "facility_id")


def facility_employees(employees, trainers, users, review_trainer, req=None) -> DataFrame:
    """Staff of each facility with rating and number of reviews."""
    cards = with_rating(trainer_users(users, trainers).select("trainer_id", *FACE), review_trainer, "trainer_id", count=True)
    rows = for_keys(employees, req, "facility_id").select("facility_id", "trainer_id").distinct()
    return rows.join(cards, "trainer_id", "left").fillna({"avg_rating": 0.0, "no_of_reviews": 0})


def children_of(parents, children, req) -> DataFrame:
    """Children for (user_id, parent_id) requests by that parent; with child_id the single form."""
    held = parents.select("user_id", "parent_id").distinct()
    keys = ["user_id", "parent_id", *(["child_id"] if "child_id" in req.columns else [])]
    asked = req.select(*keys).distinct().join(held, ["user_id", "parent_id"], "left_semi")
    cols = ["child_id", "name", "age", "gender", "sport_interest", "sport_level"]
    on = ["parent_id", *(["child_id"] if "child_id" in req.columns else [])]
    return asked.join(children.select("parent_id", *cols), on).select("user_id", "parent_id", *cols)


def specialized_user(users, facilitators, trainers, athletes, parents) -> DataFrame:
    """The role-specific id, facilitator before trainer before athlete before parent."""
    out = users.select("user_id")
    for table, key in ((facilitators, "facilitator_id"), (trainers, "trainer_id"), (athletes, "athlete_id"), (parents, "parent_id")):
        ids = table.filter(F.col(key) != 0).groupBy("user_id").agg(F.min(key).alias(key))
        out = out.join(ids, "user_id", "left")
    return out.select("user_id", F.coalesce("facilitator_id", "trainer_id", "athlete_id", "parent_id").alias("specialized_user_id"))
