"""Session and appointment views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import for_keys, page_by, with_rating
from courtside.operators.filters import session_phase, session_status

SESSION = ["facility_sessions_id", "name", "description", "latitude", "longitude", "start_time", "end_time"]


def _place(facilities: DataFrame) -> DataFrame:
    return facilities.select("facility_id", "name", "latitude", "longitude")


def upcoming_sessions(facility_sessions, facilities, req, as_of) -> DataFrame:
    """Each user's upcoming sessions with the place."""
    rows = session_phase(for_keys(facility_sessions, req, "user_id"), "upcoming", as_of)
    return rows.join(facilities.select("facility_id", "latitude", "longitude"), "facility_id", "left").select("user_id", *SESSION)


def appointments(facility_sessions, facilities, review_facility, trainer_sessions, trainers, users, req, as_of) -> DataFrame:
    """All sessions of each user with status, facility rating and the lowest-numbered trainer."""
    rows = for_keys(facility_sessions, req, "user_id").select("facility_sessions_id", "user_id", "facility_id", "start_time", "end_time")
    rows = rows.withColumn("session_status", session_status(as_of)).drop("end_time")
    place = with_rating(facilities.select("facility_id", "name", "latitude", "longitude", "hourly_rate"), review_facility, "facility_id")
    first = trainer_sessions.groupBy("facility_sessions_id").agg(F.min("trainer_id").alias("trainer_id"))
    face = trainers.select("trainer_id", F.col("user_id").alias("_tu")).join(
        users.select(F.col("user_id").alias("_tu"), "first_name", "last_name", "img", "profile_picture"), "_tu").drop("_tu")
    rows = rows.join(place, "facility_id", "left").join(first, "facility_sessions_id", "left").join(face, "trainer_id", "left")
    return rows.drop("trainer_id", "facility_id")


def trainer_sessions(facility_sessions, trainer_sessions, facilities, phase, as_of, req=None, page=1, limit=10) -> DataFrame:
    """A page of upcoming, ongoing or completed sessions per trainer."""
    links = for_keys(trainer_sessions, req, "trainer_id").select("trainer_id", "facility_sessions_id").distinct()
    rows = session_phase(facility_sessions, phase, as_of).drop("name").join(links, "facility_sessions_id")
    rows = page_by(rows, "trainer_id", [F.col("facility_sessions_id")], page, limit)
    return rows.join(_place(facilities), "facility_id", "left").select("trainer_id", *SESSION)


def trainer_monthly_sessions(facility_sessions, trainer_sessions, req=None) -> DataFrame:
    """Sessions per trainer and month."""
    links = for_keys(trainer_sessions, req, "trainer_id").select("trainer_session_id", "trainer_id", "facility_sessions_id").distinct()
    rows = facility_sessions.select("facility_sessions_id", F.date_format("start_time", "yyyy-MM").alias("month")).join(links, "facility_sessions_id")
    return rows.groupBy("trainer_id", "month").agg(F.count(F.lit(1)).alias("total_sessions"))


def facilitator_sessions(facility_sessions, facilities, facilitators, phase, as_of, req=None, page=1, limit=10) -> DataFrame:
    """A page of sessions at all facilities of each facilitator (keyed by the facilitator's user)."""
    owners = for_keys(facilitators, req, "user_id").select("facilitator_id", F.col("user_id").alias("owner_user_id"))
    place = facilities.select("facility_id", "facilitator_id", "name", "latitude", "longitude").join(owners, "facilitator_id")
    rows = session_phase(facility_sessions, phase, as_of).select("facility_sessions_id", "facility_id", "description", "start_time", "end_time")
    rows = rows.join(place, "facility_id")
    rows = page_by(rows, "owner_user_id", [F.col("facility_sessions_id")], page, limit)
    return rows.select(F.col("owner_user_id").alias("user_id"), *SESSION)


def session_details(facility_sessions, users, facilities, req=None) -> DataFrame:
    """Session with its booker and place."""
    booker = users.select("user_id", "first_name", "last_name", "profile_picture", "img", "type", "phone")
    rows = for_keys(facility_sessions, req, "facility_sessions_id").join(booker, "user_id", "left")
    rows = rows.join(facilities.select("facility_id", "latitude", "longitude"), "facility_id", "left")
    return rows.select(*SESSION, "first_name", "last_name", "profile_picture", "img", "type", "phone")


def session_trainer(trainer_sessions, trainers, users, req=None) -> DataFrame:
    """Trainer of each session."""
    face = trainers.select("trainer_id", "user_id").join(users.select("user_id", "first_name", "last_name", "type", "phone"), "user_id")
    rows = for_keys(trainer_sessions, req, "facility_sessions_id").select("facility_sessions_id", "trainer_id")
    return rows.join(face.drop("user_id"), "trainer_id")
