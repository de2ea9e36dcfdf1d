"""Declared contracts of the marketplace tables (S02), as used by the operators."""

from __future__ import annotations

# Columns and types of every table; "!" marks NOT NULL.
_TABLES = {
    "amenities": "amenity_id bigint!, name string!, facility_id bigint!",
    "athletes": "athlete_id bigint!, user_id bigint!, age int!, weight double!, height int!, sport_interest string!, sport_level string!, gender string!",
    "books": "book_id bigint!, user_id bigint!, facility_id bigint!, trainer_id bigint!, time date!, start_time string!, end_time string!",
    "book_facilities": "book_facility_id bigint!, user_id bigint!, facility_id bigint!, time date!, start_time string!, end_time string!",
    "certificates": "certificate_id bigint!, title string!, organization string!, start_date date!, end_date date, trainer_id bigint!",
    "chats": "chat_id bigint!, user_id bigint!, room_id string, friend_user_id bigint!, last_accessed timestamp_ntz, notification_status string!, new_messages int!",
    "children": "child_id bigint!, parent_id bigint!, name string!, age int!, gender string!, sport_interest string!, sport_level string!",
    "comments": "comment_id bigint!, user_id bigint!, post_id bigint!, time timestamp_ntz!, content string!, no_of_likes int",
    "educations": "education_id bigint!, course_name string!, institute_name string!, study_status string!, start_date date!, end_date date, trainer_id bigint!",
    "experiences": "experience_id bigint!, trainer_id bigint!, designation string!, company_name string!, work_status string, job_type string!, start_date date!, end_date date",
    "facilitators": "facilitator_id bigint!, user_id bigint!, no_of_professionals int!, iso_certified int!",
    "facilitator_employees": "facilitator_employee_id bigint!, facilitator_id bigint!, trainer_id bigint!",
    "facilities": "facility_id bigint!, facilitator_id bigint!, hourly_rate double!, name string!, description string, latitude double, longitude double, capacity int!, established_in int!",
    "facility_availability_hours": "facility_availability_hour_id bigint!, facility_id bigint!, week_day string!, start_time string, end_time string, available int!",
    "facility_employees": "facility_employe_id bigint!, facility_id bigint!, trainer_id bigint!",
    "facility_img": "facility_img_id bigint!, facility_id bigint!, img string!",
    "facility_sessions": "facility_sessions_id bigint!, user_id bigint!, facility_id bigint!, no_of_athletes int, name string!, start_time timestamp_ntz, end_time timestamp_ntz, description string, status string!",
    "favorite_facilitator": "favorite_facilitator_id bigint!, user_id bigint!, facilitator_id bigint!",
    "favorite_trainer": "favorite_trainer_id bigint!, user_id bigint!, trainer_id bigint!",
    "follows": "follow_id bigint!, follower_user_id bigint!, followed_user_id bigint!, notification_status string!",
    "forgot_password": "forgot_password_id bigint!, email string!, otp int!, expires_in bigint!",
    "likes": "like_id bigint!, user_id bigint!, post_id bigint!",
    "messages": "message_id bigint!, chat_id bigint!, content string!, time timestamp_ntz!",
    "notifications": "notification_id bigint!, user_id bigint!, title string!, content string!, time timestamp_ntz!, read_status string!, redirect string",
    "not_notified_users": "not_notified_id bigint!, user_id bigint!, notification_id bigint!",
    "parents": "parent_id bigint!, user_id bigint!",
    "payments": "book_id bigint!, total_amount bigint!, currency string!, status string!, transaction_id string",
    "payments_facility": "book_id bigint!, total_amount bigint!, currency string!, status string!, transaction_id string",
    "posts": "post_id bigint!, user_id bigint!, time timestamp_ntz!, content string!",
    "post_img": "post_img_id bigint!, post_id bigint!, img string!",
    "review_facilitators": "review_facilitator_id bigint!, user_id bigint!, rating double!, content string!, time timestamp_ntz!, facilitator_id bigint!",
    "review_facility": "review_facility_id bigint!, user_id bigint!, rating double!, time timestamp_ntz!, facility_id bigint!, content string!",
    "review_trainer": "review_trainer_id bigint!, user_id bigint!, rating double!, time timestamp_ntz!, trainer_id bigint!, content string!",
    "review_trainer_img": "review_trainer_img_id bigint!, review_trainer_id bigint!, img string!",
    "token_management": "token_management_id bigint!, user_id bigint!, token string!",
    "trainers": "trainer_id bigint!, user_id bigint!, hourly_rate double!, no_of_facility int!, no_of_students int!, specialization string!, specialization_level string!, gender string",
    "trainer_availability_hours": "trainer_availability_hours_id bigint!, week_day string!, start_time string, end_time string, available int!, trainer_id bigint!",
    "trainer_sessions": "trainer_session_id bigint!, trainer_id bigint!, facility_sessions_id bigint!",
    "unseen_messages": "unseen_message_id bigint!, message_id bigint!, user_id bigint!",
    "users": "user_id bigint!, socket_id string, google_id string, first_name string!, last_name string!, profile_picture string, img string!, latitude double, longitude double, level int!, type string!, email string!, password string, no_of_sessions int!, phone string, short_description string, customer_id string",
    "user_unseen_posts": "user_unseen_post_id bigint!, user_id bigint!, post_id bigint!",
    "favorite_facility": "user_id bigint!, facility_id bigint!",
    "comment_likes": "comment_like_id bigint!, user_id bigint!, comment_id bigint!",
    "review_facility_img": "review_facility_id bigint!, img string!",
    "review_facilitator_img": "review_facilitator_id bigint!, img string!",
    "blacklisted_token": "refresh_token string!, access_token string",
    "help_center": "user_id bigint!, content string!",
}


def schemas() -> dict[str, "object"]:
    """Table name to StructType."""
    from pyspark.sql import types as T

    kinds = {
        "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
        "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
    }
    out = {}
    for table, text in _TABLES.items():
        fields = []
        for part in text.split(", "):
            name, kind = part.split(" ")
            fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
        out[table] = T.StructType(fields)
    return out


def required_columns(table: str) -> list[str]:
    """NOT NULL columns, for the integrity audit."""
    return [p.split(" ")[0] for p in _TABLES[table].split(", ") if p.endswith("!")]
