"""Registered discovery queries: every user of the marketplace is a viewer at their own coordinates."""

from pyspark.sql import functions as F

from courtside.operators import discovery as d
from courtside.operators.radius import within_radius
from courtside.plans.registry import query

DIST = "2 * 6370986 * asin(least(1, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
NEAR = DIST.format(a="v", b="i") + " <= 16093.4"
TR = "tr AS (SELECT trainer_id, round(avg(rating), 6) AS ar, count(*) AS n FROM review_trainer GROUP BY 1)"
FR = "fr AS (SELECT facility_id, round(avg(rating), 6) AS ar, count(*) AS n FROM review_facility GROUP BY 1)"
FI = "fi AS (SELECT facility_id, min(img) AS img FROM facility_img GROUP BY 1)"
TU = "i AS (SELECT t.*, u.profile_picture, u.img, u.first_name, u.last_name, u.type, u.latitude, u.longitude FROM trainers t JOIN users u ON u.user_id = t.user_id)"


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("r01_featured_trainers", f"""
WITH {TR}, {TU}, p AS (
  SELECT v.user_id, v.type AS vtype, i.*, row_number() OVER (PARTITION BY v.user_id ORDER BY i.no_of_students DESC, i.trainer_id) AS position
  FROM users v JOIN i ON {NEAR})
SELECT p.user_id, position, p.trainer_id, profile_picture, img, first_name, last_name, specialization, specialization_level, hourly_rate,
  coalesce(tr.ar, 0) AS avg_rating, CASE WHEN vtype <> 'facilitator' THEN CASE WHEN ft.trainer_id IS NULL THEN 0 ELSE 1 END END AS is_favorite
FROM p LEFT JOIN tr ON tr.trainer_id = p.trainer_id
LEFT JOIN favorite_trainer ft ON ft.trainer_id = p.trainer_id AND ft.user_id = p.user_id WHERE position <= 10""")
def _(m):
    return _r(d.featured_trainers(m.users, m.trainers, m.review_trainer, m.favorite_trainer, m.users), "avg_rating")


@query("r02_top_trainers", f"""
WITH {TR}, {TU}, p AS (
  SELECT v.user_id, i.trainer_id, i.profile_picture, i.img, i.first_name, i.last_name, coalesce(tr.ar, 0) AS avg_rating,
    row_number() OVER (PARTITION BY v.user_id ORDER BY coalesce(tr.ar, 0) DESC, i.trainer_id) AS position
  FROM users v JOIN i ON {NEAR} LEFT JOIN tr ON tr.trainer_id = i.trainer_id)
SELECT * FROM p WHERE position <= 10""")
def _(m):
    return _r(d.top_trainers(m.users, m.trainers, m.review_trainer, m.users), "avg_rating")


@query("r03_nearby_facilities", f"""
WITH {FR}, {FI}, p AS (
  SELECT v.user_id, i.facility_id, i.hourly_rate, i.name, i.latitude, i.longitude,
    row_number() OVER (PARTITION BY v.user_id ORDER BY i.facility_id) AS position
  FROM users v JOIN facilities i ON {NEAR})
SELECT p.*, fi.img, coalesce(fr.ar, 0) AS avg_rating FROM p LEFT JOIN fr ON fr.facility_id = p.facility_id
LEFT JOIN fi ON fi.facility_id = p.facility_id WHERE position <= 10""")
def _(m):
    return _r(d.nearby_facilities(m.facilities, m.facility_img, m.review_facility, m.users), "avg_rating")


@query("r04_home_summary", """
SELECT u.user_id, coalesce(c.n, 0) AS new_messages FROM users u
LEFT JOIN (SELECT user_id, arg_min(new_messages, chat_id) AS n FROM chats GROUP BY 1) c ON c.user_id = u.user_id""")
def _(m):
    return d.home_summary(m.chats, m.users)


@query("r05_filter_trainers", f"""
WITH {TR}, {TU}, p AS (
  SELECT v.user_id, i.trainer_id, i.profile_picture, i.img, i.first_name, i.last_name, i.specialization, i.specialization_level, i.hourly_rate,
    tr.ar AS avg_rating, row_number() OVER (PARTITION BY v.user_id ORDER BY tr.ar DESC, i.trainer_id) AS position
  FROM users v JOIN i ON {NEAR} JOIN tr ON tr.trainer_id = i.trainer_id
  WHERE i.specialization = 'tennis' AND i.gender = 'female' AND tr.ar BETWEEN 0 AND 5
    AND i.hourly_rate BETWEEN 1 AND (SELECT max(hourly_rate) + 1 FROM trainers)
    AND EXISTS (SELECT 1 FROM trainer_availability_hours h WHERE h.trainer_id = i.trainer_id AND h.week_day = 'monday' AND h.available = 1))
SELECT p.*, CASE WHEN ft.trainer_id IS NULL THEN 0 ELSE 1 END AS is_favorite FROM p
LEFT JOIN favorite_trainer ft ON ft.trainer_id = p.trainer_id AND ft.user_id = p.user_id WHERE position <= 10""")
def _(m):
    return _r(d.filter_trainers(m.users, m.trainers, m.review_trainer, m.favorite_trainer, m.trainer_availability_hours, m.users,
                                specialization="tennis", gender="female", available="monday"), "avg_rating")


@query("r06_filter_facilities", f"""
WITH {FR}, {FI}
SELECT f.facility_id, f.hourly_rate, f.name, f.latitude, f.longitude, coalesce(fr.ar, 0) AS avg_rating, fi.img
FROM facilities f LEFT JOIN fr ON fr.facility_id = f.facility_id LEFT JOIN fi ON fi.facility_id = f.facility_id
WHERE (SELECT count(DISTINCT name) FROM amenities a WHERE a.facility_id = f.facility_id AND a.name IN ('Parking', 'Cafe')) = 2
AND (SELECT count(DISTINCT week_day) FROM facility_availability_hours h WHERE h.facility_id = f.facility_id AND available = 1 AND h.week_day IN ('monday', 'friday')) = 2""")
def _(m):
    return _r(d.filter_facilities(m.facilities, m.review_facility, m.facility_img, m.amenities, m.facility_availability_hours,
                                  ["Parking", "Cafe"], ["monday", "friday"]), "avg_rating")


@query("r07_search_facilities", f"""
WITH {FR}, v AS (SELECT DISTINCT latitude, longitude FROM users)
SELECT v.latitude AS center_latitude, v.longitude AS center_longitude, i.facility_id, i.hourly_rate, i.name, i.latitude, i.longitude,
  g.img, coalesce(fr.ar, 0) AS avg_rating
FROM v JOIN facilities i ON i.name ILIKE '%RED%' AND {NEAR} LEFT JOIN facility_img g ON g.facility_id = i.facility_id
LEFT JOIN fr ON fr.facility_id = i.facility_id""")
def _(m):
    return _r(d.search_facilities(m.facilities, m.facility_img, m.review_facility, "RED", m.users), "avg_rating")


def _search_oracle(name):
    return f"""
WITH {TR}, {TU}, v AS (SELECT DISTINCT latitude, longitude FROM users), p AS (
  SELECT v.latitude AS center_latitude, v.longitude AS center_longitude, i.trainer_id, i.profile_picture, i.img, i.first_name, i.last_name,
    i.specialization, i.specialization_level, i.hourly_rate,
    row_number() OVER (PARTITION BY v.latitude, v.longitude ORDER BY i.trainer_id) AS position
  FROM v JOIN i ON i.first_name ILIKE '%{name}%' OR i.last_name ILIKE '%{name}%' AND {NEAR})
SELECT p.*, coalesce(tr.ar, 0) AS avg_rating FROM p LEFT JOIN tr ON tr.trainer_id = p.trainer_id WHERE position <= 10"""


@query("r08_search_trainers_last_name", _search_oracle("7"))
def _(m):
    return _r(d.search_trainers(m.users, m.trainers, m.review_trainer, "7", m.users), "avg_rating")


@query("r08_search_trainers_first_name", _search_oracle("suppl"))
def _(m):
    return _r(d.search_trainers(m.users, m.trainers, m.review_trainer, "suppl", m.users), "avg_rating")


@query("r09_favorite_trainers", f"""
WITH {TU}, p AS (SELECT user_id AS fan, trainer_id, row_number() OVER (PARTITION BY user_id ORDER BY trainer_id) AS rn FROM favorite_trainer)
SELECT p.fan AS user_id, i.trainer_id, profile_picture, img, first_name, last_name, specialization, specialization_level, hourly_rate
FROM p LEFT JOIN i ON i.trainer_id = p.trainer_id WHERE rn <= 10""")
def _(m):
    return d.favorite_trainers(m.favorite_trainer, m.trainers, m.users)


@query("r10_favorite_facilities", f"""
WITH {FR}, p AS (SELECT ff.user_id, ff.facility_id, g.img,
  row_number() OVER (PARTITION BY ff.user_id ORDER BY ff.facility_id, g.img NULLS FIRST) AS rn
  FROM favorite_facility ff LEFT JOIN facility_img g ON g.facility_id = ff.facility_id)
SELECT p.user_id, f.facility_id, f.hourly_rate, f.name, f.latitude, f.longitude, p.img, coalesce(fr.ar, 0) AS avg_rating
FROM p LEFT JOIN facilities f ON f.facility_id = p.facility_id LEFT JOIN fr ON fr.facility_id = p.facility_id WHERE rn <= 10""")
def _(m):
    return _r(d.favorite_facilities(m.favorite_facility, m.facilities, m.facility_img, m.review_facility), "avg_rating")


def _trainer_places(m):
    return d.trainer_users(m.users, m.trainers).select("trainer_id", "latitude", "longitude")


def _suggest_oracle(rule):
    return f"""
WITH {FR}, {FI}, {TU}, p AS (
  SELECT v.trainer_id, f.facility_id, f.hourly_rate, f.name, f.latitude, f.longitude,
    row_number() OVER (PARTITION BY v.trainer_id ORDER BY f.facility_id) AS position
  FROM i v JOIN facilities f ON {DIST.format(a='v', b='f')} <= 16093.4)
SELECT p.*, coalesce(fr.ar, 0) AS avg_rating, fi.img FROM p LEFT JOIN fr ON fr.facility_id = p.facility_id
LEFT JOIN fi ON fi.facility_id = p.facility_id WHERE position <= 10 {rule}"""


@query("r23_facility_suggestions", _suggest_oracle(""))
def _(m):
    return _r(d.facility_suggestions(m.facilities, m.review_facility, m.facility_img, m.facility_availability_hours,
                                     m.trainer_availability_hours, _trainer_places(m)), "avg_rating")


@query("r23_facility_suggestions_overlap", _suggest_oracle("""AND NOT EXISTS (
  SELECT 1 FROM facility_availability_hours a LEFT JOIN trainer_availability_hours b ON b.week_day = a.week_day AND b.trainer_id = p.trainer_id
  WHERE a.facility_id = p.facility_id AND a.start_time IS NOT NULL AND a.end_time IS NOT NULL
    AND (b.start_time IS NULL OR b.end_time < a.start_time OR b.start_time > a.end_time))"""))
def _(m):
    return _r(d.facility_suggestions(m.facilities, m.review_facility, m.facility_img, m.facility_availability_hours,
                                     m.trainer_availability_hours, _trainer_places(m), require_overlap=True), "avg_rating")


@query("r35_facilitator_nearby_trainers", f"""
WITH {TR}, {TU}
SELECT v.user_id, i.trainer_id, i.first_name, i.last_name, i.type, i.profile_picture, i.img, i.latitude, i.longitude,
  tr.ar AS avg_review, coalesce(tr.n, 0) AS no_of_reviews
FROM users v JOIN facilitators fa ON fa.user_id = v.user_id JOIN i ON {NEAR} LEFT JOIN tr ON tr.trainer_id = i.trainer_id""")
def _(m):
    req = m.users.join(m.facilitators, "user_id", "left_semi")
    return _r(d.facilitator_nearby_trainers(m.users, m.trainers, m.review_trainer, req), "avg_review")


@query("j06_radius_join", f"""
WITH i AS (SELECT DISTINCT latitude, longitude FROM facilities), v AS (SELECT DISTINCT latitude, longitude FROM users)
SELECT v.latitude AS center_latitude, v.longitude AS center_longitude, i.latitude, i.longitude,
  round({DIST.format(a='i', b='v')}, 3) AS distance_m FROM v JOIN i ON {NEAR}""")
def _(m):
    spots = m.facilities.select("latitude", "longitude").distinct()
    centers = m.users.select("latitude", "longitude").distinct()
    return within_radius(spots, centers, distance="distance_m").withColumn("distance_m", F.round("distance_m", 3))


# Batches in which every request has its own values. The requests are derived from the tables, a row per user.

SEARCHES = """SELECT user_id, latitude, longitude, CASE user_id % 6 WHEN 0 THEN 'RED' WHEN 1 THEN 'ue m' WHEN 2 THEN '' WHEN 3 THEN 'zzz' WHEN 4 THEN '%' ELSE
  substr(first_name, 2, 4) END AS name FROM users UNION ALL SELECT user_id, latitude, longitude, CASE user_id % 3 WHEN 0 THEN '7' WHEN 1 THEN 'CHOC' ELSE lower(last_name) END FROM users"""


def _needle(column):
    return f"contains(lower({column}), lower(v.search))"


@query("r07_search_facilities_batch", f"""
WITH {FR}, v AS (SELECT DISTINCT latitude, longitude, name AS search FROM ({SEARCHES}))
SELECT v.latitude AS center_latitude, v.longitude AS center_longitude, v.search, i.facility_id, i.hourly_rate, i.name, i.latitude, i.longitude,
  g.img, coalesce(fr.ar, 0) AS avg_rating
FROM v JOIN facilities i ON {_needle('i.name')} AND {NEAR} LEFT JOIN facility_img g ON g.facility_id = i.facility_id
LEFT JOIN fr ON fr.facility_id = i.facility_id""")
def _(m):
    return _r(d.search_facilities_each(m.facilities, m.facility_img, m.review_facility, m.derive(SEARCHES)), "avg_rating")


def _search_batch(strict):
    near = f"({_needle('i.first_name')} OR {_needle('i.last_name')}) AND {NEAR}" if strict else f"{_needle('i.first_name')} OR ({_needle('i.last_name')} AND {NEAR})"
    return f"""
WITH {TR}, {TU}, v AS (SELECT DISTINCT latitude, longitude, name AS search FROM ({SEARCHES})), p AS (
  SELECT v.latitude AS center_latitude, v.longitude AS center_longitude, v.search, i.trainer_id, i.profile_picture, i.img, i.first_name, i.last_name,
    i.specialization, i.specialization_level, i.hourly_rate, row_number() OVER (PARTITION BY v.latitude, v.longitude, v.search ORDER BY i.trainer_id) AS position
  FROM v JOIN i ON {near})
SELECT p.*, coalesce(tr.ar, 0) AS avg_rating FROM p LEFT JOIN tr ON tr.trainer_id = p.trainer_id WHERE position <= 10"""


@query("r08_search_trainers_batch", _search_batch(False))
def _(m):
    return _r(d.search_trainers_each(m.users, m.trainers, m.review_trainer, m.derive(SEARCHES)), "avg_rating")


@query("r08_search_trainers_batch_strict", _search_batch(True))
def _(m):
    return _r(d.search_trainers_each(m.users, m.trainers, m.review_trainer, m.derive(SEARCHES), strict_radius=True), "avg_rating")


FILTERS = """SELECT user_id, latitude, longitude, CASE user_id % 3 WHEN 0 THEN 'tennis' WHEN 1 THEN 'soccer' ELSE 'rugby' END AS specialization,
  CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender, CASE user_id % 4 WHEN 0 THEN 'monday' WHEN 1 THEN 'friday' ELSE 'sunday' END AS available,
  CASE user_id % 3 WHEN 0 THEN CAST(20 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) END AS starting_hourly_rate, CASE user_id % 5 WHEN 0 THEN CAST(70 AS DOUBLE) END AS ending_hourly_rate,
  CASE user_id % 2 WHEN 0 THEN CAST(2.5 AS DOUBLE) END AS starting_ratings, CASE user_id % 7 WHEN 0 THEN CAST(3 AS DOUBLE) END AS ending_ratings FROM users"""


@query("r05_filter_trainers_batch", f"""
WITH {TR}, {TU}, v AS ({FILTERS}), p AS (
  SELECT v.user_id, i.trainer_id, i.profile_picture, i.img, i.first_name, i.last_name, i.specialization, i.specialization_level, i.hourly_rate,
    tr.ar AS avg_rating, row_number() OVER (PARTITION BY v.user_id ORDER BY tr.ar DESC, i.trainer_id) AS position
  FROM v JOIN i ON {NEAR} AND i.specialization = v.specialization AND i.gender = v.gender JOIN tr ON tr.trainer_id = i.trainer_id
  WHERE tr.ar BETWEEN coalesce(nullif(starting_ratings, 0), 0) AND coalesce(nullif(ending_ratings, 0), 5)
    AND i.hourly_rate BETWEEN coalesce(nullif(starting_hourly_rate, 0), 1) AND coalesce(nullif(ending_hourly_rate, 0), (SELECT max(hourly_rate) + 1 FROM trainers))
    AND EXISTS (SELECT 1 FROM trainer_availability_hours h WHERE h.trainer_id = i.trainer_id AND h.week_day = v.available AND h.available = 1))
SELECT p.*, CASE WHEN ft.trainer_id IS NULL THEN 0 ELSE 1 END AS is_favorite FROM p
LEFT JOIN favorite_trainer ft ON ft.trainer_id = p.trainer_id AND ft.user_id = p.user_id WHERE position <= 10""")
def _(m):
    return _r(d.filter_trainers_each(m.users, m.trainers, m.review_trainer, m.favorite_trainer, m.trainer_availability_hours, m.derive(FILTERS)), "avg_rating")


WANTED = """SELECT user_id AS request_id, CASE user_id % 4 WHEN 0 THEN 'Parking,Cafe' WHEN 1 THEN 'Lockers' WHEN 2 THEN 'Pool' END AS amenities,
  CASE user_id % 3 WHEN 0 THEN 'monday,friday' WHEN 1 THEN 'sunday' END AS days FROM users"""


@query("r06_filter_facilities_batch", f"""
WITH {FR}, {FI}, v AS ({WANTED}), a AS (SELECT facility_id, list(DISTINCT name) AS has FROM amenities GROUP BY 1),
h AS (SELECT facility_id, list(DISTINCT week_day) AS days FROM facility_availability_hours WHERE available = 1 GROUP BY 1)
SELECT v.request_id, f.facility_id, f.hourly_rate, f.name, f.latitude, f.longitude, coalesce(fr.ar, 0) AS avg_rating, fi.img
FROM v CROSS JOIN facilities f JOIN h ON h.facility_id = f.facility_id LEFT JOIN a ON a.facility_id = f.facility_id
LEFT JOIN fr ON fr.facility_id = f.facility_id LEFT JOIN fi ON fi.facility_id = f.facility_id
WHERE (v.amenities IS NULL OR list_has_all(coalesce(a.has, []), string_split(v.amenities, ','))) AND (v.days IS NULL OR list_has_all(h.days, string_split(v.days, ',')))""")
def _(m):
    req = m.derive(WANTED).select("request_id", F.split("amenities", ",").alias("want_amenities"), F.split("days", ",").alias("want_days"))
    return d.filter_facilities_each(m.facilities, m.review_facility, m.facility_img, m.amenities, m.facility_availability_hours, req, digits=6)
