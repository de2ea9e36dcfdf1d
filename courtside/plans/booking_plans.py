"""Registered availability and booking queries."""

from courtside.operators import booking as b
from courtside.plans.discovery_plans import FI, FR, _r
from courtside.plans.registry import query

ALL = """allb AS (SELECT 'trainer' AS kind, book_id, user_id, facility_id, trainer_id, time, start_time, end_time FROM books UNION ALL
SELECT 'facility', book_facility_id, user_id, facility_id, NULL, time, start_time, end_time FROM book_facilities)"""


@query("r49_common_availability", """
WITH v AS (SELECT DISTINCT facility_id, trainer_id FROM books)
SELECT v.facility_id, v.trainer_id, f.week_day, greatest(f.start_time, t.start_time) AS common_start_time, least(f.end_time, t.end_time) AS common_end_time
FROM v JOIN facility_availability_hours f ON f.facility_id = v.facility_id AND f.available = 1
JOIN trainer_availability_hours t ON t.trainer_id = v.trainer_id AND t.week_day = f.week_day AND t.available = 1
WHERE greatest(f.start_time, t.start_time) < least(f.end_time, t.end_time)""")
def _(m):
    return b.common_availability(m.facility_availability_hours, m.trainer_availability_hours, m.books)


@query("r50_booking_summary", f"""
WITH {FR}, {FI}, {ALL}
SELECT kind, book_id, b.user_id, b.facility_id, b.trainer_id, b.time, f.name, f.latitude, f.longitude, f.hourly_rate, coalesce(fr.ar, 0) AS avg_rating, fi.img,
  u.first_name, u.last_name, t.hourly_rate AS trainer_rate, round(f.hourly_rate + coalesce(t.hourly_rate, 0), 4) AS total_amount,
  CAST(floor((f.hourly_rate + coalesce(t.hourly_rate, 0)) * 100 + 0.5) AS BIGINT) AS amount_cents
FROM allb b JOIN facilities f ON f.facility_id = b.facility_id LEFT JOIN fr ON fr.facility_id = f.facility_id LEFT JOIN fi ON fi.facility_id = f.facility_id
LEFT JOIN trainers t ON t.trainer_id = b.trainer_id LEFT JOIN users u ON u.user_id = t.user_id""")
def _(m):
    return _r(b.booking_summary(m.books, m.book_facilities, m.facilities, m.review_facility, m.facility_img, m.trainers, m.users), "avg_rating")


@query("r56_session_from_booking", f"""
WITH {ALL}
SELECT kind, book_id, b.user_id, b.facility_id, b.trainer_id, u.first_name || ' -> ' || f.name AS name, 'upcoming' AS status,
  CAST(CAST(b.time AS VARCHAR) || ' ' || b.start_time AS TIMESTAMP) AS start_time, CAST(CAST(b.time AS VARCHAR) || ' ' || b.end_time AS TIMESTAMP) AS end_time
FROM allb b LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN facilities f ON f.facility_id = b.facility_id""")
def _(m):
    return b.session_from_booking(m.books, m.book_facilities, m.users, m.facilities)


SLOTS = f"""{ALL}, req AS (SELECT *, coalesce(trainer_id, -1) AS tk, lower(dayname(date)) AS wd FROM booking_requests),
hrs AS (SELECT facility_id, -1 AS tk, week_day, start_time AS cs, end_time AS ce FROM facility_availability_hours WHERE available = 1
  UNION ALL SELECT f.facility_id, t.trainer_id, f.week_day, greatest(f.start_time, t.start_time), least(f.end_time, t.end_time)
  FROM facility_availability_hours f JOIN trainer_availability_hours t ON t.week_day = f.week_day AND f.available = 1 AND t.available = 1
  JOIN (SELECT DISTINCT facility_id, trainer_id FROM booking_requests) r ON r.facility_id = f.facility_id AND r.trainer_id = t.trainer_id
  WHERE greatest(f.start_time, t.start_time) < least(f.end_time, t.end_time)),
once AS (SELECT * FROM req r WHERE NOT EXISTS (SELECT 1 FROM allb a WHERE a.user_id = r.user_id AND a.facility_id = r.facility_id AND coalesce(a.trainer_id, -1) = r.tk AND a.time = r.date)
  QUALIFY row_number() OVER (PARTITION BY user_id, facility_id, tk, date ORDER BY ts, request_id) = 1),
num AS (SELECT o.*, h.cs, h.ce, (SELECT count(*) FROM allb a WHERE a.facility_id = o.facility_id AND coalesce(a.trainer_id, -1) = o.tk AND a.time = o.date)
    + row_number() OVER (PARTITION BY o.facility_id, o.tk, o.date ORDER BY o.ts, o.request_id) - 1 AS n
  FROM once o JOIN hrs h ON h.facility_id = o.facility_id AND h.tk = o.tk AND h.week_day = o.wd),
slot AS (SELECT *, CAST(substr(cs, 1, 2) AS INT) + n AS h0 FROM num),
won AS (SELECT request_id, user_id, facility_id, trainer_id, date AS time, lpad(CAST(h0 AS VARCHAR), 2, '0') || substr(cs, 3) AS start_time,
  lpad(CAST(h0 + 1 AS VARCHAR), 2, '0') || substr(ce, 3) AS end_time FROM slot
  WHERE h0 + 1 < 24 AND lpad(CAST(h0 + 1 AS VARCHAR), 2, '0') || substr(ce, 3) <= ce)"""


def _slots(m):
    return b.allocate_slots(m.books, m.book_facilities, m.booking_requests, m.facility_availability_hours, m.trainer_availability_hours, m.facilities, m.trainers)


@query("w10_allocate_slots", f"WITH {SLOTS} SELECT * FROM won")
def _(m):
    return _slots(m)[0]


@query("w10_refused_requests", f"WITH {SLOTS} SELECT r.* FROM booking_requests r WHERE request_id NOT IN (SELECT request_id FROM won)")
def _(m):
    return _slots(m)[1]
