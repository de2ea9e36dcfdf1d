"""Registered predicates, joins, aggregates and scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from courtside.functions import text as x
from courtside.functions.common import page_of, page_requests, rating_summary, seek_requests
from courtside.functions.store import new_path
from courtside.functions.times import clock, slot_times, week_day
from courtside.operators import applies as a
from courtside.operators import chat as c
from courtside.operators import filters as f
from courtside.operators import search
from courtside.plans.discovery_plans import FR, TR, _r
from courtside.plans.profile_plans import FACE
from courtside.plans.registry import AS_OF, query
from courtside.plans.social_plans import LATEST
from courtside.sources.payloads import read_requests
from courtside.sources.schemas import schemas
from courtside.sources.sinks import append_rows, page_envelope
from courtside.sources.tables import conform, load_tables, save_tables


@query("s01_load_tables", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(m):
    return load_tables(m.spark, m.path, {"lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE"})["lineitem"]


@query("s02_table_schemas", "SELECT follow_id, follower_user_id, followed_user_id, notification_status FROM follows")
def _(m):
    folder = new_path(m.spark, "tables")
    save_tables({"follows": conform(m.follows, schemas()["follows"])}, folder, {"follows": ("followed_user_id", 4)})
    return load_tables(m.spark, folder, {"follows": schemas()["follows"]})["follows"].select("follow_id", "follower_user_id", "followed_user_id", "notification_status")


@query("s07_append_rows", "SELECT like_id, user_id, post_id, like_id % 2 AS part FROM likes")
def _(m):
    path = new_path(m.spark, "appended")
    for part in (0, 1):
        append_rows(m.likes.where(F.col("like_id") % 2 == part).withColumn("part", F.lit(part)), path, "part")
    return m.spark.read.parquet(path).select("like_id", "user_id", "post_id", "part")


@query("s03_read_requests", """
SELECT user_id, latitude, longitude, 1 AS page FROM users""")
def _(m):
    path = new_path(m.spark, "requests")
    body = m.users.select(F.to_json(F.struct("user_id", "latitude", "longitude", F.lit(1).alias("page"))).alias("value"))
    body.unionByName(m.users.select(F.concat(F.lit("{broken "), "email").alias("value"))).write.text(path)
    return read_requests(m.spark, path, "user_id BIGINT, latitude DOUBLE, longitude DOUBLE, page INT")[0]


@query("s03_read_requests_broken", "SELECT '{broken ' || email AS value FROM users")
def _(m):
    path = new_path(m.spark, "requests")
    m.users.select(F.concat(F.lit("{broken "), "email").alias("value")).write.text(path)
    return read_requests(m.spark, path, "user_id BIGINT, latitude DOUBLE, longitude DOUBLE, page INT")[1]


@query("s06_page_envelope", """
WITH q AS (SELECT facilitator_id, facility_id, row_number() OVER (PARTITION BY facilitator_id ORDER BY facility_id) AS rn FROM facilities)
SELECT facilitator_id, 1 AS page, 5 AS "limit", string_agg(CAST(facility_id AS VARCHAR), ',' ORDER BY facility_id) AS data FROM q WHERE rn <= 5 GROUP BY 1""")
def _(m):
    from courtside.operators.profiles import facility_list

    df = page_envelope(facility_list(m.facilities), "facilitator_id", 1, 5, "facility_id")
    return df.withColumn("data", F.array_join(F.transform("data", lambda r: r["facility_id"].cast("string")), ","))


@query("f01_lookup", "SELECT * FROM facilities WHERE facility_id IN (SELECT facility_id FROM books)")
def _(m):
    return f.lookup(m.facilities, m.books.select("facility_id").distinct()).select(*m.facilities.columns)


# everybody asks for the session of their own and for the one numbered after it
ASK = "SELECT user_id, facility_sessions_id FROM facility_sessions UNION ALL SELECT user_id, facility_sessions_id + 1 FROM facility_sessions"


@query("f02_authorized", f"SELECT r.* FROM ({ASK}) r WHERE (user_id, facility_sessions_id) IN (SELECT user_id, facility_sessions_id FROM facility_sessions)")
def _(m):
    return f.authorized(m.derive(ASK), m.facility_sessions, ["user_id", "facility_sessions_id"])[0]


@query("f02_denied", f"SELECT r.* FROM ({ASK}) r WHERE (user_id, facility_sessions_id) NOT IN (SELECT user_id, facility_sessions_id FROM facility_sessions)")
def _(m):
    return f.authorized(m.derive(ASK), m.facility_sessions, ["user_id", "facility_sessions_id"])[1]


@query("f03_role_filter", "SELECT user_id, type FROM users WHERE type IN ('parent', 'facilitator') AND (type <> 'facilitator' OR user_id IN (SELECT user_id FROM facilitators))")
def _(m):
    return f.role_filter(m.users, ["parent", "facilitator"], m.facilitators).select("user_id", "type")


@query("f05_name_contains", "SELECT facility_id, name FROM facilities WHERE name ILIKE '%RING%'")
def _(m):
    return f.name_contains(m.facilities, ["name"], "RING").select("facility_id", "name")


@query("f06_has_prefix", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END AS is_img FROM pages")
def _(m):
    return f.has_prefix(m.pages, "url", "https://").select("page_id", "is_img")


@query("f07_between", "SELECT trainer_id, hourly_rate FROM trainers WHERE hourly_rate BETWEEN 40 AND (SELECT max(hourly_rate) + 1 FROM trainers)")
def _(m):
    return f.between(m.trainers, "hourly_rate", 40).select("trainer_id", "hourly_rate")


@query("f08_enum_filter", "SELECT trainer_id FROM trainers WHERE specialization = 'rugby' AND gender = 'male'")
def _(m):
    return f.enum_filter(m.trainers, specialization="rugby", gender="male").select("trainer_id")


@query("f09_regex_valid", r"SELECT user_id, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS valid FROM users")
def _(m):
    return f.regex_valid(m.users, "email", f.EMAIL_PATTERN).select("user_id", "valid")


@query("f09_valid_date", "SELECT book_id, 1 AS good, 0 AS bad FROM books")
def _(m):
    day = F.col("time").cast("string")
    return m.books.select("book_id", f.valid_date(day).cast("int").alias("good"), f.valid_date(F.concat(F.substring(day, 1, 8), F.lit("77"))).cast("int").alias("bad"))


@query("f10_on_date", "SELECT notification_id, time FROM notifications WHERE CAST(time AS DATE) = DATE '2024-01-05'")
def _(m):
    return f.on_date(m.notifications, "time", "2024-01-05").select("notification_id", "time")


@query("f11_contains_all", """
SELECT facility_id FROM (SELECT facility_id, count(DISTINCT name) FILTER (WHERE name IN ('Parking', 'Lockers')) AS n FROM amenities GROUP BY 1) WHERE n = 2""")
def _(m):
    wanted = m.amenities.filter(F.col("name").isin("Parking", "Lockers"))  # lists never outgrow the wanted set
    have = wanted.groupBy("facility_id").agg(F.collect_set("name").alias("have"))
    return f.contains_all(have, "have", ["Parking", "Lockers"]).select("facility_id")


for _phase, _rule in {"upcoming": "start_time > t AND end_time > t", "ongoing": "start_time <= t AND end_time > t", "completed": "start_time < t AND end_time <= t"}.items():

    @query(f"f12_session_phase_{_phase}", f"SELECT facility_sessions_id FROM facility_sessions, (SELECT TIMESTAMP '{AS_OF}' AS t) WHERE {_rule}")
    def _(m, phase=_phase):
        return f.session_phase(m.facility_sessions, phase, AS_OF).select("facility_sessions_id")


@query("f13_session_status", f"""
SELECT CASE WHEN start_time > TIMESTAMP '{AS_OF}' THEN 'upcoming' WHEN start_time <= TIMESTAMP '{AS_OF}' AND end_time >= TIMESTAMP '{AS_OF}' THEN 'ongoing' ELSE 'completed' END AS status, count(*) AS n
FROM facility_sessions GROUP BY 1""")
def _(m):
    return m.facility_sessions.groupBy(f.session_status(AS_OF).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_default_unless_set", "SELECT facilitator_id, CASE WHEN coalesce(no_of_professionals, 0) = 0 THEN 7 ELSE no_of_professionals END AS no_of_professionals FROM facilitators")
def _(m):
    return f.default_unless_set(m.facilitators, "no_of_professionals", 7).select("facilitator_id", "no_of_professionals")


@query("j01_inner_join", "SELECT facility_sessions_id, f.name AS place FROM facility_sessions s JOIN facilities f ON f.facility_id = s.facility_id")
def _(m):
    return m.facility_sessions.select("facility_sessions_id", "facility_id").join(m.facilities.select("facility_id", F.col("name").alias("place")), "facility_id").drop("facility_id")


@query("j02_left_chain", f"""
SELECT f.facility_id, fa.facilitator_id, u.user_id, {FACE} FROM facilities f LEFT JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id LEFT JOIN users u ON u.user_id = fa.user_id""")
def _(m):
    owner = m.facilitators.select("facilitator_id", "user_id")
    face = m.users.select("user_id", "first_name", "last_name", "profile_picture", "img")
    return m.facilities.select("facility_id", "facilitator_id").join(owner, "facilitator_id", "left").join(face, "user_id", "left")


@query("j08_semi_join", "SELECT trainer_id FROM trainers WHERE trainer_id IN (SELECT trainer_id FROM favorite_trainer)")
def _(m):
    return m.trainers.join(m.favorite_trainer, "trainer_id", "left_semi").select("trainer_id")


@query("j09_anti_join_unpaid", "SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM payments WHERE status = 'pending')")
def _(m):
    return m.books.join(m.payments.filter(F.col("status") == "pending"), "book_id", "left_anti").select("book_id")


@query("j10_room_latest", f"""
WITH {LATEST} SELECT room_id, arg_max(m.message_id, (m.time, m.message_id)) AS message_id, max(m.time) AS last_message_time, min(l.content) AS latest_message_content
FROM messages m JOIN chats c ON c.chat_id = m.chat_id JOIN latest l USING (room_id) GROUP BY 1""")
def _(m):
    return c.room_latest(m.messages, m.chats)


@query("j12_join_aggregate", f"WITH {TR} SELECT t.trainer_id, specialization, tr.ar AS avg_rating, tr.n AS no_of_reviews FROM trainers t JOIN tr ON tr.trainer_id = t.trainer_id")
def _(m):
    return _r(m.trainers.select("trainer_id", "specialization").join(rating_summary(m.review_trainer, "trainer_id"), "trainer_id"), "avg_rating")


@query("g01_rating_or_zero", f"WITH {FR} SELECT f.facility_id, coalesce(fr.ar, 0) AS avg_rating FROM facilities f LEFT JOIN fr ON fr.facility_id = f.facility_id")
def _(m):
    from courtside.functions.common import with_rating

    return _r(with_rating(m.facilities.select("facility_id"), m.review_facility, "facility_id"), "avg_rating")


@query("g05_highest_rate", "SELECT max(hourly_rate) AS highest_hourly_rate FROM trainers")
def _(m):
    return m.trainers.agg(F.max("hourly_rate").alias("highest_hourly_rate"))


@query("g07_any_flag", "SELECT comment_id, max(CASE WHEN user_id < 100 THEN 1 ELSE 0 END) AS has_liked FROM comment_likes GROUP BY 1")
def _(m):
    return m.comment_likes.groupBy("comment_id").agg(F.max(F.when(F.col("user_id") < 100, 1).otherwise(0)).alias("has_liked"))


@query("g09_distinct_lists", "SELECT facility_id, listagg(DISTINCT week_day, ',' ORDER BY week_day) AS week_days FROM facility_availability_hours WHERE available = 1 GROUP BY 1")
def _(m):
    open_days = m.facility_availability_hours.filter(F.col("available") == 1)
    return open_days.groupBy("facility_id").agg(F.array_join(F.array_sort(F.collect_set("week_day")), ",").alias("week_days"))


@query("g14_order_by_aggregate", "SELECT post_id, count(*) AS n FROM likes GROUP BY 1 ORDER BY n DESC, post_id LIMIT 10")
def _(m):
    return page_of(m.likes.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("post_id")])


@query("g15_distinct_rows", "SELECT DISTINCT facility_id, user_id FROM facility_sessions")
def _(m):
    return m.facility_sessions.select("facility_id", "user_id").dropDuplicates()


@query("t05_first_chat", "SELECT user_id, min(chat_id) AS chat_id, arg_min(room_id, chat_id) AS room_id FROM chats GROUP BY 1")
def _(m):
    return m.chats.groupBy("user_id").agg(F.min("chat_id").alias("chat_id"), F.min_by("room_id", "chat_id").alias("room_id"))


@query("x07_full_years", "SELECT experience_id, datesub('year', start_date, end_date) AS years FROM experiences")
def _(m):
    return m.experiences.select("experience_id", F.expr("timestampdiff(YEAR, start_date, end_date)").alias("years"))


@query("x10_week_day", "SELECT book_id, lower(dayname(time)) AS week_day FROM books")
def _(m):
    return m.books.select("book_id", week_day(F.col("time")).alias("week_day"))


@query("x11_slot_times", """
SELECT facility_id, week_day, n, lpad(CAST(CAST(substr(start_time, 1, 2) AS INT) + n AS VARCHAR), 2, '0') || substr(start_time, 3) AS slot_start,
  lpad(CAST(CAST(substr(start_time, 1, 2) AS INT) + n + 1 AS VARCHAR), 2, '0') || substr(end_time, 3) AS slot_end
FROM facility_availability_hours, (VALUES (0), (1), (2)) AS s(n)""")
def _(m):
    rows = m.facility_availability_hours.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start, end = slot_times(F.col("start_time"), F.col("end_time"), F.col("n"))
    return rows.select("facility_id", "week_day", "n", clock(start).alias("slot_start"), clock(end).alias("slot_end"))


@query("x12_split_list", "SELECT user_id, CAST(len(string_split(email, '@')) AS INT) AS parts FROM users")
def _(m):
    return m.users.select("user_id", F.size(x.split_list(F.col("email"), "@")).alias("parts"))


@query("x14_split_name", """
SELECT facility_id, split_part(name, ' ', 1) AS first_name, substr(name || ' of ' || description, length(split_part(name, ' ', 1)) + 2) AS last_name FROM facilities""")
def _(m):
    first, last = a.split_name(F.concat_ws(" ", "name", F.lit("of"), "description"))
    return m.facilities.select("facility_id", first.alias("first_name"), last.alias("last_name"))


@query("x15_split_two_words", "SELECT facility_id, split_part(name, ' ', 1) AS first_name, split_part(name, ' ', 2) AS last_name FROM facilities")
def _(m):
    first, last = a.split_two_words(F.concat_ws(" ", "name", "description"))
    return m.facilities.select("facility_id", first.alias("first_name"), last.alias("last_name"))


@query("x16_cents", "SELECT facility_id, CAST(floor(hourly_rate * 100 + 0.5) AS BIGINT) AS amount FROM facilities")
def _(m):
    return m.facilities.select("facility_id", x.cents(F.col("hourly_rate")).alias("amount"))


@query("x17_days_before", "SELECT message_id, strftime(time - INTERVAL 15 DAY, '%Y-%m-%d') AS since FROM messages")
def _(m):
    return m.messages.select("message_id", x.days_before(F.col("time")).alias("since"))


@query("x18_json", """
SELECT event_id, CAST(regexp_extract(description, '"user_id":([0-9]+)', 1) AS BIGINT) AS user_id, CAST(regexp_extract(description, '"facility_id":([0-9]+)', 1) AS BIGINT) AS facility_id,
  CAST(nullif(regexp_extract(description, '"trainer_id":([0-9]+)', 1), '') AS BIGINT) AS trainer_id FROM payment_events""")
def _(m):
    note = F.from_json("description", "user_id BIGINT, facility_id BIGINT, trainer_id BIGINT, book_id BIGINT")
    return m.payment_events.withColumn("n", note).select("event_id", "n.user_id", "n.facility_id", "n.trainer_id")


@query("x19_clean_html_pages")
def _(m):
    return m.pages.select("page_id", x.clean_html("html").alias("html"))


@query("x19_clean_html_documents")
def _(m):
    return m.documents.select("doc_id", x.clean_html("text").alias("text"))


@query("x20_data_url", "SELECT doc_id, 'text/plain' AS mime, text FROM documents")
def _(m):
    url = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""))
    mime, body = x.data_url(F.col("url"))
    return m.documents.withColumn("url", url).select("doc_id", mime.alias("mime"), body.cast("string").alias("text"))


@query("x21_to_int", """SELECT doc_id, CASE WHEN coalesce(TRY_CAST(regexp_extract(n_chars || 'px', '^\\s*([+-]?\\d+)', 1) AS INT), 0) = 0 THEN 10 ELSE CAST(regexp_extract(n_chars || 'px', '^\\s*([+-]?\\d+)', 1) AS INT) END AS a, 10 AS b FROM documents""")
def _(m):
    return m.documents.select("doc_id", x.to_int(F.concat(F.col("n_chars").cast("string"), F.lit("px")), 10).alias("a"), x.to_int(F.col("lang"), 10).alias("b"))


# Requests that bring their own needle, set, page or cursor

NEEDLES = "SELECT DISTINCT substr(p_name, 2 + CAST(p_partkey % 5 AS INT), 1 + CAST(p_partkey % 6 AS INT)) AS needle FROM part UNION SELECT '' UNION SELECT '%' UNION SELECT upper(n_name) FROM nation UNION SELECT p_name FROM part WHERE p_partkey % 100 = 0"


@query("f05_name_contains_batch", f"""
SELECT n.needle, p.p_name AS name FROM (SELECT DISTINCT p_name FROM part) p JOIN ({NEEDLES}) n ON contains(lower(p.p_name), lower(n.needle))""")
def _(m):
    return search.containing(m.part.select(F.col("p_name").alias("name")), "name", m.derive(NEEDLES), "needle")


@query("f11_contains_all_batch", """
WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), w AS (SELECT o_custkey, list_sort(list(DISTINCT l_suppkey)) AS wanted FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_linenumber = 1 AND o_orderkey % 5 = 0 GROUP BY 1),
sets AS (SELECT DISTINCT array_to_string(wanted, ',') AS wanted, wanted AS ids FROM w UNION ALL SELECT '', [])
SELECT sets.wanted, h.l_orderkey AS order_id FROM sets JOIN (SELECT l_orderkey, list(l_suppkey) AS has FROM s GROUP BY 1) h ON list_has_all(h.has, sets.ids)""")
def _(m):
    chosen = m.lineitem.where("l_linenumber = 1 AND l_orderkey % 5 = 0").join(m.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    sets = chosen.groupBy("o_custkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("wanted")).select("wanted")
    sets = sets.union(sets.limit(1).select(F.array().cast("array<bigint>")))
    out = search.containing_all(m.lineitem, "l_orderkey", "l_suppkey", sets, "wanted")
    return out.select(F.array_join(F.col("wanted").cast("array<string>"), ",").alias("wanted"), F.col("l_orderkey").alias("order_id"))


PAGES = """SELECT DISTINCT user_id, 'a' AS request, CAST(user_id % 4 AS INT) AS page, CASE WHEN user_id % 3 = 0 THEN 3 ELSE 10 END AS "limit" FROM notifications
UNION ALL SELECT DISTINCT user_id, 'b', CAST(20 AS INT), CAST(NULL AS INT) FROM notifications WHERE user_id % 5 = 0""".replace('"', "{q}")


@query("t01_page_requests", f"""
WITH r AS ({PAGES.replace('{q}', '"')}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, notification_id) AS position FROM notifications)
SELECT r.user_id, r.request, n.position, n.notification_id, n.time FROM r JOIN n ON n.user_id = r.user_id
WHERE n.position > (greatest(coalesce(r.page, 1), 1) - 1) * coalesce(r."limit", 10) AND n.position <= greatest(coalesce(r.page, 1), 1) * coalesce(r."limit", 10)""")
def _(m):
    order = [F.col("time").desc(), F.col("notification_id")]
    out = page_requests(m.notifications.select("user_id", "notification_id", "time"), "user_id", order, m.derive(PAGES.replace("{q}", "`")))
    return out.select("user_id", "request", "position", "notification_id", "time")


CURSORS = """SELECT user_id, time AS after_time, notification_id AS after_notification_id, CAST(notification_id % 7 AS INT) AS {q}limit{q} FROM notifications WHERE notification_id % 40 = 0
UNION ALL SELECT DISTINCT user_id, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(2 AS INT) FROM notifications"""


@query("t01_seek_requests", f"""
WITH r AS ({CURSORS.replace('{q}', '"')}), p AS (
  SELECT r.user_id, r.after_time, r.after_notification_id, r."limit", n.time, n.notification_id,
    row_number() OVER (PARTITION BY r.user_id, r.after_notification_id ORDER BY n.time, n.notification_id) AS position
  FROM r JOIN notifications n ON n.user_id = r.user_id AND (r.after_time IS NULL OR (n.time, n.notification_id) > (r.after_time, r.after_notification_id)))
SELECT user_id, after_notification_id, position, notification_id, time FROM p WHERE position <= CASE WHEN "limit" = 0 THEN 10 ELSE "limit" END""")
def _(m):
    rows = m.notifications.select("user_id", "time", "notification_id")
    out = seek_requests(rows, "user_id", ["time", "notification_id"], m.derive(CURSORS.replace("{q}", "`")))
    return out.select("user_id", "after_notification_id", "position", "notification_id", "time")
