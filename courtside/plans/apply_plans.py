"""Registered batch applies; the events of each are derived from whole marketplace tables."""

from functools import reduce

from pyspark.sql import functions as F

from courtside.functions.store import new_path
from courtside.operators import applies as a
from courtside.operators import booking as b
from courtside.operators import quality as q
from courtside.operators import social as s
from courtside.plans.booking_plans import ALL
from courtside.plans.registry import ORACLES, query
from courtside.sources.buckets import BucketedTable

FAV = "SELECT book_id AS event_id, time AS ts, user_id, trainer_id FROM books"


def _favs(m):
    return a.apply_unique_pairs(m.favorite_trainer, m.derive(FAV), ["user_id", "trainer_id"], parents={"trainer_id": m.trainers})


@query("w01_favorite_trainers", "SELECT user_id, trainer_id FROM favorite_trainer UNION SELECT user_id, trainer_id FROM books")
def _(m):
    return _favs(m)[0]


@query("w01_favorite_trainers_rejected", f"""
WITH e AS ({FAV}), t AS (SELECT e.*, EXISTS (SELECT 1 FROM favorite_trainer f WHERE f.user_id = e.user_id AND f.trainer_id = e.trainer_id) AS there,
  row_number() OVER (PARTITION BY user_id, trainer_id ORDER BY ts, event_id) AS rn FROM e)
SELECT event_id, ts, user_id, trainer_id, CASE WHEN there THEN 'exists' ELSE 'repeated' END AS reason FROM t WHERE there OR rn > 1""")
def _(m):
    return _favs(m)[1]


# commenting on a post makes a follow request to its author
FOLLOW = "SELECT c.comment_id AS event_id, c.time AS ts, c.user_id AS follower_user_id, p.user_id AS followed_user_id FROM comments c JOIN posts p ON p.post_id = c.post_id"


def _follows(m):
    return a.apply_unique_pairs(
        m.follows.select("follower_user_id", "followed_user_id"), m.derive(FOLLOW), ["follower_user_id", "followed_user_id"],
        parents={"followed_user_id": m.users.select(F.col("user_id").alias("followed_user_id"))}, distinct_pair=("follower_user_id", "followed_user_id"))


@query("w01_follows", f"""
SELECT follower_user_id, followed_user_id FROM follows UNION
SELECT follower_user_id, followed_user_id FROM ({FOLLOW}) e WHERE follower_user_id <> followed_user_id AND followed_user_id IN (SELECT user_id FROM users)""")
def _(m):
    return _follows(m)[0]


@query("w01_follows_rejected", f"""
WITH t AS (SELECT e.*, EXISTS (SELECT 1 FROM follows f WHERE f.follower_user_id = e.follower_user_id AND f.followed_user_id = e.followed_user_id) AS there,
  row_number() OVER (PARTITION BY follower_user_id, followed_user_id ORDER BY ts, event_id) AS rn FROM ({FOLLOW}) e)
SELECT event_id, ts, follower_user_id, followed_user_id, CASE WHEN follower_user_id = followed_user_id THEN 'self' WHEN there THEN 'exists' ELSE 'repeated' END AS reason
FROM t WHERE follower_user_id = followed_user_id OR there OR rn > 1""")
def _(m):
    return _follows(m)[1]


REVIEWS = """SELECT facility_sessions_id AS event_id, end_time AS ts, user_id, facility_id, CAST(facility_sessions_id % 6 AS DOUBLE) AS rating,
CASE WHEN facility_sessions_id % 7 <> 0 THEN name ELSE '' END AS content FROM facility_sessions"""


def _reviews(m):
    return a.apply_reviews(m.review_facility, m.derive(REVIEWS).withColumn("time", F.col("ts")), "facility_id")


@query("w02_facility_reviews", f"""
WITH e AS (SELECT * FROM ({REVIEWS}) WHERE rating <> 0 AND content <> '' QUALIFY row_number() OVER (PARTITION BY user_id, facility_id ORDER BY ts, event_id) = 1)
SELECT user_id, facility_id, rating, time, content FROM review_facility UNION ALL
SELECT user_id, facility_id, rating, ts, content FROM e WHERE NOT EXISTS (SELECT 1 FROM review_facility r WHERE r.user_id = e.user_id AND r.facility_id = e.facility_id)""")
def _(m):
    return _reviews(m)[0].drop("review_facility_id")


@query("w02_facility_reviews_rejected", f"""
WITH v AS (SELECT * FROM ({REVIEWS})), t AS (SELECT *, row_number() OVER (PARTITION BY user_id, facility_id ORDER BY ts, event_id) AS rn,
  EXISTS (SELECT 1 FROM review_facility r WHERE r.user_id = v.user_id AND r.facility_id = v.facility_id) AS there FROM v WHERE rating <> 0 AND content <> '')
SELECT event_id, CASE WHEN there THEN 'exists' ELSE 'repeated' END AS reason FROM t WHERE there OR rn > 1 UNION ALL
SELECT event_id, 'missing_' || CASE WHEN rating = 0 AND content = '' THEN 'rating_content' WHEN rating = 0 THEN 'rating' ELSE 'content' END FROM v WHERE rating = 0 OR content = ''""")
def _(m):
    return _reviews(m)[1].select("event_id", "reason")


@query("w03_unlike", "SELECT like_id, user_id, post_id FROM likes l WHERE NOT EXISTS (SELECT 1 FROM like_actions x WHERE x.action = 'remove' AND x.user_id = l.user_id AND x.post_id = l.post_id)")
def _(m):
    return a.apply_deletes(m.likes, m.like_actions.filter(F.col("action") == "remove"), ["user_id", "post_id"])[0]


@query("w03_unlike_rejected", """
SELECT x.*, 'absent' AS reason FROM like_actions x WHERE x.action = 'remove' AND NOT EXISTS (SELECT 1 FROM likes l WHERE x.user_id = l.user_id AND x.post_id = l.post_id)""")
def _(m):
    return a.apply_deletes(m.likes, m.like_actions.filter(F.col("action") == "remove"), ["user_id", "post_id"])[1]


@query("w04_toggle_likes", """
WITH z AS (SELECT user_id, post_id, arg_max(action, (ts, event_id)) AS action FROM like_actions GROUP BY 1, 2)
SELECT user_id, post_id FROM z WHERE action = 'add' UNION ALL
SELECT user_id, post_id FROM comment_posts WHERE (user_id, post_id) NOT IN (SELECT user_id, post_id FROM z)""".replace("comment_posts", "(SELECT DISTINCT user_id, post_id + 50 AS post_id FROM comments)"))
def _(m):
    snapshot = m.derive("SELECT DISTINCT user_id, post_id + 50 AS post_id FROM comments")
    return a.apply_toggles(snapshot, m.like_actions, ["user_id", "post_id"])


EDITS = """SELECT facility_sessions_id AS event_id, start_time AS ts, s.facility_id, (s.facility_id + facility_sessions_id % 2) % 25 AS facilitator_id,
CASE WHEN facility_sessions_id % 3 <> 0 THEN CAST(10 + facility_sessions_id % 90 AS DOUBLE) END AS hourly_rate, 'Renamed ' || CAST(facility_sessions_id AS STRING) AS name FROM facility_sessions s"""


def _edits(m):
    return a.apply_updates(m.facilities, m.derive(EDITS), "facility_id", ["hourly_rate", "name"], owner="facilitator_id")


@query("w05_facility_edits", f"""
WITH e AS (SELECT * FROM ({EDITS}) x WHERE facilitator_id = facility_id % 25 QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT f.facility_id, f.facilitator_id, coalesce(e.hourly_rate, f.hourly_rate) AS hourly_rate, coalesce(e.name, f.name) AS name, description, latitude, longitude, capacity, established_in
FROM facilities f LEFT JOIN e ON e.facility_id = f.facility_id""")
def _(m):
    return _edits(m)[0]


@query("w05_facility_edits_rejected", f"SELECT *, 'not_owner' AS reason FROM ({EDITS}) x WHERE facilitator_id <> facility_id % 25")
def _(m):
    return _edits(m)[1]


BATCHES = """SELECT t.trainer_id, t.trainer_session_id AS batch_id, s.start_time AS ts, x.week_day AS week_day,
lpad(CAST(8 + t.trainer_session_id % 5 AS STRING), 2, '0') || ':30:00' AS start_time, '15:00:00' AS end_time, 1 AS available
FROM trainer_sessions t JOIN facility_sessions s ON s.facility_sessions_id = t.facility_sessions_id CROSS JOIN (VALUES ('monday'), ('friday')) AS x(week_day)"""


@query("w06_replace_trainer_hours", f"""
WITH e AS (SELECT * FROM ({BATCHES}) z), n AS (SELECT trainer_id, arg_max(batch_id, (ts, batch_id)) AS batch_id FROM e GROUP BY 1)
SELECT trainer_id, week_day, start_time, end_time, available FROM trainer_availability_hours WHERE trainer_id NOT IN (SELECT trainer_id FROM n) UNION ALL
SELECT e.trainer_id, week_day, start_time, end_time, available FROM e JOIN n ON n.trainer_id = e.trainer_id AND n.batch_id = e.batch_id""")
def _(m):
    old = m.trainer_availability_hours.drop("trainer_availability_hour_id")
    return a.replace_children(old, m.derive(BATCHES), "trainer_id").select(*old.columns)


@query("w07_fan_out_posts", "SELECT user_id, post_id FROM user_unseen_posts")
def _(m):
    return a.fan_out_posts(m.posts, m.follows)


# Two thirds of the users read their feed. A post of an unknown author is not shown.
SHOWN = "SELECT x.user_id, x.post_id FROM user_unseen_posts x JOIN users u ON u.user_id = x.post_id % 15 WHERE x.user_id % 3 <> 0"


def _delivered(m):
    feed = s.community_feed(m.user_unseen_posts.where("user_id % 3 <> 0"), m.posts, m.users, m.likes, m.comments, m.post_img)
    return feed.select("user_id", "post_id")


@query("w08_consume_feed", f"SELECT q.user_id, q.post_id FROM user_unseen_posts q LEFT JOIN (SELECT DISTINCT user_id FROM ({SHOWN})) d ON d.user_id = q.user_id WHERE d.user_id IS NULL")
def _(m):
    return a.consume_feed(m.user_unseen_posts, _delivered(m))


@query("w08_consume_feed_delivered_only", f"""
WITH ranked AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY post_id DESC) AS rn FROM ({SHOWN}) x)
SELECT q.user_id, q.post_id FROM user_unseen_posts q LEFT JOIN (SELECT user_id, post_id FROM ranked WHERE rn <= 10) d ON d.user_id = q.user_id AND d.post_id = q.post_id WHERE d.user_id IS NULL""")
def _(m):
    return a.consume_feed(m.user_unseen_posts, _delivered(m), delivered_only=True)


CHAT = "SELECT comment_id AS event_id, time AS ts, user_id, post_id % 40 AS friend_user_id FROM comments"


@query("w09_create_chats", f"""
WITH e AS (SELECT DISTINCT least(user_id, friend_user_id) AS x, greatest(user_id, friend_user_id) AS y FROM ({CHAT}) c
  WHERE user_id <> friend_user_id AND friend_user_id IN (SELECT user_id FROM users)),
n AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM chats c WHERE least(c.user_id, c.friend_user_id) = e.x AND greatest(c.user_id, c.friend_user_id) = e.y))
SELECT x AS user_id, sha256(x || ':' || y) AS room_id, y AS friend_user_id, 'all' AS notification_status, 0 AS new_messages FROM n UNION ALL
SELECT y, sha256(x || ':' || y), x, 'all', 0 FROM n""")
def _(m):
    return a.create_chats(m.chats, m.derive(CHAT), m.users)[0]


@query("w09_create_chats_rejected", f"""
WITH t AS (SELECT c.*, friend_user_id IN (SELECT user_id FROM users) AS known,
  EXISTS (SELECT 1 FROM chats h WHERE (h.user_id = c.user_id AND h.friend_user_id = c.friend_user_id) OR (h.user_id = c.friend_user_id AND h.friend_user_id = c.user_id)) AS there,
  row_number() OVER (PARTITION BY least(user_id, friend_user_id), greatest(user_id, friend_user_id) ORDER BY ts, event_id) AS rn FROM ({CHAT}) c)
SELECT event_id, ts, user_id, friend_user_id, CASE WHEN NOT known THEN 'unknown_user' WHEN user_id = friend_user_id THEN 'self' WHEN there THEN 'exists' ELSE 'repeated' END AS reason
FROM t WHERE NOT known OR user_id = friend_user_id OR there OR rn > 1""")
def _(m):
    return a.create_chats(m.chats, m.derive(CHAT), m.users)[1]


NOTES = """SELECT l.like_id AS event_id, 'like' AS event_type, TIMESTAMP '2024-02-01 10:00:00' AS ts, l.user_id AS actor_id, p.user_id AS receiver_id, CAST(l.post_id AS STRING) AS object_id, CAST(NULL AS STRING) AS content, CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS STRING) AS day, CAST(NULL AS STRING) AS start_time, CAST(NULL AS STRING) AS end_time FROM likes l JOIN posts p ON p.post_id = l.post_id
UNION ALL SELECT c.comment_id, 'comment', c.time, c.user_id, p.user_id, CAST(c.post_id AS STRING), c.content, NULL, NULL, NULL, NULL FROM comments c JOIN posts p ON p.post_id = c.post_id
UNION ALL SELECT follow_id, 'follow', TIMESTAMP '2024-02-01 11:00:00', follower_user_id, followed_user_id, CAST(followed_user_id AS STRING), NULL, NULL, NULL, NULL, NULL FROM follows
UNION ALL SELECT r.review_facility_id, 'review', r.time, r.user_id, fa.user_id, CAST(r.facility_id AS STRING), r.content, r.rating, NULL, NULL, NULL FROM review_facility r JOIN facilities f ON f.facility_id = r.facility_id JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id
UNION ALL SELECT b.book_id, 'booking', CAST(b.time AS TIMESTAMP_NTZ), b.user_id, b.user_id, CAST(b.book_id AS STRING), NULL, NULL, CAST(b.time AS STRING), CAST(b.time AS STRING) || ' ' || b.start_time, CAST(b.time AS STRING) || ' ' || b.end_time FROM books b
UNION ALL SELECT m.message_id, 'message', m.time, c.user_id, c.friend_user_id, c.room_id, m.content, NULL, NULL, NULL, NULL FROM messages m JOIN chats c ON c.chat_id = m.chat_id
UNION ALL SELECT c.chat_id, 'chat_request', TIMESTAMP '2024-03-05 09:00:00', c.user_id, c.friend_user_id, c.room_id, NULL, NULL, NULL, NULL, NULL FROM chats c"""


@query("w11_make_notifications", f"""
WITH n AS (SELECT n.*, u.first_name || ' ' || u.last_name AS who, u.type AS role, strftime(ts - INTERVAL 15 DAY, '%Y-%m-%d') AS d0, strftime(ts, '%Y-%m-%d') AS d1
  FROM ({NOTES.replace("TIMESTAMP_NTZ", "TIMESTAMP")}) n LEFT JOIN users u ON u.user_id = n.actor_id)
SELECT event_id, event_type, receiver_id AS user_id, ts AS time, 'no' AS read_status,
  CASE event_type WHEN 'like' THEN 'New like' WHEN 'follow' THEN 'New follower' WHEN 'comment' THEN 'New comment' WHEN 'review' THEN 'New Review'
    WHEN 'chat_request' THEN 'New message request' WHEN 'booking' THEN 'Booking Confirmation' ELSE 'New message from ' || who END AS title,
  CASE event_type WHEN 'like' THEN who || ' liked your post' WHEN 'follow' THEN who || ' has followed you'
    WHEN 'review' THEN 'Your facility have a new review of ' || CAST(CAST(rating AS BIGINT) AS VARCHAR) || ' star: ' || content
    WHEN 'chat_request' THEN who || ' has sent you a message request'
    WHEN 'booking' THEN 'Payment successful and session has been booked for ' || day || ' from ' || start_time || ' to ' || end_time ELSE content END AS content,
  CASE WHEN event_type IN ('like', 'comment') THEN '/api/user/post/' || object_id || '?page=1&limit=10' WHEN event_type = 'follow' THEN '/api/user/profile/' || actor_id || '?page=1&limit=5'
    WHEN event_type = 'review' THEN '/api/' || role || '/facility/' || object_id WHEN event_type = 'booking' THEN '/api/' || role || '/session/' || object_id
    ELSE '/api/user/messages/' || object_id || '?start_time=' || d0 || '&end_time=' || d1 END AS redirect FROM n""")
def _(m):
    return a.make_notifications(m.derive(NOTES), m.users)


READ_ID = "SELECT user_id + CASE WHEN notification_id % 11 = 0 THEN 1 ELSE 0 END AS user_id, notification_id FROM notifications WHERE title = 'click'"
READ_DAY = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM socket_events WHERE event = 'connect_user'"


@query("w12_mark_read", f"""
SELECT notification_id, user_id, title, content, time, redirect, CASE WHEN (user_id, notification_id) IN ({READ_ID}) OR (user_id, CAST(time AS DATE)) IN ({READ_DAY}) THEN 'yes' ELSE read_status END AS read_status
FROM notifications""")
def _(m):
    return a.mark_read(m.notifications, m.derive(READ_ID), m.derive(READ_DAY))


STATUS = """SELECT m.message_id AS event_id, m.time AS ts, m.chat_id AS chat_id, c.user_id + CASE WHEN m.message_id % 4 = 0 THEN 1 ELSE 0 END AS user_id,
CASE m.message_id % 3 WHEN 0 THEN 'muted' WHEN 1 THEN 'all' ELSE 'silent' END AS status FROM messages m JOIN chats c ON c.chat_id = m.chat_id"""


@query("w13_set_chat_status", f"""
WITH e AS (SELECT * FROM ({STATUS}) x WHERE status <> 'silent' AND (chat_id, user_id) IN (SELECT chat_id, user_id FROM chats) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c.chat_id, c.user_id, room_id, friend_user_id, last_accessed, coalesce(e.status, c.notification_status) AS notification_status, new_messages FROM chats c LEFT JOIN e ON e.chat_id = c.chat_id""")
def _(m):
    return a.set_chat_status(m.chats, m.derive(STATUS))[0]


@query("w13_set_chat_status_rejected", f"""
SELECT event_id, CASE WHEN status = 'silent' THEN 'invalid_status' ELSE 'not_owner' END AS reason FROM ({STATUS}) x
WHERE status = 'silent' OR (chat_id, user_id) NOT IN (SELECT chat_id, user_id FROM chats)""")
def _(m):
    return a.set_chat_status(m.chats, m.derive(STATUS))[1].select("event_id", "reason")


READS = "SELECT c.chat_id, c.user_id + CASE WHEN m.message_id % 4 = 0 THEN 1 ELSE 0 END AS user_id, m.time AS ts FROM messages m JOIN chats c ON c.chat_id = m.chat_id"


@query("w14_reset_unread", f"""
WITH r AS (SELECT x.* FROM ({READS}) x JOIN chats c ON c.chat_id = x.chat_id AND c.user_id = x.user_id), o AS (SELECT chat_id, max(ts) AS t FROM r GROUP BY 1)
SELECT c.chat_id, c.user_id, room_id, friend_user_id, coalesce(o.t, last_accessed) AS last_accessed, notification_status,
  CASE WHEN c.user_id IN (SELECT user_id FROM r) THEN 0 ELSE new_messages END AS new_messages FROM chats c LEFT JOIN o ON o.chat_id = c.chat_id""")
def _(m):
    return a.reset_unread(m.chats, m.derive(READS))


# canceled facility bookings were paid before, and some paid bookings are canceled later
PAY = """SELECT event_id, ts, transaction_id, type, description FROM payment_events
UNION ALL SELECT -event_id - 1, ts - INTERVAL '1' HOUR, 'early_' || CAST(event_id AS STRING), 'payment_intent.succeeded', description FROM payment_events WHERE type = 'payment_intent.canceled' AND description LIKE '%"trainer_id":null%'
UNION ALL SELECT event_id + 900000000, ts, 'lost_' || CAST(event_id AS STRING), type,
  '{"user_id":1,"facility_id":1,"trainer_id":1,"book_id":' || CAST(900000001 + event_id * 4 AS STRING) || '}' FROM payment_events WHERE type <> 'payment_intent.created' AND event_id % 9 = 0
UNION ALL SELECT -event_id - 1, ts + INTERVAL '1' HOUR, 'late_' || CAST(event_id AS STRING), 'payment_intent.canceled', description FROM payment_events WHERE type = 'payment_intent.succeeded' AND description LIKE '%"facility_id":1%'"""
PAID = f"""ev AS (SELECT *, CAST(regexp_extract(description, '"book_id":([0-9]+)', 1) AS BIGINT) AS book_id FROM ({PAY}) p),
sm AS (SELECT book_id, min((ts, event_id, transaction_id)) FILTER (WHERE type = 'payment_intent.succeeded') AS pd, min((ts, event_id)) FILTER (WHERE type = 'payment_intent.canceled') AS gn,
  arg_min(transaction_id, (ts, event_id)) FILTER (WHERE type = 'payment_intent.succeeded') AS tx, min(ts) FILTER (WHERE type = 'payment_intent.succeeded') AS pt, min(ts) FILTER (WHERE type = 'payment_intent.canceled') AS gt FROM ev GROUP BY 1),
st AS (SELECT book_id, tx, pt IS NOT NULL AND (gt IS NULL OR pt < gt) AS paid, gt IS NOT NULL AS gone FROM sm)"""
PAY_ROWS = """SELECT p.book_id, total_amount, currency, CASE WHEN s.paid AND p.status = 'pending' THEN 'success' ELSE p.status END AS status,
  CASE WHEN s.paid AND p.status = 'pending' THEN s.tx ELSE p.transaction_id END AS transaction_id FROM {t} p LEFT JOIN st s ON s.book_id = p.book_id
WHERE NOT (coalesce(s.gone, false) AND p.book_id IN (SELECT {k} FROM {b}))"""


def _settled(m):
    return a.settle_payments(m.payments, m.payments_facility, m.books, m.book_facilities, m.users, m.facilities, m.derive(PAY))


@query("w15_payments", f"WITH {PAID} " + PAY_ROWS.format(t="payments", b="books", k="book_id"))
def _(m):
    return _settled(m)["payments"]


@query("w15_payments_facility", f"WITH {PAID} " + PAY_ROWS.format(t="payments_facility", b="book_facilities", k="book_facility_id"))
def _(m):
    return _settled(m)["payments_facility"]


@query("w15_books", f"WITH {PAID} SELECT b.* FROM books b WHERE NOT EXISTS (SELECT 1 FROM st s JOIN payments p ON p.book_id = s.book_id WHERE s.gone AND s.book_id = b.book_id)")
def _(m):
    return _settled(m)["books"]


@query("w15_book_facilities", f"WITH {PAID} SELECT b.* FROM book_facilities b WHERE NOT EXISTS (SELECT 1 FROM st s JOIN payments_facility p ON p.book_id = s.book_id WHERE s.gone AND s.book_id = b.book_facility_id)")
def _(m):
    return _settled(m)["book_facilities"]


PAID_SESSIONS = f"""
WITH {ALL}, {PAID}, pp AS (SELECT 'trainer' AS kind, book_id, status FROM payments UNION ALL SELECT 'facility', book_id, status FROM payments_facility)
SELECT b.kind, b.book_id, b.user_id, b.facility_id, b.trainer_id, u.first_name || ' -> ' || f.name AS name, 'upcoming' AS status,
  CAST(CAST(b.time AS VARCHAR) || ' ' || b.start_time AS TIMESTAMP) AS start_time, CAST(CAST(b.time AS VARCHAR) || ' ' || b.end_time AS TIMESTAMP) AS end_time
FROM allb b JOIN pp ON pp.kind = b.kind AND pp.book_id = b.book_id AND pp.status = 'pending' JOIN st s ON s.book_id = b.book_id AND s.paid
LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN facilities f ON f.facility_id = b.facility_id"""


@query("w15_sessions", PAID_SESSIONS)
def _(m):
    return _settled(m)["sessions"]


@query("w15_trainer_sessions", f"SELECT book_id, trainer_id FROM ({PAID_SESSIONS}) x WHERE trainer_id IS NOT NULL")
def _(m):
    return _settled(m)["trainer_sessions"]


@query("w15_rejected", f"""
WITH {PAID} SELECT event_id, ts, transaction_id, type, book_id, book_id % 4 <> 0 AS with_trainer FROM ev WHERE type <> 'payment_intent.created'
AND NOT EXISTS (SELECT 1 FROM payments p WHERE p.book_id = ev.book_id) AND NOT EXISTS (SELECT 1 FROM payments_facility p WHERE p.book_id = ev.book_id)""")
def _(m):
    return _settled(m)["rejected"]


# everybody asks to pay every own booking twice; the user after them asks, too, and names both kinds
ASK_PAY = """SELECT book_id * 4 AS event_id, CAST(time AS TIMESTAMP_NTZ) AS ts, user_id, book_id, CAST(NULL AS BIGINT) AS book_facility_id, 'usd' AS currency FROM books
UNION ALL SELECT book_id * 4 + 1, CAST(time AS TIMESTAMP_NTZ), user_id, book_id, NULL, 'eur' FROM books
UNION ALL SELECT book_id * 4 + 2, CAST(time AS TIMESTAMP_NTZ), user_id + 1, book_id, NULL, 'usd' FROM books
UNION ALL SELECT book_id * 4 + 3, CAST(time AS TIMESTAMP_NTZ), user_id, book_id, book_id, 'usd' FROM books
UNION ALL SELECT book_facility_id * 4, CAST(time AS TIMESTAMP_NTZ), user_id, NULL, book_facility_id, 'usd' FROM book_facilities"""
ASK_ORACLE = f"""{ALL}, e AS (SELECT *, CASE WHEN book_id IS NOT NULL THEN 'trainer' ELSE 'facility' END AS kind, coalesce(book_id, book_facility_id) AS b FROM ({ASK_PAY.replace("TIMESTAMP_NTZ", "TIMESTAMP")}) x),
open AS (SELECT 'trainer' AS kind, book_id AS b FROM payments WHERE status = 'pending' UNION ALL SELECT 'facility', book_id FROM payments_facility WHERE status = 'pending'),
t AS (SELECT e.*, (book_id IS NULL) = (book_facility_id IS NULL) AS wrong, NOT EXISTS (SELECT 1 FROM allb a WHERE a.kind = e.kind AND a.book_id = e.b AND a.user_id = e.user_id) AS foreign_,
  EXISTS (SELECT 1 FROM open o WHERE o.kind = e.kind AND o.b = e.b) AS pend FROM e),
won AS (SELECT * FROM t WHERE NOT wrong AND NOT foreign_ AND NOT pend QUALIFY row_number() OVER (PARTITION BY kind, b ORDER BY ts, event_id) = 1)"""


def _asked(m):
    bills = b.booking_summary(m.books, m.book_facilities, m.facilities, m.review_facility, m.facility_img, m.trainers, m.users)
    return a.create_payments(m.payments, m.payments_facility, bills, m.derive(ASK_PAY))


@query("w15_create_payments", f"""
WITH {ASK_ORACLE} SELECT w.kind, w.b AS book_id, CAST(floor((f.hourly_rate + coalesce(tr.hourly_rate, 0)) * 100 + 0.5) AS BIGINT) AS total_amount, w.currency, 'pending' AS status
FROM won w JOIN allb a ON a.kind = w.kind AND a.book_id = w.b JOIN facilities f ON f.facility_id = a.facility_id LEFT JOIN trainers tr ON tr.trainer_id = a.trainer_id""")
def _(m):
    return _asked(m)[0]


@query("w15_create_payments_rejected", f"""
WITH {ASK_ORACLE} SELECT event_id, CASE WHEN wrong THEN 'one_booking_needed' WHEN foreign_ THEN 'not_booked' WHEN pend THEN 'already_pending' ELSE 'repeated' END AS reason
FROM t WHERE event_id NOT IN (SELECT event_id FROM won)""")
def _(m):
    return _asked(m)[1].select("event_id", "reason")


@query("w16_validate_hours", """
SELECT facility_id, week_day, 'structure' AS failed FROM facility_availability_hours WHERE available = 0 AND start_time IS NOT NULL""")
def _(m):
    bad = q.validate(m.facility_availability_hours, q.hours_rules())[1]
    return bad.select("facility_id", "week_day", F.array_join("failed", ",").alias("failed"))


@query("w16_validate_email", r"""
SELECT user_id, email, 'email' AS failed FROM users WHERE NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')""")
def _(m):
    from courtside.operators.filters import EMAIL_PATTERN

    bad = q.validate(m.users, {"email": F.col("email").rlike(EMAIL_PATTERN)})[1]
    return bad.select("user_id", "email", F.array_join("failed", ",").alias("failed"))


# every eleventh session begins as it ends, every thirteenth ends before, and every seventeenth has no beginning
SESSIONS = """SELECT facility_sessions_id, CASE WHEN facility_sessions_id % 17 = 0 THEN NULL WHEN facility_sessions_id % 11 = 0 THEN end_time ELSE start_time END AS start_time,
  CASE WHEN facility_sessions_id % 13 = 0 THEN start_time - INTERVAL '1' HOUR WHEN facility_sessions_id % 19 = 0 THEN NULL ELSE end_time END AS end_time FROM facility_sessions"""


@query("w16_validate_dates", f"""
SELECT facility_sessions_id, CASE WHEN start_time IS NOT NULL THEN 'date_order' WHEN end_time IS NULL THEN 'missing_start_time' ELSE 'missing_start_time,date_order' END AS failed
FROM ({SESSIONS}) x WHERE start_time IS NULL OR start_time >= end_time""")
def _(m):
    bad = q.validate(m.derive(SESSIONS), q.date_order("start_time", "end_time"))[1]
    return bad.select("facility_sessions_id", F.array_join("failed", ",").alias("failed"))


CASCADE = ["users", "athletes", "parents", "children", "posts", "post_img", "likes", "comments", "comment_likes", "follows", "chats", "messages", "unseen_messages",
           "notifications", "books", "book_facilities", "payments", "payments_facility", "facility_sessions", "trainer_sessions", "review_trainer", "review_trainer_img", "favorite_trainer", "token_management"]
ASKED = "SELECT t.user_id FROM token_management t JOIN blacklisted_token b ON b.refresh_token = t.token"
# payments refer to bookings without a cascade: whoever has paid for one, or has to, stays
PAYERS = "SELECT user_id FROM books WHERE book_id IN (SELECT book_id FROM payments) UNION SELECT user_id FROM book_facilities WHERE book_facility_id IN (SELECT book_id FROM payments_facility)"
GONE = f"SELECT x.user_id FROM ({ASKED}) x LEFT JOIN ({PAYERS}) k ON k.user_id = x.user_id WHERE k.user_id IS NULL"
ROW_KEYS = {"likes": "like_id", "comment_likes": "comment_like_id", "follows": "follow_id", "favorite_trainer": "user_id * 1000000 + trainer_id", "token_management": "user_id", "unseen_messages": "unseen_message_id"} | {
    "users": "user_id", "athletes": "athlete_id", "parents": "parent_id", "children": "child_id", "posts": "post_id", "post_img": "post_img_id", "comments": "comment_id", "chats": "chat_id",
    "messages": "message_id", "notifications": "notification_id", "books": "book_id", "book_facilities": "book_facility_id", "payments": "book_id", "payments_facility": "book_id",
    "facility_sessions": "facility_sessions_id", "trainer_sessions": "trainer_session_id", "review_trainer": "review_trainer_id", "review_trainer_img": "review_trainer_img_id"}
SURVIVE = {
    "book_facilities": "NOT IN_G(user_id)", "payments": "true", "payments_facility": "true",
    "users": "NOT IN_G(user_id)", "athletes": "NOT IN_G(user_id)", "parents": "NOT IN_G(user_id)", "children": "NOT IN_G(parent_id)", "posts": "NOT IN_G(user_id)",
    "post_img": "NOT IN_P(post_id)", "likes": "NOT IN_G(user_id) AND NOT IN_P(post_id)", "comments": "NOT IN_G(user_id) AND NOT IN_P(post_id)",
    "comment_likes": "NOT IN_G(user_id) AND comment_id NOT IN (SELECT comment_id FROM comments WHERE IN_G(user_id) OR IN_P(post_id))",
    "follows": "NOT IN_G(follower_user_id) AND NOT IN_G(followed_user_id)", "chats": "NOT IN_G(user_id) AND NOT IN_G(friend_user_id)", "messages": "NOT IN_C(chat_id)",
    "unseen_messages": "NOT IN_G(user_id) AND message_id NOT IN (SELECT message_id FROM messages WHERE IN_C(chat_id))", "notifications": "NOT IN_G(user_id)", "books": "NOT IN_G(user_id)",
    "facility_sessions": "NOT IN_G(user_id)", "trainer_sessions": "facility_sessions_id NOT IN (SELECT facility_sessions_id FROM facility_sessions WHERE IN_G(user_id))",
    "review_trainer": "NOT IN_G(user_id)", "review_trainer_img": "review_trainer_id NOT IN (SELECT review_trainer_id FROM review_trainer WHERE IN_G(user_id))",
    "favorite_trainer": "NOT IN_G(user_id)", "token_management": "NOT IN_G(user_id)",
}


def _cascade_sql(rule):
    for tag, sub in (("IN_G", "SELECT user_id FROM gone"), ("IN_P", "SELECT post_id FROM gp"), ("IN_C", "SELECT chat_id FROM gc")):
        while f"NOT {tag}(" in rule:
            i = rule.index(f"NOT {tag}(")
            j = rule.index(")", i)
            rule = rule[:i] + rule[i + len(tag) + 5 : j] + f" NOT IN ({sub})" + rule[j + 1 :]
        while f"{tag}(" in rule:
            i = rule.index(f"{tag}(")
            j = rule.index(")", i)
            rule = rule[:i] + rule[i + len(tag) + 1 : j] + f" IN ({sub})" + rule[j + 1 :]
    return rule


@query("w17_cascade_delete", f"WITH gone AS ({GONE}), gp AS (SELECT post_id FROM posts WHERE user_id IN (SELECT user_id FROM gone)), "
       "gc AS (SELECT chat_id FROM chats WHERE user_id IN (SELECT user_id FROM gone) OR friend_user_id IN (SELECT user_id FROM gone)) "
       + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {ROW_KEYS[t]} AS row_key FROM {t} WHERE {_cascade_sql(r)}" for t, r in SURVIVE.items())
       + f" UNION ALL SELECT 'refused', user_id FROM ({ASKED}) x WHERE user_id NOT IN (SELECT user_id FROM gone)")
def _(m):
    left, refused = q.cascade_delete({t: getattr(m, t) for t in CASCADE}, "users", m.derive(ASKED))
    rows = [left[t].selectExpr(f"'{t}' AS table_name", f"{ROW_KEYS[t]} AS row_key") for t in CASCADE] + [refused.selectExpr("'refused' AS table_name", "user_id AS row_key")]
    return reduce(lambda x, y: x.unionByName(y), rows)


AUDIT = {"users": [("user_id", None, None)], "payments": [("book_id", "books", "book_id")], "comment_likes": [("comment_id", "comments", "comment_id"), ("user_id", "users", "user_id")],
         "comments": [("post_id", "posts", "post_id"), ("user_id", "users", "user_id")], "likes": [("post_id", "posts", "post_id"), ("user_id", "users", "user_id")],
         "notifications": [("user_id", "users", "user_id")], "messages": [("chat_id", "chats", "chat_id")], "chats": [("user_id", "users", "user_id"), ("friend_user_id", "users", "user_id")],
         "books": [("user_id", "users", "user_id")], "posts": [("user_id", "users", "user_id")]}


@query("w18_audit_integrity", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, 'foreign_key' AS rule, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p}) GROUP BY ALL"
    for t, rules in AUDIT.items() for c, p, k in rules if p)
    + "\nUNION ALL\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}', 'unique', '{c}', CAST({c} AS VARCHAR), count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"
    for t, c in q.UNIQUE_KEYS if t in AUDIT))
def _(m):
    return q.audit_integrity({t: getattr(m, t) for t in AUDIT})


@query("w18_missing_values", """
SELECT * FROM (SELECT 'profile_picture' AS column_name, count(*) AS n FROM users WHERE profile_picture IS NULL UNION ALL SELECT 'phone', count(*) FROM users WHERE phone IS NULL
UNION ALL SELECT 'socket_id', count(*) FROM users WHERE socket_id IS NULL UNION ALL SELECT 'email', count(*) FROM users WHERE email IS NULL) WHERE n > 0""")
def _(m):
    return q.missing_values(m.users, ["profile_picture", "phone", "socket_id", "email"])


@query("w19_assign_ids", "SELECT notification_id, time, row_number() OVER (ORDER BY time, notification_id) + (SELECT max(notification_id) FROM notifications) AS id FROM notifications")
def _(m):
    rows = m.notifications.select("notification_id", "time")
    return a.assign_ids(rows, [F.col("time"), F.col("notification_id")], a.next_id(m.notifications, "notification_id"))


SIGNUPS = """SELECT c_custkey AS event_id, TIMESTAMP '2024-05-01 00:00:00' + CAST(c_custkey AS INT) * INTERVAL '1' SECOND AS ts,
CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'New Person ' || c_mktsegment END AS full_name,
CASE WHEN c_custkey % 13 = 0 THEN 'NATION_1@x.org' WHEN c_custkey % 11 = 0 THEN 'no-mail' ELSE 'p' || CAST(c_custkey - c_custkey % 2 AS STRING) || '@mail.org' END AS email,
CASE c_custkey % 5 WHEN 0 THEN 'athlete' WHEN 1 THEN 'trainer' WHEN 2 THEN 'facilitator' WHEN 3 THEN 'parent' ELSE 'robot' END AS type,
CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 20 + c_custkey % 20 END AS INT) AS age, CAST(70 AS DOUBLE) AS weight, CAST(180 AS INT) AS height,
'soccer' AS sport_interest, 'beginner' AS sport_level, 'female' AS gender, CAST(25 AS DOUBLE) AS hourly_rate, 'soccer' AS specialization, 'advanced' AS specialization_level,
CAST(41.5 AS DOUBLE) AS latitude, CAST(-73.5 AS DOUBLE) AS longitude FROM customer"""
REG = f"""s AS ({SIGNUPS}), good AS (SELECT * FROM s WHERE full_name <> '' AND email <> 'no-mail' AND email NOT IN (SELECT email FROM users)
  QUALIFY row_number() OVER (PARTITION BY email ORDER BY ts, event_id) = 1)"""


def _signups(m):
    kids = F.array(*[F.struct(F.concat(F.lit(f"Kid{i} "), F.col("event_id").cast("string")).alias("name"), F.lit(7 + i).alias("age"),
                              F.when(F.col("event_id") % 9 != 0, F.lit("male")).alias("gender"), F.lit("tennis").alias("sport_interest"), F.lit("beginner").alias("sport_level")) for i in range(2)])
    return m.derive(SIGNUPS).withColumn("no_of_professionals", F.lit(0)).withColumn("children", kids)


@query("w20_register_users", f"WITH {REG} SELECT event_id, 'New' AS first_name, substr(full_name, 5) AS last_name, email, type FROM good")
def _(m):
    return a.register_users(m.users, _signups(m))[0].select("event_id", "first_name", "last_name", "email", "type")


@query("w20_register_rejected", f"""
WITH {REG} SELECT event_id, CASE WHEN full_name = '' AND email = 'no-mail' THEN 'invalid_full_name_email' WHEN full_name = '' THEN 'invalid_full_name' WHEN email = 'no-mail' THEN 'invalid_email' ELSE 'email_taken' END AS reason
FROM s WHERE event_id NOT IN (SELECT event_id FROM good)""")
def _(m):
    return a.register_users(m.users, _signups(m))[1].select("event_id", "reason")


def _roles(m):
    users = a.register_users(m.users, _signups(m))[0]
    first = a.next_id(m.users, "user_id")
    return a.register_roles(a.assign_ids(users, [F.col("ts"), F.col("event_id")], first, "user_id"))


@query("w20_register_roles", f"""
WITH {REG}, n AS (SELECT *, (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY ts, event_id) AS user_id FROM good),
ok AS (SELECT * FROM n WHERE type <> 'robot' AND NOT (type = 'athlete' AND age = 0) AND NOT (type = 'parent' AND event_id % 9 = 0))
SELECT type AS role, user_id FROM ok UNION ALL SELECT 'child', user_id FROM ok CROSS JOIN (VALUES (0), (1)) AS k(i) WHERE type = 'parent'
UNION ALL SELECT 'rejected', user_id FROM n WHERE user_id NOT IN (SELECT user_id FROM ok)""")
def _(m):
    r = _roles(m)
    parts = {"athlete": r["athletes"], "trainer": r["trainers"], "facilitator": r["facilitators"], "parent": r["parents"], "child": r["children"], "rejected": r["rejected"]}
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(k).alias("role"), "user_id") for k, df in parts.items()])


@query("w21_add_amenities", """
SELECT facility_id, list_aggregate(list_transform(string_split(v, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS name
FROM (SELECT facility_id, unnest([name, description || ' ROOM', 'free wiFi']) AS v FROM facilities)""")
def _(m):
    ev = m.facilities.select("facility_id", F.array("name", F.concat("description", F.lit(" ROOM")), F.lit("free wiFi")).alias("amenities"))
    return a.add_amenities(ev)


ASSIGN = "SELECT t.trainer_session_id AS event_id, s.facility_id AS facility_id, t.trainer_id AS e1, s.facility_id % 25 AS e2 FROM trainer_sessions t JOIN facility_sessions s ON s.facility_sessions_id = t.facility_sessions_id"


def _assign(m):
    ev = m.derive(ASSIGN).select("event_id", "facility_id", F.array("e1", "e2").alias("employees"))
    return a.assign_employees(ev, m.facilities, m.facilitator_employees)


STAFF = "(SELECT x.*, EXISTS (SELECT 1 FROM facilitator_employees h WHERE h.facilitator_id = x.facility_id % 25 AND h.trainer_id = e1) AND EXISTS (SELECT 1 FROM facilitator_employees h WHERE h.facilitator_id = x.facility_id % 25 AND h.trainer_id = e2) AS ok FROM (" + ASSIGN + ") x)"


@query("w22_assign_employees", f"SELECT facility_id, unnest([e1, e2]) AS trainer_id FROM {STAFF} WHERE ok")
def _(m):
    return _assign(m)[0]


@query("w22_assign_rejected", f"SELECT event_id, 'not_staff' AS reason FROM {STAFF} WHERE NOT ok")
def _(m):
    return _assign(m)[1].select("event_id", "reason")


IMAGES = "SELECT page_id AS post_id, page_id % 20 AS user_id, url AS img FROM pages"


@query("w23_attach_images", f"SELECT post_id, img FROM ({IMAGES}) i WHERE (post_id, user_id) IN (SELECT post_id, user_id FROM posts)")
def _(m):
    return a.attach_images(m.posts, m.derive(IMAGES), "post_id")[0]


@query("w24_live_tokens", "SELECT DISTINCT user_id, token FROM token_management WHERE token NOT IN (SELECT refresh_token FROM blacklisted_token)")
def _(m):
    return a.live_tokens(m.token_management, m.blacklisted_token)


CHILD = """SELECT c_custkey AS event_id, c_custkey AS user_id, c_custkey - c_custkey % 2 AS parent_id, 'Kid ' || c_mktsegment AS name, CAST(c_nationkey AS INT) AS age, 'female' AS gender, 'rugby' AS sport_interest,
CASE c_custkey % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'advanced' ELSE 'pro' END AS sport_level FROM customer"""


def _children(m):
    rules = {**q.required("name", "age", "gender", "sport_interest", "sport_level", "parent_id"), **q.allowed("sport_level", ["beginner", "intermediate", "advanced"])}
    return a.append_validated(m.children, m.derive(CHILD), rules, m.parents, ["user_id", "parent_id"])


@query("w25_add_children", f"""
SELECT child_id, parent_id, name, age, gender, sport_interest, sport_level FROM children UNION ALL
SELECT NULL, parent_id, name, age, gender, sport_interest, sport_level FROM ({CHILD}) e WHERE age <> 0 AND parent_id <> 0 AND sport_level <> 'pro' AND (user_id, parent_id) IN (SELECT user_id, parent_id FROM parents)""")
def _(m):
    return _children(m)[0]


@query("w25_add_children_rejected", f"""
SELECT event_id, CASE WHEN age <> 0 AND parent_id <> 0 AND sport_level <> 'pro' THEN 'not_owner' ELSE concat_ws(',', CASE WHEN age = 0 THEN 'missing_age' END, CASE WHEN parent_id = 0 THEN 'missing_parent_id' END, CASE WHEN sport_level = 'pro' THEN 'invalid_sport_level' END) END AS reason
FROM ({CHILD}) e WHERE NOT (age <> 0 AND parent_id <> 0 AND sport_level <> 'pro' AND (user_id, parent_id) IN (SELECT user_id, parent_id FROM parents))""")
def _(m):
    return _children(m)[1].select("event_id", "reason")


def _new_facilities(m):
    p = m.part
    hour = lambda day, s, e, v: F.struct(day.alias("week_day"), F.lit(s).alias("start_time"), e.alias("end_time"), F.lit(v).alias("available"))
    hours = F.array(
        hour(F.when(p.p_partkey % 10 == 0, F.lit("funday")).otherwise(F.lit("monday")), "09:00:00", F.lit("17:00:00"), 1),
        hour(F.lit("friday"), "10:00:00", F.when(p.p_partkey % 7 == 0, F.lit("09:00:00")).otherwise(F.lit("12:30:00")), 0),
    )
    ev = p.select(F.col("p_partkey").alias("event_id"), (F.col("p_partkey") % 25).alias("facilitator_id"), F.col("p_retailprice").alias("hourly_rate"), F.col("p_name").alias("name"),
                  F.lit(40.5).alias("latitude"), F.lit(-73.9).alias("longitude"), F.col("p_size").alias("capacity"), F.lit(2000).alias("established_in"), hours.alias("available_hours"))
    return a.add_facilities(ev)


@query("w26_add_facilities", """
SELECT p_partkey AS event_id, p_partkey % 25 AS facilitator_id, p_retailprice AS hourly_rate, p_name AS name, CAST(40.5 AS DOUBLE) AS latitude, CAST(-73.9 AS DOUBLE) AS longitude, p_size AS capacity, 2000 AS established_in
FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0""")
def _(m):
    return _new_facilities(m)[0]


@query("w26_add_facility_hours", """
SELECT p_partkey AS event_id, unnest(['monday', 'friday']) AS week_day, unnest(['09:00:00', '10:00:00']) AS start_time, unnest(['17:00:00', '12:30:00']) AS end_time, unnest([1, 0]) AS available
FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0""")
def _(m):
    return _new_facilities(m)[1]


@query("w26_add_facilities_rejected", """
SELECT p_partkey AS event_id, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'time_order' END, CASE WHEN p_partkey % 10 = 0 THEN 'week_day' END) AS reason
FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0""")
def _(m):
    return _new_facilities(m)[2]


@query("g04_bookings_per_target", f"WITH {ALL} SELECT facility_id, trainer_id, time, count(*) AS n FROM allb GROUP BY ALL")
def _(m):
    return b.all_bookings(m.books, m.book_facilities).groupBy("facility_id", "trainer_id", "time").agg(F.count(F.lit(1)).alias("n"))


# The same batches on snapshots in key buckets, each in two parts by a hash of the key


def _bucketed(m, snapshot, key, events, change):
    table = BucketedTable.create(snapshot, new_path(m.spark, "snapshot"), key, 8)
    for part in (0, 1):
        table.apply(part, events.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.lit(2)) == part), change)
    return table.read()


BUCKETED = {
    "w03_unlike": lambda m: _bucketed(m, m.likes, "user_id", m.like_actions.filter("action = 'remove'"), lambda old, e: a.apply_deletes(old, e, ["user_id", "post_id"])),
    "w04_toggle_likes": lambda m: _bucketed(m, m.derive("SELECT DISTINCT user_id, post_id + 50 AS post_id FROM comments"), "user_id", m.like_actions, lambda old, e: a.apply_toggles(old, e, ["user_id", "post_id"])),
    "w05_facility_edits": lambda m: _bucketed(m, m.facilities, "facility_id", m.derive(EDITS), lambda old, e: a.apply_updates(old, e, "facility_id", ["hourly_rate", "name"], owner="facilitator_id")),
    "w06_replace_trainer_hours": lambda m: _bucketed(m, m.trainer_availability_hours.drop("trainer_availability_hour_id"), "trainer_id", m.derive(BATCHES), lambda old, e: a.replace_children(old, e, "trainer_id")),
    "w12_mark_read": lambda m: _bucketed(
        m, m.notifications, "user_id", m.derive(READ_ID).withColumn("day", F.lit(None).cast("date")).unionByName(m.derive(READ_DAY), allowMissingColumns=True),
        lambda old, e: a.mark_read(old, e.where("notification_id IS NOT NULL"), e.where("day IS NOT NULL").select("user_id", "day"))),
    "w13_set_chat_status": lambda m: _bucketed(m, m.chats, "chat_id", m.derive(STATUS), a.set_chat_status),
    "w14_reset_unread": lambda m: _bucketed(m, m.chats, "user_id", m.derive(READS), a.reset_unread),
}
for _name, _run in BUCKETED.items():
    query(f"{_name}_buckets")(_run)
    ORACLES[f"{_name}_buckets"] = ORACLES[_name]
