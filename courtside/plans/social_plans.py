"""Registered feed, chat and notification queries over whole tables."""

from pyspark.sql import functions as F

from courtside.operators import chat as c
from courtside.operators import social as s
from courtside.plans.profile_plans import FACE, _text
from courtside.plans.registry import query

IMAGE_PREFIX = "https://img.example.com/"
COUNTS = """l AS (SELECT post_id, count(*) AS n FROM likes GROUP BY 1), c AS (SELECT post_id, count(*) AS n FROM comments GROUP BY 1),
g AS (SELECT post_id, listagg(DISTINCT img, ',' ORDER BY img) AS imgs FROM post_img GROUP BY 1)"""
POST = f"p.post_id, {FACE}, coalesce(g.imgs, '') AS post_images, p.time, p.content, coalesce(l.n, 0) AS no_of_likes, coalesce(c.n, 0) AS no_of_comments"
JOINS = "JOIN users u ON u.user_id = p.user_id LEFT JOIN l ON l.post_id = p.post_id LEFT JOIN c ON c.post_id = p.post_id LEFT JOIN g ON g.post_id = p.post_id"
FEED = f"""q AS (SELECT x.user_id AS reader, x.post_id, row_number() OVER (PARTITION BY x.user_id ORDER BY p.time DESC, p.post_id DESC) AS rn
  FROM user_unseen_posts x JOIN posts p ON p.post_id = x.post_id JOIN users u ON u.user_id = p.user_id)"""
FEED_ROWS = f"SELECT q.reader AS user_id, u.user_id AS author_id, {POST} FROM q JOIN posts p ON p.post_id = q.post_id {JOINS} WHERE rn <= 10"
TOP = f"""top AS (SELECT u.user_id AS author_id, {POST} FROM posts p {JOINS} ORDER BY coalesce(l.n, 0) DESC, p.post_id LIMIT 10)"""
TOP_ROWS = """SELECT v.user_id, top.*, CASE WHEN k.like_id IS NULL THEN 0 ELSE 1 END AS has_liked FROM users v CROSS JOIN top
LEFT JOIN likes k ON k.user_id = v.user_id AND k.post_id = top.post_id"""


def _feed_args(m):
    return m.posts, m.users, m.likes, m.comments, m.post_img


@query("r39_community_feed", f"WITH {COUNTS}, {FEED} {FEED_ROWS}")
def _(m):
    return _text(s.community_feed(m.user_unseen_posts, *_feed_args(m)), "post_images")


@query("r39_feed_on_read", f"WITH {COUNTS}, {FEED} {FEED_ROWS}")
def _(m):
    return _text(s.feed_on_read(m.follows, *_feed_args(m)), "post_images")


@query("r40_recommended_posts", f"WITH {COUNTS}, {TOP} {TOP_ROWS}")
def _(m):
    return _text(s.recommended_posts(*_feed_args(m), m.users), "post_images")


@query("r39_r40_community_or_recommended", f"""
WITH {COUNTS}, {FEED}, {TOP}, feed AS ({FEED_ROWS})
SELECT *, CAST(NULL AS INTEGER) AS has_liked FROM feed UNION ALL
SELECT * FROM ({TOP_ROWS}) WHERE user_id NOT IN (SELECT user_id FROM feed)""")
def _(m):
    return _text(s.community_or_recommended(m.user_unseen_posts, *_feed_args(m), m.users), "post_images")


@query("r41_post_comments", f"""
WITH v AS (SELECT DISTINCT user_id, post_id FROM likes), n AS (SELECT comment_id, count(*) AS n FROM comment_likes GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY time DESC, comment_id) AS rn FROM comments)
SELECT v.user_id, v.post_id, q.comment_id, q.time, q.content, {FACE}, coalesce(n.n, 0) AS no_of_likes,
  CASE WHEN EXISTS (SELECT 1 FROM comment_likes k WHERE k.comment_id = q.comment_id AND k.user_id = v.user_id) THEN 1 ELSE 0 END AS has_liked
FROM v JOIN q ON q.post_id = v.post_id LEFT JOIN n ON n.comment_id = q.comment_id LEFT JOIN users u ON u.user_id = q.user_id WHERE rn <= 10""")
def _(m):
    return s.post_comments(m.comments, m.comment_likes, m.users, m.likes)


@query("r42_post_details", f"WITH {COUNTS} SELECT {POST}, least(coalesce(c.n, 0), 10) AS page_comments FROM posts p {JOINS}")
def _(m):
    return _text(s.post_details(*_feed_args(m)), "post_images")


@query("r43_follow_profile", """
WITH v AS (SELECT follower_user_id AS user_id, followed_user_id AS profile_id FROM follows UNION SELECT user_id, user_id FROM users),
a AS (SELECT followed_user_id AS k, count(DISTINCT follower_user_id) AS n FROM follows GROUP BY 1),
b AS (SELECT follower_user_id AS k, count(DISTINCT followed_user_id) AS n FROM follows GROUP BY 1)
SELECT v.user_id, v.profile_id, u.first_name, u.last_name, u.img, u.profile_picture, u.level, u.type,
  CASE WHEN v.user_id = v.profile_id THEN 1 ELSE 0 END AS own_profile, CASE WHEN f.follow_id IS NULL THEN 0 ELSE 1 END AS followed,
  coalesce(a.n, 0) AS follower_no, coalesce(b.n, 0) AS following_no
FROM v JOIN users u ON u.user_id = v.profile_id LEFT JOIN a ON a.k = v.profile_id LEFT JOIN b ON b.k = v.profile_id
LEFT JOIN follows f ON f.follower_user_id = v.user_id AND f.followed_user_id = v.profile_id""")
def _(m):
    req = m.follows.select(F.col("follower_user_id").alias("user_id"), F.col("followed_user_id").alias("profile_id"))
    return s.follow_profile(m.users, m.follows, req.unionByName(m.users.select("user_id", F.col("user_id").alias("profile_id"))))


@query("r44_own_posts", f"""
WITH {COUNTS}, q AS (SELECT post_id, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, post_id DESC) AS rn FROM posts)
SELECT u.user_id, {POST} FROM q JOIN posts p ON p.post_id = q.post_id {JOINS} WHERE rn <= 10""")
def _(m):
    return _text(s.own_posts(*_feed_args(m)), "post_images")


LATEST = """latest AS (SELECT c.room_id, arg_max(m.content, (m.time, m.message_id)) AS content, max(m.time) AS t
  FROM messages m JOIN chats c ON c.chat_id = m.chat_id GROUP BY 1)"""


@query("r45_unread_chats", f"""
WITH {LATEST}, q AS (SELECT x.user_id, m.chat_id, count(*) AS n, max(m.time) AS t FROM unseen_messages x JOIN messages m ON m.message_id = x.message_id GROUP BY 1, 2)
SELECT q.user_id, q.chat_id, c.user_id AS sender_id, c.notification_status, c.room_id, CASE WHEN u.socket_id IS NULL THEN 0 ELSE 1 END AS active,
  q.n AS no_of_messages, l.content AS latest_message_content, {FACE}, q.t AS last_message_time
FROM q JOIN chats c ON c.chat_id = q.chat_id LEFT JOIN latest l ON l.room_id = c.room_id LEFT JOIN users u ON u.user_id = c.user_id""")
def _(m):
    return c.unread_chats(m.unseen_messages, m.messages, m.chats, m.users)


@query("r46_chat_list", f"""
WITH {LATEST}, q AS (SELECT c.*, l.content, l.t, row_number() OVER (PARTITION BY c.user_id ORDER BY l.t DESC NULLS LAST, c.chat_id) AS rn
  FROM chats c LEFT JOIN latest l ON l.room_id = c.room_id)
SELECT q.user_id, q.chat_id, q.notification_status, q.friend_user_id, q.new_messages AS no_of_new_messages, CASE WHEN u.socket_id IS NULL THEN 0 ELSE 1 END AS active,
  q.content AS latest_message_content, CASE WHEN q.new_messages > 0 THEN 0 ELSE 1 END AS latest_message_seen_status, {FACE}, q.t AS last_message_time
FROM q LEFT JOIN users u ON u.user_id = q.friend_user_id WHERE rn <= 10""")
def _(m):
    return c.chat_list(m.chats, m.messages, m.users)


@query("r47_room_messages", f"""
SELECT v.user_id, v.room_id, m.message_id, m.content, m.time, c.user_id AS sender_id, u.first_name, u.last_name,
  CASE WHEN starts_with(m.content, '{IMAGE_PREFIX}') THEN 1 ELSE 0 END AS is_img
FROM (SELECT DISTINCT user_id, room_id FROM chats) v JOIN chats c ON c.room_id = v.room_id JOIN messages m ON m.chat_id = c.chat_id JOIN users u ON u.user_id = c.user_id
WHERE m.time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'""")
def _(m):
    # outsiders ask too: every member also asks for the room after their own
    strangers = m.chats.select((F.col("user_id") + 1).alias("user_id"), F.concat("room_id", F.lit("x")).alias("room_id"))
    req = m.chats.select("user_id", "room_id").unionByName(strangers)
    return c.room_messages(m.messages, m.chats, m.users, req, "2024-01-01", "2024-01-20", IMAGE_PREFIX)


@query("r48_notifications", """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, notification_id DESC) AS rn,
  count(*) FILTER (WHERE read_status = 'no') OVER (PARTITION BY user_id) AS new_notification FROM notifications)
SELECT user_id, notification_id, title, content, time, read_status, redirect, new_notification FROM q WHERE rn <= 10""")
def _(m):
    return s.notifications(m.notifications)


@query("r53_contact_presence", """
SELECT DISTINCT c.user_id, c.friend_user_id AS partner_id, u.socket_id, CASE WHEN u.socket_id IS NULL THEN 0 ELSE 1 END AS online
FROM chats c LEFT JOIN users u ON u.user_id = c.friend_user_id""")
def _(m):
    return c.contact_presence(m.chats, m.users)


@query("r54_message_receiver", """
SELECT c.chat_id, c.room_id, c.user_id AS sender_id, c.friend_user_id AS receiver_id, CASE WHEN u.socket_id IS NULL THEN 0 ELSE 1 END AS online
FROM chats c LEFT JOIN users u ON u.user_id = c.friend_user_id""")
def _(m):
    return c.message_receiver(m.chats, m.users)


@query("r55_post_owner", "SELECT post_id, p.user_id, socket_id FROM posts p LEFT JOIN users u ON u.user_id = p.user_id")
def _(m):
    return s.post_owner(m.posts, m.users)


@query("r55_facility_owner", """
SELECT facility_id, fa.user_id, socket_id FROM facilities f LEFT JOIN facilitators fa ON fa.facilitator_id = f.facilitator_id LEFT JOIN users u ON u.user_id = fa.user_id""")
def _(m):
    return s.facility_owner(m.facilities, m.facilitators, m.users)


@query("e03_unread_counters_batch", """
WITH r AS (SELECT c.user_id, c.room_id, arg_max(m.time, m.message_id) AS t FROM chats c JOIN messages m ON m.chat_id = c.chat_id GROUP BY 1, 2)
SELECT v.user_id, v.room_id, (SELECT count(*) FROM messages m JOIN chats c ON c.chat_id = m.chat_id
  WHERE c.room_id = v.room_id AND c.friend_user_id = v.user_id AND (r.t IS NULL OR m.time > r.t)) AS unread
FROM (SELECT DISTINCT user_id, room_id FROM chats) v LEFT JOIN r ON r.user_id = v.user_id AND r.room_id = v.room_id""")
def _(m):
    # writing in a room reads it
    reads = m.messages.join(m.chats, "chat_id").select("user_id", "room_id", F.col("time").alias("ts"))
    return c.unread_counters(m.messages, m.chats, reads)
