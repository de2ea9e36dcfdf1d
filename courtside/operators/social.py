"""Posts, comments, follows and notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions.common import attach_list, count_by, flag, for_keys, page_by, page_of, ranked, salted_join
from courtside.functions.store import written
from courtside.operators.profiles import FACE

AUTHOR = ["author_id", *FACE]
FIRST_BLOCK, BLOCK_STEP = 256, 64  # posts that all readers are asked about first, and how the next blocks grow


def _newest_first() -> list[Column]:
    return [F.col("time").desc(), F.col("post_id").desc()]


def _author(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_id").alias("author_id"), *FACE)


def _post_counts(df: DataFrame, likes: DataFrame, comments: DataFrame) -> DataFrame:
    """Add like and comment counts, each counted on its own before the join."""
    df = df.join(count_by(likes, "post_id", "no_of_likes"), "post_id", "left")
    df = df.join(count_by(comments, "post_id", "no_of_comments"), "post_id", "left")
    return df.fillna({"no_of_likes": 0, "no_of_comments": 0})


def community_feed(user_unseen_posts, posts, users, likes, comments, post_img, req=None, page=1, limit=10) -> DataFrame:
    """Newest unseen posts of each reader; text, counts and images are added to the page only."""
    heads = posts.select("post_id", "time", F.col("user_id").alias("author_id")).join(_author(users).select("author_id"), "author_id", "left_semi")
    top = (page or 1) * (limit or 10)
    unseen = for_keys(user_unseen_posts, req, "user_id").select("user_id", "post_id")
    got = page_by(_newest(unseen, heads.select("post_id", "time"), top), "user_id", _newest_first(), page, limit)
    return _dress(got, posts, users, likes, comments, post_img)


def _newest(unseen: DataFrame, heads: DataFrame, top: int) -> DataFrame:
    """Rows (user_id, post_id, time) among which are the ``top`` newest of each reader, without shuffling whole queues.

    Posts are looked at from the newest on, in blocks that grow by BLOCK_STEP; the last has all that are left. Of a queue only the rows of the
    block's posts are looked at, of these at most ``top`` posts of a reader leave a task, and a reader who has ``top`` rows is done, as all further
    posts are older. Blocks and what is found in them lie in the shared folder.
    """
    heads = written(heads, "feed-posts")
    n, shares = heads.count(), []
    size = max(FIRST_BLOCK, top)
    while size < n:
        shares, size = [*shares, 1 - size / n], size * BLOCK_STEP
    # approximate bounds do: each post is in one block, by its time, and posts without a time are the last
    bounds = heads.agg(F.percentile_approx("time", shares, 100_000)).first()[0] or [] if shares else []
    time, found, done, above = F.col("time"), [], None, F.lit(True)
    place = F.dense_rank().over(W.partitionBy("user_id").orderBy(*_newest_first()))
    for bound in [*(F.lit(b).cast(heads.schema["time"].dataType) for b in bounds), None]:
        here = above if bound is None else above & (time >= bound)
        above = time.isNull() if bound is None else time.isNull() | (time < bound)
        block = written(heads.where(here).groupBy("post_id", "time").agg(F.count(F.lit(1)).alias("_n")), "feed-block")
        rows = unseen if done is None else unseen.join(done, "user_id", "left_anti")
        # below the joins that a queue is made by, if it is
        rows = rows.join(block.select("post_id").distinct(), "post_id", "left_semi").join(block, "post_id")
        # repeated rows of a queue share their place, so they are told apart behind the one shuffle by reader; a post counts as often as it is there
        rows = rows.withColumn("_place", place).where(F.col("_place") <= top).drop("_place").distinct()
        rows = rows.withColumn("_n", F.explode(F.array_repeat("_n", F.col("_n").cast("int"))))
        found.append(written(ranked(rows, "user_id", _newest_first(), top).select("user_id", "post_id", "time"), "feed-found"))
        if bound is not None:
            full = reduce(DataFrame.union, found).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            done = written(full.where(F.col("n") >= top).select("user_id"), "feed-done")
    return reduce(DataFrame.union, found)


def _dress(got: DataFrame, posts, users, likes, comments, post_img) -> DataFrame:
    """Add author, text, counts and images to (user_id, post_id, author_id, time) rows, once per distinct post."""
    shown = got.select("post_id").distinct()
    cards = posts.select("post_id", "content", "time", F.col("user_id").alias("author_id")).join(shown, "post_id", "left_semi")
    cards = _post_counts(cards, likes, comments).join(_author(users), "author_id")
    cards = attach_list(cards, post_img.withColumnRenamed("img", "post_img"), "post_id", "post_id", "post_img", "post_images")
    return salted_join(got.select("user_id", "post_id"), cards, "post_id", ["user_id"], salts=8).select(
        "user_id", "post_id", *AUTHOR, "post_images", "time", "content", "no_of_likes", "no_of_comments")


def feed_on_read(follows, posts, users, likes, comments, post_img, req=None, page=1, limit=10) -> DataFrame:
    """R39 for readers who have consumed nothing yet, straight from follows without a stored queue.

    Only an author's newest ``page * limit`` posts can be on a page, so each follow brings at most that many
    rows however much the author wrote.
    """
    order = _newest_first()
    edges = follows.filter(F.col("notification_status") == "all").withColumnRenamed("follower_user_id", "user_id")
    edges = for_keys(edges, req, "user_id").select("user_id", F.col("followed_user_id").alias("author_id")).distinct()
    heads = page_by(posts.select("post_id", "time", F.col("user_id").alias("author_id")), "author_id", order, 1, page * limit)
    rows = salted_join(edges, heads, "author_id", ["user_id"])
    return _dress(page_by(rows, "user_id", order, page, limit), posts, users, likes, comments, post_img)


def recommended_posts(posts, users, likes, comments, post_img, req, page=1, limit=10) -> DataFrame:
    """The most liked posts with each viewer's own like.

    The page is ranked once for everybody (at most ``limit`` rows). Its ids, and at the end its cards, reach
    the viewers from scalar subqueries; only (user_id, post_id) rows are shuffled, to look up the own likes.
    """
    ranked = posts.select("post_id", F.col("user_id").alias("author_id")).join(users.select(F.col("user_id").alias("author_id")), "author_id", "left_semi")
    ranked = ranked.join(count_by(likes, "post_id", "no_of_likes"), "post_id", "left").fillna({"no_of_likes": 0})
    top = page_of(ranked, [F.col("no_of_likes").desc(), F.col("post_id")], page, limit)
    cards = top.join(posts.select("post_id", "time", "content"), "post_id").join(_author(users), "author_id")
    n = count_by(comments.join(top.select("post_id"), "post_id", "left_semi"), "post_id", "no_of_comments")
    cards = cards.join(n, "post_id", "left").fillna({"no_of_comments": 0})
    cards = attach_list(cards, post_img.withColumnRenamed("img", "post_img"), "post_id", "post_id", "post_img", "post_images")
    cols = [*AUTHOR, "post_images", "time", "content", "no_of_likes", "no_of_comments"]
    ids = top.agg(F.collect_list("post_id").alias("a"))
    rows = req.select("user_id", F.explode(ids.scalar()).alias("post_id"))
    liked = likes.join(top.select("post_id"), "post_id", "left_semi")
    rows = flag(rows, liked, ["user_id", "post_id"], "has_liked")
    by_id = cards.agg(F.map_from_entries(F.collect_list(F.struct("post_id", F.struct(*cols)))).alias("m"))
    return rows.withColumn("p", F.element_at(by_id.scalar(), F.col("post_id"))).select("user_id", "post_id", "p.*", "has_liked")


def community_or_recommended(user_unseen_posts, posts, users, likes, comments, post_img, req, page=1, limit=10) -> DataFrame:
    """R39 falling through to R40 for readers whose page of unseen posts is empty."""
    feed = community_feed(user_unseen_posts, posts, users, likes, comments, post_img, req, page, limit)
    served = feed.select("user_id").distinct()
    rest = recommended_posts(posts, users, likes, comments, post_img, req.select("user_id").join(served, "user_id", "left_anti"), page, limit)
    return feed.withColumn("has_liked", F.lit(None).cast("int")).unionByName(rest)


def post_comments(comments, comment_likes, users, req, page=1, limit=10) -> DataFrame:
    """Newest comments for each (user_id, post_id) request; the page is made once per post."""
    asked = req.select("user_id", "post_id").distinct()
    wanted = comments.join(asked.select("post_id").distinct(), "post_id", "left_semi")
    got = page_by(wanted, "post_id", [F.col("time").desc(), F.col("comment_id")], page, limit)
    got = got.join(count_by(comment_likes, "comment_id", "no_of_likes"), "comment_id", "left").fillna({"no_of_likes": 0})
    got = got.withColumnRenamed("user_id", "author_id").join(_author(users), "author_id", "left")
    rows = salted_join(asked, got, "post_id", ["user_id"], salts=8)
    rows = flag(rows, comment_likes, ["user_id", "comment_id"], "has_liked")
    return rows.select("user_id", "post_id", "comment_id", "time", "content", *FACE, "no_of_likes", "has_liked")


def post_details(posts, users, likes, comments, post_img, req=None, limit=10) -> DataFrame:
    """A post with images and counts; ``page_comments`` is the size of the first comment page."""
    rows = for_keys(posts, req, "post_id").select("post_id", "time", "content", F.col("user_id").alias("author_id")).join(_author(users), "author_id")
    rows = _post_counts(rows, likes, comments)
    rows = attach_list(rows, post_img.withColumnRenamed("img", "post_img"), "post_id", "post_id", "post_img", "post_images")
    return rows.select("post_id", *FACE, "post_images", "time", "content", "no_of_likes", "no_of_comments",
                       F.least(F.col("no_of_comments"), F.lit(limit)).alias("page_comments"))


def follow_profile(users, follows, req) -> DataFrame:
    """Profile for each (user_id, profile_id) request with follow state and degrees."""
    edges = follows.select("follower_user_id", "followed_user_id").distinct()
    ins = count_by(edges.withColumnRenamed("followed_user_id", "profile_id"), "profile_id", "follower_no")
    outs = count_by(edges.withColumnRenamed("follower_user_id", "profile_id"), "profile_id", "following_no")
    who = users.select(F.col("user_id").alias("profile_id"), "first_name", "last_name", "img", "profile_picture", "level", "type")
    who = who.join(ins, "profile_id", "left").join(outs, "profile_id", "left").fillna({"follower_no": 0, "following_no": 0})
    asked = req.select("user_id", "profile_id").distinct()
    pairs = edges.withColumnsRenamed({"follower_user_id": "user_id", "followed_user_id": "profile_id"})
    asked = flag(asked, pairs, ["user_id", "profile_id"], "followed").withColumn("own_profile", (F.col("user_id") == F.col("profile_id")).cast("int"))
    return asked.join(who, "profile_id")


def own_posts(posts, users, likes, comments, post_img, req=None, page=1, limit=10) -> DataFrame:
    """A user's posts with counts and images, newest first."""
    heads = for_keys(posts, req, "user_id").select("post_id", "time", "user_id", F.col("user_id").alias("author_id"))
    got = page_by(heads, "user_id", _newest_first(), page, limit)
    return _dress(got, posts, users, likes, comments, post_img).drop("author_id")


def notifications(notifications, req=None, page=1, limit=10) -> DataFrame:
    """Newest notifications of each user with the number of unread ones."""
    asked = for_keys(notifications, req, "user_id")
    got = page_by(asked, "user_id", [F.col("time").desc(), F.col("notification_id").desc()], page, limit)
    new = count_by(asked.filter(F.col("read_status") == "no"), "user_id", "new_notification")
    got = got.select("user_id", "notification_id", "title", "content", "time", "read_status", "redirect")
    return got.join(new, "user_id", "left").fillna({"new_notification": 0})


def post_owner(posts, users, req=None) -> DataFrame:
    """Whom to notify about a post."""
    rows = for_keys(posts, req, "post_id").select("post_id", "user_id")
    return rows.join(users.select("user_id", "socket_id"), "user_id", "left")


def facility_owner(facilities, facilitators, users, req=None) -> DataFrame:
    """Whom to notify about a facility."""
    rows = for_keys(facilities, req, "facility_id").select("facility_id", "facilitator_id")
    rows = rows.join(facilitators.select("facilitator_id", "user_id"), "facilitator_id", "left")
    return rows.join(users.select("user_id", "socket_id"), "user_id", "left").select("facility_id", "user_id", "socket_id")
