"""Batch application of events to table snapshots.

Each function takes a snapshot and an events DataFrame and returns the new snapshot (or the new rows) and,
where requests can fail, a ``rejected`` DataFrame with a ``reason``. Events carry ``event_id`` and ``ts``;
within a batch they act in that order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions.common import RUN_ROWS, flag, is_unset, join_in_runs, meet_runs, names, pack_runs, ranked
from courtside.functions.store import settle, written
from courtside.operators.quality import validate

FIRST = ["ts", "event_id"]


def _earliest(events: DataFrame, keys) -> DataFrame:
    """First event per key; losers are dropped before the shuffle."""
    return ranked(events, keys, [F.col(c) for c in FIRST if c in events.columns], 1, "_one").drop("_one")


def _latest(events: DataFrame, keys) -> DataFrame:
    return ranked(events, keys, [F.col(c).desc() for c in FIRST if c in events.columns], 1, "_one").drop("_one")


def _reject(events: DataFrame, reasons: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    reason = F.lit(otherwise)
    for name, hit in reversed(reasons):
        reason = F.when(hit, F.lit(name)).otherwise(reason)
    return events.withColumn("reason", reason)


def apply_unique_pairs(snapshot, events, keys, parents: dict[str, DataFrame] | None = None, distinct_pair: tuple[str, str] | None = None):
    """Insert a pair once: favourites, likes, follows, staff, comment likes.

    ``parents`` maps a key column to the table it must exist in; ``distinct_pair`` names two columns that
    must differ (nobody follows themselves).
    """
    keys = names(keys)
    checked = events
    bad = []
    for i, (col, table) in enumerate((parents or {}).items()):
        checked = flag(checked, table, [col], f"_p{i}")
        bad.append((f"unknown_{col}", F.col(f"_p{i}") == 0))
    if distinct_pair:
        bad.append(("self", F.col(distinct_pair[0]) == F.col(distinct_pair[1])))
    checked = flag(checked, snapshot, keys, "_there")
    bad.append(("exists", F.col("_there") == 1))
    good = checked
    for _, hit in bad:
        good = good.filter(~hit)
    accepted = _earliest(good.select(*events.columns), keys)
    rows = accepted.select(*[c for c in snapshot.columns if c in accepted.columns])
    rejected = _reject(checked.join(accepted.select("event_id"), "event_id", "left_anti"), bad, "repeated").select(*events.columns, "reason")
    return snapshot.unionByName(rows, allowMissingColumns=True), rejected


def apply_reviews(reviews, submissions, target: str):
    """One review per user and target, the first wins; rating and content are required."""
    ok, missing = validate(submissions, {"rating": ~is_unset("rating"), "content": ~is_unset("content")})
    new, repeated = apply_unique_pairs(reviews, ok, ["user_id", target])
    missing = missing.withColumn("reason", F.concat(F.lit("missing_"), F.array_join("failed", "_"))).drop("failed")
    return new, repeated.unionByName(missing)


def apply_deletes(snapshot, events, keys):
    """Remove the named rows; keys include the owner, so nobody deletes another user's row."""
    keys = names(keys)
    gone = events.select(*keys).distinct()
    rejected = flag(events, snapshot, keys, "_there").filter(F.col("_there") == 0).drop("_there").withColumn("reason", F.lit("absent"))
    return snapshot.join(gone, keys, "left_anti"), rejected


def apply_toggles(snapshot, events, keys):
    """Interleaved add/remove of one pair; the last action wins."""
    keys = names(keys)
    last = events.groupBy(*keys).agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    untouched = snapshot.select(*keys).distinct().join(last, keys, "left_anti")
    return untouched.unionByName(last.filter(F.col("action") == "add").select(*keys))


def apply_updates(snapshot, events, key, cols: Sequence[str], owner: str | None = None):
    """The latest event per key overwrites the given columns where it brings a value."""
    keys = names(key)
    held = [*keys, *([owner] if owner else [])]
    known = flag(events, snapshot, held, "_there")
    rejected = known.filter(F.col("_there") == 0).drop("_there").withColumn("reason", F.lit("not_owner" if owner else "absent"))
    new = _latest(known.filter(F.col("_there") == 1), keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = snapshot.join(new, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    return out.select(*snapshot.columns), rejected


def replace_children(snapshot, events, owner: str):
    """An owner's newest batch (ts, batch_id) of child rows replaces all of the owner's old rows."""
    newest = events.groupBy(owner).agg(F.max(F.struct("ts", "batch_id")).alias("_b"))
    newest = newest.select(owner, F.col("_b.batch_id").alias("batch_id"))
    rows = events.join(newest, [owner, "batch_id"], "left_semi")
    kept = snapshot.join(newest.select(owner), owner, "left_anti")
    return kept.unionByName(rows.select(*[c for c in snapshot.columns if c in rows.columns]), allowMissingColumns=True)


def fan_out_posts(posts, follows, run: int = RUN_ROWS, packed: bool = False) -> DataFrame:
    """One unseen row per new post and follower who wants all posts. Posts may be a stream.

    The result is as large as posts times followers by nature. A popular author's followers come in runs of ``run``, dealt over tasks,
    and the rows of a post and a run lie together, so that they take little space. ``feed_on_read`` gives the same pages without it.
    With ``packed`` the rows of a post and a run are one row with the array ``user_ids`` (``unpacked`` gives the rows), and followers are dealt
    at once, so that the micro-batches of a stream don't each do it anew.
    """
    wants = follows.filter(F.col("notification_status") == "all").select("follower_user_id", F.col("followed_user_id").alias("author_id")).distinct()
    new = posts.select("post_id", F.col("user_id").alias("author_id"))
    if packed:
        runs = written(pack_runs(wants, "author_id", "follower_user_id", run), "fan-out-runs")
        heads = new.join(runs.select("author_id", "_lot", "_run"), "author_id")
        return meet_runs(heads, runs, ["_run", "_lot", "author_id"]).select(F.col("follower_user_id").alias("user_ids"), "post_id")
    return join_in_runs(new, wants, "author_id", "follower_user_id", run).select(F.col("follower_user_id").alias("user_id"), "post_id")


def unpacked(rows) -> DataFrame:
    """The rows (user_id, post_id) of a packed :func:`fan_out_posts`."""
    return rows.select(F.explode("user_ids").alias("user_id"), "post_id")


def consume_feed(unseen, delivered, delivered_only: bool = False) -> DataFrame:
    """Reading empties a reader's whole queue, or with ``delivered_only`` just the rows shown.

    For the latter only the rows of posts that were shown to anybody meet the shown rows; the others stay where they are.
    """
    if not delivered_only:
        return unseen.join(delivered.select("user_id").distinct(), "user_id", "left_anti")
    shown = written(delivered.select("user_id", "post_id").distinct(), "feed-shown")
    posts = written(shown.select("post_id").distinct(), "feed-shown-posts")
    left = unseen.join(posts, "post_id", "left_semi").join(shown, ["user_id", "post_id"], "left_anti")
    return unseen.join(posts, "post_id", "left_anti").unionByName(left).select(*left.columns)


def create_chats(chats, requests, users):
    """Two mirrored rows sharing a room per new pair; self-chats, unknown users and known pairs are refused."""
    pair = [F.least("user_id", "friend_user_id").alias("_a"), F.greatest("user_id", "friend_user_id").alias("_b")]
    checked = flag(requests, users.select(F.col("user_id").alias("friend_user_id")), ["friend_user_id"], "_known")
    checked = checked.select("*", *pair)
    checked = flag(checked, chats.select(*pair), ["_a", "_b"], "_there")
    bad = [("unknown_user", F.col("_known") == 0), ("self", F.col("_a") == F.col("_b")), ("exists", F.col("_there") == 1)]
    good = checked
    for _, hit in bad:
        good = good.filter(~hit)
    won = _earliest(good, ["_a", "_b"])
    sides = F.explode(F.array(F.struct(F.col("_a").alias("u"), F.col("_b").alias("f")), F.struct(F.col("_b").alias("u"), F.col("_a").alias("f"))))
    room = F.sha2(F.concat_ws(":", F.col("_a").cast("string"), F.col("_b").cast("string")), 256)
    new = won.select(room.alias("room_id"), sides.alias("s"))
    new = new.select(F.col("s.u").alias("user_id"), "room_id", F.col("s.f").alias("friend_user_id"), F.lit("all").alias("notification_status"), F.lit(0).alias("new_messages"))
    rejected = _reject(checked.join(won.select("event_id"), "event_id", "left_anti"), bad, "repeated").select(*requests.columns, "reason")
    return new, rejected


def make_notifications(events, actors) -> DataFrame:
    """Notification rows from typed events.

    Events have event_id, event_type, ts, actor_id, receiver_id, object_id (text) and, by type, content,
    rating, actor's ``day``/``start_time``/``end_time``. The receiver is the target's owner.
    """
    who = actors.select(F.col("user_id").alias("actor_id"), F.concat_ws(" ", "first_name", "last_name").alias("_who"), F.col("type").alias("_role"))
    rows = events.join(who, "actor_id", "left")
    for c in ("content", "rating", "day", "start_time", "end_time"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    since = F.date_format(F.date_sub(F.to_date("ts"), 15), "yyyy-MM-dd")
    until = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    chat_link = F.format_string("/api/user/messages/%s?start_time=%s&end_time=%s", "object_id", since, until)
    post_link = F.format_string("/api/user/post/%s?page=1&limit=10", "object_id")
    stars = F.when(F.col("rating").try_cast("double") % 1 == 0, F.col("rating").try_cast("double").cast("bigint").cast("string")).otherwise(F.col("rating").cast("string"))
    # Title, text and link of each kind of notification.
    templates = {
        "like": (F.lit("New like"), F.concat(F.col("_who"), F.lit(" liked your post")), post_link),
        "follow": (F.lit("New follower"), F.concat(F.col("_who"), F.lit(" has followed you")), F.format_string("/api/user/profile/%s?page=1&limit=5", F.col("actor_id").cast("string"))),
        "comment": (F.lit("New comment"), F.col("content"), post_link),
        "review": (F.lit("New Review"), F.concat(F.lit("Your facility have a new review of "), stars, F.lit(" star: "), F.col("content")), F.format_string("/api/%s/facility/%s", "_role", "object_id")),
        "chat_request": (F.lit("New message request"), F.concat(F.col("_who"), F.lit(" has sent you a message request")), chat_link),
        "booking": (F.lit("Booking Confirmation"), F.format_string("Payment successful and session has been booked for %s from %s to %s", "day", "start_time", "end_time"), F.format_string("/api/%s/session/%s", "_role", "object_id")),
        "message": (F.concat(F.lit("New message from "), F.col("_who")), F.col("content"), chat_link),
    }

    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, parts in templates.items():
            out = F.when(F.col("event_type") == kind, parts[i]).otherwise(out)
        return out

    return rows.select("event_id", "event_type", F.col("receiver_id").alias("user_id"), pick(0).alias("title"), pick(1).alias("content"), F.col("ts").alias("time"), F.lit("no").alias("read_status"), pick(2).alias("redirect"))


def mark_read(notifications, by_id=None, by_day=None) -> DataFrame:
    """Mark single notifications (user_id, notification_id) or all of a user's of one day (user_id, day)."""
    out = notifications.withColumn("_day", F.to_date("time"))
    hit = F.lit(False)
    if by_id is not None:
        out, hit = flag(out, by_id, ["user_id", "notification_id"], "_i"), hit | (F.col("_i") == 1)
    if by_day is not None:
        out, hit = flag(out, by_day.select("user_id", F.col("day").alias("_day")), ["user_id", "_day"], "_d"), hit | (F.col("_d") == 1)
    out = out.withColumn("read_status", F.when(hit, F.lit("yes")).otherwise(F.col("read_status")))
    return out.select(*notifications.columns)


def set_chat_status(chats, events):
    """The owner sets a chat's notification status to all or muted."""
    ok, invalid = validate(events, {"status": F.col("status").isin("all", "muted")})
    ok = ok.withColumnRenamed("status", "notification_status")
    new, denied = apply_updates(chats, ok, "chat_id", ["notification_status"], owner="user_id")
    invalid = invalid.drop("failed").withColumn("reason", F.lit("invalid_status")).withColumnRenamed("status", "notification_status")
    return new, denied.unionByName(invalid)


def reset_unread(chats, reads) -> DataFrame:
    """Opening one chat clears the counters of all the user's chats and stamps the opened one."""
    mine = chats.select("chat_id", "user_id").join(reads.select("chat_id", "user_id", "ts"), ["chat_id", "user_id"])
    opened = mine.groupBy("chat_id").agg(F.max("ts").alias("_opened"))
    out = flag(chats, mine, ["user_id"], "_reader").join(opened, "chat_id", "left")
    out = out.withColumn("new_messages", F.when(F.col("_reader") == 1, F.lit(0)).otherwise(F.col("new_messages")))
    return out.withColumn("last_accessed", F.coalesce("_opened", "last_accessed")).select(*chats.columns)


PAYMENT_NOTE = "user_id BIGINT, facility_id BIGINT, facility_amount DOUBLE, trainer_id BIGINT, trainer_amount DOUBLE, book_id BIGINT"


def settle_payments(payments, payments_facility, books, book_facilities, users, facilities, events) -> dict[str, DataFrame]:
    """Apply succeeded/canceled payment events in order of (ts, event_id).

    A success turns a pending payment into 'success' and creates the session; a cancellation removes
    payment and booking when both exist. A success after a cancellation finds nothing left. The first event of
    each kind decides, so every booking needs only two aggregated values.
    """
    from courtside.operators.booking import session_from_booking

    rows = events.withColumn("n", F.from_json("description", PAYMENT_NOTE)).filter(F.col("n.book_id").isNotNull())
    rows = rows.select("event_id", "ts", "transaction_id", "type", F.col("n.book_id").alias("book_id"), F.col("n.trainer_id").isNotNull().alias("_with"))
    moment = F.struct("ts", "event_id", "transaction_id")
    sums = rows.groupBy("book_id", "_with").agg(
        F.min(F.when(F.col("type") == "payment_intent.succeeded", moment)).alias("_paid"),
        F.min(F.when(F.col("type") == "payment_intent.canceled", moment)).alias("_gone"),
    )
    out: dict[str, DataFrame] = {}
    paid_keys = []
    for with_trainer, pay, book, book_key in ((True, payments, books, "book_id"), (False, payments_facility, book_facilities, "book_facility_id")):
        s = sums.filter(F.col("_with") == with_trainer).drop("_with")
        booked = book.select(F.col(book_key).alias("book_id"))
        p = flag(pay.join(s, "book_id", "left"), booked, ["book_id"], "_booked")
        gone = F.col("_gone").isNotNull() & (F.col("_booked") == 1)
        paid = F.col("_paid").isNotNull() & (F.col("status") == "pending") & (~gone | (F.col("_paid") < F.col("_gone")))
        p = p.withColumn("_is_paid", F.coalesce(paid, F.lit(False))).withColumn("_is_gone", F.coalesce(gone, F.lit(False)))
        paid_keys.append(p.filter("_is_paid").select("book_id", F.lit("trainer" if with_trainer else "facility").alias("kind")))
        kept = p.filter(~F.col("_is_gone"))
        kept = kept.withColumn("status", F.when(F.col("_is_paid"), F.lit("success")).otherwise(F.col("status")))
        kept = kept.withColumn("transaction_id", F.when(F.col("_is_paid"), F.col("_paid.transaction_id")).otherwise(F.col("transaction_id")))
        name = "payments" if with_trainer else "payments_facility"
        out[name] = kept.select(*pay.columns)
        doomed = p.filter("_is_gone").select(F.col("book_id").alias(book_key))
        out["books" if with_trainer else "book_facilities"] = book.join(doomed, book_key, "left_anti")
    keys = paid_keys[0].unionByName(paid_keys[1])
    out["sessions"] = session_from_booking(books, book_facilities, users, facilities).join(keys, ["kind", "book_id"], "left_semi")
    out["trainer_sessions"] = out["sessions"].filter(F.col("trainer_id").isNotNull()).select("book_id", "trainer_id")
    known = payments.select("book_id", F.lit(True).alias("_with")).unionByName(payments_facility.select("book_id", F.lit(False).alias("_with")))
    out["rejected"] = rows.filter(F.col("type").isin("payment_intent.succeeded", "payment_intent.canceled")).join(known, ["book_id", "_with"], "left_anti").withColumnRenamed("_with", "with_trainer")
    return out


def create_payments(payments, payments_facility, summaries, events):
    """W15, first step: a pending payment for a user's own booking that has none pending.

    ``summaries`` is the booking summary (R50); events name exactly one of ``book_id`` and
    ``book_facility_id``. New rows carry ``kind`` (trainer or facility), which tells their table.
    """
    one = F.col("book_id").isNull() != F.col("book_facility_id").isNull()
    kind = F.when(F.col("book_id").isNotNull(), "trainer").otherwise("facility")
    asked = events.withColumn("_one", one.cast("int")).withColumn("kind", kind).withColumn("_book", F.coalesce("book_id", "book_facility_id"))
    mine = summaries.select("kind", F.col("book_id").alias("_book"), "user_id", "amount_cents")
    pending = payments.withColumn("kind", F.lit("trainer")).unionByName(payments_facility.withColumn("kind", F.lit("facility")))
    pending = pending.filter(F.col("status") == "pending").select("kind", F.col("book_id").alias("_book"))
    asked = flag(flag(asked, mine, ["kind", "_book", "user_id"], "_own"), pending, ["kind", "_book"], "_open")
    bad = [("one_booking_needed", F.col("_one") == 0), ("not_booked", F.col("_own") == 0), ("already_pending", F.col("_open") == 1)]
    good = asked
    for _, hit in bad:
        good = good.filter(~hit)
    won = _earliest(good, ["kind", "_book"])
    new = won.join(mine, ["kind", "_book", "user_id"]).select(
        "kind", F.col("_book").alias("book_id"), F.col("amount_cents").alias("total_amount"), "currency", F.lit("pending").alias("status"))
    rejected = _reject(asked.join(won.select("event_id"), "event_id", "left_anti"), bad, "repeated").select(*events.columns, "reason")
    return new, rejected


def assign_ids(df: DataFrame, order: Sequence[Column], start: int | Column = 1, out: str = "id") -> DataFrame:
    """Consecutive ids in ``order`` without a single-task sort.

    Rows are range-partitioned and checkpointed (so the partition of a row is fixed even if an executor is
    lost), numbered inside each partition, and shifted by the row counts of the partitions before it.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))  # one row per partition
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.withColumn("_n", local).join(shifts, "_part").withColumn(out, (F.col("_n") + F.col("_shift") - 1 + first).cast("bigint")).drop("_n", "_shift", "_part")


def next_id(table: DataFrame, key: str) -> Column:
    """First free surrogate key as a scalar subquery."""
    return table.agg(F.coalesce(F.max(key), F.lit(0)) + 1).scalar()


def split_name(full: Column) -> tuple[Column, Column]:
    """First word and the rest of a full name."""
    words = F.split(full, " ")
    return words[0], F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")


def split_two_words(full: Column) -> tuple[Column, Column]:
    """First and second word; the rest is dropped."""
    return F.split_part(full, F.lit(" "), F.lit(1)), F.split_part(full, F.lit(" "), F.lit(2))


# The fields each role's sign-up must bring.
ROLE_FIELDS = {
    "athlete": ["age", "weight", "height", "sport_interest", "sport_level", "gender", "latitude", "longitude"],
    "trainer": ["hourly_rate", "specialization", "specialization_level", "gender", "latitude", "longitude"],
    "facilitator": ["latitude", "longitude"],
    "parent": ["latitude", "longitude"],
}
CHILD_FIELDS = ["name", "age", "gender", "sport_interest", "sport_level"]


def register_users(users, signups):
    """W20, first half: e-mail-unique users with split names; returns (new users by signup, rejected)."""
    from courtside.operators.filters import EMAIL_PATTERN

    ok, bad = validate(signups, {"full_name": ~is_unset("full_name"), "email": F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))})
    bad = bad.withColumn("reason", F.concat(F.lit("invalid_"), F.array_join("failed", "_"))).drop("failed")
    ok = flag(ok, users, ["email"], "_there")
    won = _earliest(ok.filter(F.col("_there") == 0).drop("_there"), ["email"])
    dup = ok.drop("_there").join(won.select("event_id"), "event_id", "left_anti").withColumn("reason", F.lit("email_taken"))
    first, last = split_name(F.col("full_name"))
    return won.withColumn("first_name", first).withColumn("last_name", last), bad.unionByName(dup)


def register_roles(registered):
    """W20, second half: role rows of registered users (user_id given) whose role fields are complete.

    Returns a dict with ``users`` (type and coordinates set), one frame per role, ``children`` and
    ``rejected``. A parent with an incomplete child is refused whole.
    """
    rules = {"type": F.col("type").isin(*ROLE_FIELDS)}
    for role, fields in ROLE_FIELDS.items():
        for f in fields:
            rules[f"{role}_{f}"] = (F.col("type") != role) | ~is_unset(f)
    whole = F.forall("children", lambda c: F.coalesce(c["name"] != "", F.lit(False)) & F.coalesce(c["age"] > 0, F.lit(False)) & c["gender"].isNotNull() & c["sport_interest"].isNotNull() & c["sport_level"].isNotNull())
    rules["parent_children"] = (F.col("type") != "parent") | (F.coalesce(F.size("children") > 0, F.lit(False)) & F.coalesce(whole, F.lit(False)))
    ok, bad = validate(registered, rules)
    out = {"users": ok.select("user_id", "first_name", "last_name", "email", "type", "latitude", "longitude")}
    for role, fields in ROLE_FIELDS.items():
        cols = [c for c in fields if c not in ("latitude", "longitude")]
        out[f"{role}s"] = ok.filter(F.col("type") == role).select("user_id", *cols)
    kids = ok.filter(F.col("type") == "parent").select("user_id", F.explode("children").alias("c"))
    out["children"] = kids.select("user_id", *[F.col(f"c.{f}").alias(f) for f in CHILD_FIELDS])
    out["rejected"] = bad
    return out


def add_amenities(events, distinct: bool = False) -> DataFrame:
    """Title-cased amenity names per facility; repeats are kept unless ``distinct``."""
    rows = events.select("facility_id", F.explode("amenities").alias("name")).withColumn("name", F.initcap("name"))
    return rows.distinct() if distinct else rows


def assign_employees(events, facilities, facilitator_employees):
    """Assign listed staff to a facility, all or nothing: each must be on the owner's staff."""
    asked = events.select("event_id", "facility_id", F.explode("employees").alias("trainer_id"))
    owner = facilities.select("facility_id", "facilitator_id")
    asked = asked.join(owner, "facility_id", "left")
    asked = flag(asked, facilitator_employees, ["facilitator_id", "trainer_id"], "_staff")
    bad = asked.filter(F.col("_staff") == 0).select("event_id").distinct()
    new = asked.join(bad, "event_id", "left_anti").select("facility_id", "trainer_id")
    return new, events.join(bad, "event_id", "left_semi").withColumn("reason", F.lit("not_staff"))


def attach_images(parents, images, key: str, owner: str = "user_id"):
    """Image rows for posts, reviews or facilities by their owner."""
    from courtside.operators.filters import authorized

    ok, denied = authorized(images, parents, [key, owner])
    return ok.select(key, "img"), denied.withColumn("reason", F.lit("not_owner"))


def live_tokens(token_management, blacklisted_token) -> DataFrame:
    """Issued tokens that are not blacklisted, each once."""
    dead = blacklisted_token.select(F.col("refresh_token").alias("token"))
    return token_management.select("user_id", "token").distinct().join(dead, "token", "left_anti")


def append_validated(table, events, rules: dict[str, Column], owners: DataFrame | None = None, owner_keys: Sequence[str] = ()):
    """Append rows passing ``rules`` (and, with ``owners``, an ownership check); no uniqueness guard."""
    ok, bad = validate(events, rules)
    bad = bad.withColumn("reason", F.array_join("failed", ",")).drop("failed")
    if owners is not None:
        ok = flag(ok, owners, list(owner_keys), "_own")
        bad = bad.unionByName(ok.filter(F.col("_own") == 0).drop("_own").withColumn("reason", F.lit("not_owner")))
        ok = ok.filter(F.col("_own") == 1).drop("_own")
    rows = ok.select(*[c for c in table.columns if c in ok.columns])
    return table.unionByName(rows, allowMissingColumns=True), bad


def add_facilities(events):
    """New facilities with their weekly hours; one bad day refuses the whole facility.

    Returns (facilities, hours, rejected); hours carry the event id of their facility.
    """
    from courtside.operators.quality import hours_rules

    day = F.explode_outer("available_hours").alias("d")
    days = events.select("event_id", day).select("event_id", "d.*")
    _, wrong = validate(days, hours_rules(strict_structure=False))
    wrong = wrong.filter(F.col("week_day").isNotNull() | F.col("available").isNotNull())
    bad = wrong.groupBy("event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("failed")))).alias("failed"))
    ok = events.join(bad, "event_id", "left_anti")
    hours = ok.select("event_id", F.explode("available_hours").alias("d")).select("event_id", "d.*")
    cols = ["event_id", "facilitator_id", "hourly_rate", "name", "latitude", "longitude", "capacity", "established_in"]
    rejected = events.select("event_id").join(bad, "event_id").select("event_id", F.array_join("failed", ",").alias("reason"))
    return ok.select(*cols), hours, rejected
