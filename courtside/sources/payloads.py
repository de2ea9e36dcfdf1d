"""Request bodies, payment webhooks and socket events as input rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYMENT_ENVELOPE = "type STRING, id STRING, created TIMESTAMP_NTZ, data STRUCT<object: STRUCT<id: STRING, description: STRING>>"
PAYMENT_NOTE = "user_id BIGINT, facility_id BIGINT, facility_amount DOUBLE, trainer_id BIGINT, trainer_amount DOUBLE, book_id BIGINT"
SOCKET_EVENT = "event_id BIGINT, event STRING, ts TIMESTAMP_NTZ, user_id BIGINT, friend_user_id BIGINT, room_id STRING, chat_id BIGINT, content STRING, socket_id STRING"
# The realtime events a client can send.
SOCKET_EVENTS = ["connect_user", "disconnect_user", "join_chat", "leave_chat", "typing", "stop_typing", "send_message", "send_img", "disconnect"]


def read_requests(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON request bodies as rows (``schema`` is a DDL string), and the lines that are not JSON of this shape."""
    with_bad = f"{schema}, _corrupt STRING"
    # parse the text ourselves so that pruned reads of the corrupt column stay allowed
    rows = spark.read.text(path).select(F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    good = rows.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    bad = rows.filter(F.col("r").isNull() | F.col("r._corrupt").isNotNull()).select("value")
    return good, bad


def parse_payment_events(rows: DataFrame) -> DataFrame:
    """The second JSON document, inside ``description``, opened up. Works on batches and streams."""
    rows = rows.select(F.col("id").alias("event_id"), F.col("created").alias("ts"), "type", F.col("data.object.id").alias("transaction_id"), F.col("data.object.description").alias("description"))
    return rows.withColumn("note", F.from_json("description", PAYMENT_NOTE))


def read_payment_events(spark: SparkSession, path: str, stream: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """Webhook payloads."""
    return parse_payment_events(_json(spark, path, PAYMENT_ENVELOPE, stream, files_per_batch))


def read_socket_events(spark: SparkSession, path: str, stream: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """Named realtime events; unknown names are dropped."""
    return _json(spark, path, SOCKET_EVENT, stream, files_per_batch).filter(F.col("event").isin(*SOCKET_EVENTS))


def _json(spark: SparkSession, path: str, schema: str, stream: bool, files_per_batch: int | None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)
