"""Corpus pipeline: stages that each call one operator of courtside.llm on what the stage before has kept.

Every stage but the last returns the columns of documents. A stage's function takes (spark, docs, sf_dir) and reads what else it needs
(labels, benchmark) from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.store import new_path
from courtside.llm.decontam import drop_leaks
from courtside.llm.golay import near_duplicates
from courtside.llm.labelled import id_remainder, labels_of
from courtside.llm.pieces import encode_pieces
from courtside.llm.quality_net import fit_quality, keep_quality
from courtside.llm.queries import table
from courtside.llm.substrings import free_name, remove_repeats

VOCABULARY = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network (fitted on four fifths of the labels) scores at 0.3 or more; the others go."""
    labels = labels_of(table(spark, sf_dir, "labels"), "quality").where(id_remainder(F.col("doc_id"), 5) != 0)
    return keep_quality(docs, fit_quality(docs, labels), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (4-word shingles, 4 bits): the one with the smallest id, a null id last.

    A row is known by its id and text, so rows with equal ids and different texts are told apart, and of equal rows one stays.
    """
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", key.alias("key")).alias("row"), "text")
    groups = near_duplicates(rows, words=4, max_bits=4, id_col="row")
    firsts = groups.where("row = component_id").select("row.key").distinct()
    name = free_name(docs, "_key")
    return docs.withColumn(name, key).join(firsts.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name]).drop(name)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; every document stays, n_chars is counted anew."""
    return remove_repeats(docs, window=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; the others go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), tolerance=0.1, recall=0.99, passages=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (end id last) of every document."""
    import public_tokenizers

    out = encode_pieces(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]

#: The first stage scores by a trained network, which SQL cannot express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
