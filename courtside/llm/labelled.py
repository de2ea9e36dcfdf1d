"""Labels for training: one per document, and the split by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def labels_of(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``label`` (0 or 1), once per id: the larger one where rows disagree. Rows without id or label are left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(id_col).agg((F.max(label) > 0).cast("int").alias(label))


SENT_ROWS = 2_000_000  # labels (16 bytes each) that are sent to the scan of the documents instead of shuffling the texts


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` and ``label`` of every labelled row. More labels than SENT_ROWS meet the documents in a shuffled join."""
    some = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(some) if some.count() <= SENT_ROWS else some, "id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` and ``label`` of at most ``per_class`` ids of either label, taken by a hash of the id.

    The ids are at most 2 * ``per_class`` rows and are sent to the scan of the documents.
    """
    some = [labels.where(F.col(label) == v).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for v in (0, 1)]
    ids = some[0].union(some[1]).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
