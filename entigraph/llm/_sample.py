"""Training texts bounded in number and in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_texts(rows: DataFrame, kind: str, text_bytes: int, kind_bytes: int) -> DataFrame:
    """Of sampled rows (doc_id, text, kind): distinct ones with texts of at most ``text_bytes`` bytes, for each kind in
    the order of a hash of id and text until they have ``kind_bytes`` bytes together."""
    own = rows.where(F.octet_length("text") <= text_bytes).select("doc_id", "text", kind).distinct()
    order = Window.partitionBy(kind).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return own.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(order)).where(F.col("bytes") <= kind_bytes).drop("bytes")
