"""Labelled rows for the classifiers: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that op5's classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def labelled_rows(labels: DataFrame, label: str, condition: Column) -> DataFrame:
    """(doc_id, y) of all labelled rows that fulfil the condition. An id with several labels counts by the largest; rows without an id
    or a label of 0 or 1 are left out."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(condition)
    return one.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(labels: DataFrame, label: str, condition: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` of the labelled rows: those with the smallest hash of the id."""
    return labelled_rows(labels, label, condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sample. The sample has at most SAMPLE_ROWS rows of two numbers, a proven bound for the broadcast."""
    return docs.join(F.broadcast(sample), "doc_id")
