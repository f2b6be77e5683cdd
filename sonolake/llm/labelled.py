"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most_rows: int) -> DataFrame:
    """doc_id, text, label, pick of at most `most_rows` labelled documents that are not held out.

    The rows are those of smallest hash. Ids are labelled once (the largest of several labels holds);
    they are bounded by `most_rows`, so they are broadcast and the texts stay where they are. `pick` orders the texts of a
    repeated id, see one_each().
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held)
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("pick")).join(F.broadcast(ids), "doc_id")


def one_each(rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id and columns of one row for each id: that of the smallest pick, so that the same table always gives the same model."""
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), "pick").alias("x")).select("doc_id", "x.*")
