"""Draft versions: an append-only table, the latest per id, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folder import completeness_of


def latest_drafts(versions: DataFrame) -> DataFrame:
    """The last version of each ``id`` by (``updated_at``, ``seq``), without those
    whose last version is a tombstone (``deleted``)."""
    order = W.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    return versions.withColumn("n", F.row_number().over(order)).where("n = 1 and not deleted").drop("n", "deleted")


def get_draft(versions: DataFrame, draft_id: str) -> DataFrame:
    """The draft of one id: the filter reaches the scan, before any sort."""
    return latest_drafts(versions.where(F.col("id") == draft_id))


def newest_drafts(versions: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest drafts, newest first."""
    return latest_drafts(versions).orderBy(F.col("updated_at").desc(), F.col("seq").desc()).limit(n)


def summaries(drafts: DataFrame) -> DataFrame:
    """Drafts (``documents``: array of structs with ``slot``) with counts and
    completeness, without a shuffle and without their files."""
    parts = completeness_of(F.transform("documents", lambda d: d["slot"]))
    return drafts.select("id", "title", "address", "updated_at", F.size("documents").alias("document_count"), *parts)
