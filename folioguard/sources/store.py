"""Draft versions and protected outputs on disk.

A draft store is a folder of generations and a log that says which one holds.
Versions are appended to the buckets of the generation in force, by a hash of their
id.  Compaction writes the last versions to a new generation, and only then adds its
name to the log: until then, and after a crash before that, the old one holds.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a new store.  Each generation keeps its own number in the log.
BUCKETS = 16
LOG = "number long, folder string, buckets int"


def bucket_of(draft: Column, buckets: int) -> Column:
    return F.pmod(F.hash(draft.cast("string")), F.lit(buckets)).cast("int")


def _generation(spark: SparkSession, path: str) -> tuple[int, str, int] | None:
    """The number, folder and buckets of the generation in force."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = log.orderBy(F.col("number").desc(), "folder").first()
    return None if last is None else (last["number"], last["folder"], last["buckets"])


def _enter(spark: SparkSession, path: str, number: int, folder: str, buckets: int) -> None:
    spark.createDataFrame([(number, folder, buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _write(versions: DataFrame, path: str, folder: str, buckets: int) -> None:
    """One file for each bucket, sorted by id, so that a reader of one id skips most
    of it."""
    dealt = versions.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "id")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/{folder}")


def put_drafts(versions: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
    """Append versions (``id``, ``updated_at``, ``seq``, ``deleted`` and more); a
    later version replaces an earlier one when drafts are read.  One writer at a
    time; ``buckets`` counts for a new store only."""
    spark = versions.sparkSession
    now = _generation(spark, path)
    folder, buckets = (now[1], now[2]) if now else (f"generation-0-{uuid.uuid4().hex}", buckets)
    _write(versions, path, folder, buckets)
    if not now:
        _enter(spark, path, 0, folder, buckets)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions and tombstones that the store still holds."""
    return _read(spark, path)[0].drop("bucket")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    now = _generation(spark, path)
    if now is None:
        raise FileNotFoundError(f"no draft store at {path}")
    return spark.read.parquet(f"{path}/{now[1]}"), now[2]


def get_draft(spark: SparkSession, path: str, draft: str) -> DataFrame:
    """The last version of one draft, or no row; reads its bucket alone."""
    versions, buckets = _read(spark, path)
    own = versions.where((F.col("bucket") == bucket_of(F.lit(draft), buckets)) & (F.col("id") == draft))
    return last_versions(own).where("not deleted").drop("deleted", "bucket")


def last_versions(versions: DataFrame) -> DataFrame:
    """The last version of each id by (``updated_at``, ``seq``), tombstones too."""
    order = W.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    return versions.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def delete_drafts(ids: DataFrame, path: str) -> None:
    """Append a tombstone behind the last version of each ``id``."""
    spark = ids.sparkSession
    there, buckets = _read(spark, path)
    asked = ids.select("id", bucket_of(F.col("id"), buckets).alias("bucket")).distinct()
    last = there.join(asked, ["bucket", "id"], "left_semi").groupBy("id").agg(F.max("updated_at").alias("updated_at"), F.max("seq").alias("seq"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema.fields if f.name not in ("id", "updated_at", "seq", "deleted", "bucket")]
    tombs = last.select("id", "updated_at", (F.col("seq") + 1).alias("seq"), F.lit(True).alias("deleted"), *rest)
    put_drafts(tombs.select(*[c for c in there.columns if c != "bucket"]), path)


def compact_drafts(spark: SparkSession, path: str, *, buckets: int | None = None) -> None:
    """Keep the last version of each draft and no deleted ones, in a new generation
    of ``buckets``, by default as many as before.

    The old generation is left where it is, for readers that still use it.  A run
    that dies before the log has the new name changes nothing; a later run writes
    another folder.
    """
    number, _, own = _generation(spark, path) or (None, None, None)
    if number is None:
        raise FileNotFoundError(f"no draft store at {path}")
    folder, buckets = f"generation-{number + 1}-{uuid.uuid4().hex}", buckets or own
    kept = last_versions(_read(spark, path)[0].drop("bucket")).where("not deleted")
    if kept.isEmpty():  # a folder without rows would have no schema
        kept = last_versions(_read(spark, path)[0].drop("bucket")).limit(1)
    _write(kept, path, folder, buckets)
    _enter(spark, path, number + 1, folder, buckets)


def write_protected(words: DataFrame, path: str) -> None:
    """Redacted words by document: (``doc_id``, ``page_no``, ``word_seq``,
    ``shown``, ``redacted``).  The originals are not touched."""
    words.select("doc_id", "page_no", "word_seq", "shown", "redacted").write.mode("overwrite").option("compression", "zstd").partitionBy("page_no").parquet(path)
