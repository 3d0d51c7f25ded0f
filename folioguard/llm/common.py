"""Shared helpers: reading tables, cutting lineage, column-name hygiene."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Characters that end a word in the ``[^\x20\x09-\x0D]+`` word rule.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='folioguard-')}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in
    ``spark.checkpoint.dir``.  Where that is unset, a temporary one if Spark runs
    in this process alone; on a cluster, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    base = base or _own_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Makes Spark remove the shuffles of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage and survives lost executors: every later read takes the
    written copy.  The shuffles of the write go with its end; else they stay until
    the driver happens to collect its garbage, and a stage of many steps holds them all.
    """
    conf, path = df.sparkSession.conf, scratch_dir(df.sparkSession, name)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows that go to Python at once, from now on: texts are long, and a task holds
    a batch on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash with ``names`` (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
