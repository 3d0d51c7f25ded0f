"""What settled tables leave on disk."""

import os

from pyspark.sql import functions as F

from folioguard.llm.common import CLEANUP, settle


def shuffle_files(spark):
    top = spark.conf.get("spark.local.dir")
    return {f"{d}/{f}" for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffles_of_a_settled_table_are_removed(spark):
    held, conf = shuffle_files(spark), spark.conf.get(CLEANUP)
    made = settle(spark.range(20_000).repartition(F.col("id") % 5).groupBy((F.col("id") % 1000).alias("k")).count(), "few")
    assert made.count() == 1000 and made.agg(F.sum("count")).first()[0] == 20_000
    assert not {f for f in shuffle_files(spark) - held if os.path.getsize(f) > 5_000}
    assert spark.conf.get(CLEANUP) == conf
