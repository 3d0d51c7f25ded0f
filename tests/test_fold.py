"""Folds over logs that Spark finds dealt by their key already."""

from pyspark.sql import functions as F

from folioguard.operators.edits import review_clicks


def test_the_sides_of_a_union_stay_together(spark):
    """Both sides are dealt by document and coalesced apart; each document is one row."""
    n = 2000
    found = spark.range(n).select((F.col("id") * 7 % n).alias("doc_id"), F.lit("x").alias("id")).groupBy("doc_id").agg(F.first("id").alias("id"))
    first = found.select("doc_id", F.lit(-1).cast("long").alias("seq"), F.array("id").alias("ids"), (F.col("doc_id") % 2 == 0).alias("start"))
    every = found.groupBy("doc_id").agg(F.collect_list("id").alias("all"))
    clicks = spark.range(n * 41).select((F.col("id") % n).alias("doc_id"), F.col("id").alias("seq")).join(every, "doc_id").select("doc_id", "seq", F.col("all").alias("ids"), F.lit(None).cast("boolean").alias("start"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = [(r["doc_id"], r["selected"]) for r in review_clicks(first.unionByName(clicks)).collect()]
    finally:
        for k in small:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == [(i, ["x"] if i % 2 else []) for i in range(n)]
