"""Page plans and contents of folders that are cut at ranges of their order."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioguard.operators import folder
from folioguard.rules import SLOTS

SCHEMA = "folder_id string, id long, ord long, name string, page_count double, include_cover boolean"


def test_plans_of_cut_folders_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(folder, "RANGE_BITS", 2)
    rng = random.Random(6)
    orders = [None, 0, 1, 3, 3, -5, 2**40, -(2**50)]
    rows = [(rng.choice(["hot", "hot", "f", None]), i, rng.choice([*orders, i]), f"n{i}", rng.choice([None, 0.2, 1.0, 3.9]), None) for i in range(400)]
    rows = [(*r[:5], r[0] == "hot") for r in rows]
    want, at = {}, {}
    for f, i, order, _, pages, cover in sorted(rows, key=lambda r: (r[0] or "", r[2] is not None, r[2] or 0, r[1])):
        number, start = at.get(f, (1, 2 if cover else 1))
        pages = max(1, int(pages or 1))
        want[i] = (number, start, start + pages - 1)
        at[f] = (number + 1, start + pages)
    plan = folder.page_plan(spark.createDataFrame(rows, SCHEMA))
    got = {r["id"]: (r["start_page"], r["end_page"]) for r in plan.collect()}
    assert got == {i: w[1:] for i, w in want.items()}
    docs = spark.createDataFrame([(r[0], r[1], "s") for r in rows], "folder_id string, id long, slot string")
    listed = folder.contents_rows(plan, docs).collect()
    assert {r["id"]: r["number"] for r in listed} == {i: w[0] for i, w in want.items()} and len(listed) == len(rows)


def test_empty_folders(spark):
    plan = folder.page_plan(spark.createDataFrame([], SCHEMA))
    assert plan.collect() == []


def test_positions_of_cut_slots(spark):
    """Most documents are in one slot of one folder; names tie."""
    rng = random.Random(3)
    names = ["doc-2.pdf", "doc-10.pdf", "Äpfel.pdf", "apfel.pdf", "Zebra.pdf", "äpfel.pdf"]
    slots = [*SLOTS, None]
    rows = [(rng.choice(["hot"] * 8 + ["f", None]), i, slots[0] if rng.random() < 0.8 else rng.choice(slots), rng.choice(names)) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "folder_id string, id long, slot string, name string").withColumn("extra", F.lit(1))
    whole = W.partitionBy("folder_id").orderBy(*folder.sort_order())
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.row_number().over(whole)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = folder.positions(df)
        got = {r["id"]: r["position"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and out.columns == [*df.columns, "position"]
    assert folder.positions(df.limit(0)).collect() == []
