"""The draft store: buckets, deletion, compaction and a crash in it."""

import random

import pytest

from folioguard.operators import drafts
from folioguard.sources import store

SCHEMA = "id string, updated_at long, seq long, deleted boolean, title string"


def current(spark, path):
    return sorted(map(tuple, drafts.latest_drafts(store.read_versions(spark, path)).select("id", "seq", "title").collect()))


@pytest.fixture
def filled(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(200)}", rng.randrange(50), n, rng.random() < 0.1, f"t{n}") for n in range(900)]
    path = str(tmp_path / "drafts")
    for part in (rows[:400], rows[400:700], rows[700:]):
        store.put_drafts(spark.createDataFrame(part, SCHEMA), path)
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    return path, sorted((r[0], r[2], r[4]) for r in last.values() if not r[3])


def files_of(df):
    """Files that the scan of an executed query read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    while "finalPhysicalPlan" in dir(leaf) or leaf.nodeName() == "AdaptiveSparkPlan":
        leaf = leaf.finalPhysicalPlan().collectLeaves().head()
    if leaf.nodeName().startswith(("ShuffleQueryStage", "ResultQueryStage")):
        leaf = leaf.plan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_versions_deletion_and_compaction(spark, filled):
    path, want = filled
    assert current(spark, path) == want
    gone = [want[0][0], want[5][0], "never there"]
    store.delete_drafts(spark.createDataFrame([(g,) for g in gone], "id string"), path)
    want = [w for w in want if w[0] not in gone]
    assert current(spark, path) == want
    store.compact_drafts(spark, path)
    assert current(spark, path) == want and store.read_versions(spark, path).count() == len(want)
    store.put_drafts(spark.createDataFrame([("new", 99, 1, False, "n")], SCHEMA), path)
    store.compact_drafts(spark, path, buckets=3)
    assert current(spark, path) == sorted([*want, ("new", 1, "n")])


def test_get_reads_one_bucket(spark, filled):
    path, want = filled
    store.compact_drafts(spark, path)
    for key, seq, title in want[:3]:
        assert [(r["id"], r["seq"], r["title"]) for r in store.get_draft(spark, path, key).collect()] == [(key, seq, title)]
    assert store.get_draft(spark, path, "never there").collect() == []
    assert files_of(store.read_versions(spark, path).select("title")) == 16
    assert files_of(store._read(spark, path)[0].where((store.F.col("bucket") == store.bucket_of(store.F.lit(want[0][0]), 16)))) == 1
    plan = store.get_draft(spark, path, want[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(id," in plan


def test_a_crash_before_the_swap_changes_nothing(spark, filled, monkeypatch):
    path, want = filled

    def crash(*_):
        raise RuntimeError("executor host lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_enter", crash)
        with pytest.raises(RuntimeError):
            store.compact_drafts(spark, path)
    assert current(spark, path) == want and store.read_versions(spark, path).count() == 900
    store.compact_drafts(spark, path)
    assert current(spark, path) == want and store.read_versions(spark, path).count() == len(want)


def test_all_deleted_and_no_store(spark, tmp_path):
    path = str(tmp_path / "few")
    with pytest.raises(FileNotFoundError):
        store.read_versions(spark, path)
    store.put_drafts(spark.createDataFrame([("a", 1, 1, False, "x")], SCHEMA), path)
    store.delete_drafts(spark.createDataFrame([("a",)], "id string"), path)
    store.compact_drafts(spark, path)
    assert current(spark, path) == [] and store.get_draft(spark, path, "a").collect() == []
