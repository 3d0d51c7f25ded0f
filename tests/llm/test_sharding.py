"""Rendezvous sharding and gapless slots."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from folioguard.llm import queries
from folioguard.llm.sharding import SEED, number_slots, shard_records


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = shard_records(spark.range(20_000).withColumnRenamed("id", "k"), "k", [1.0] * 16, grown=[1.0] * 17).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.2 * min(counts.values())
    assert 0.04 < sum(r["grown_shard"] == 16 for r in rows) / len(rows) < 0.08


def test_weights(spark):
    counts = Counter(r["shard"] for r in shard_records(spark.range(20_000).toDF("k"), "k", [3.0, 0.0, 1.0]).collect())
    assert set(counts) == {0, 2} and 2.7 < counts[0] / counts[2] < 3.3
    for bad in ([], [0.0], [-1.0, 2.0], [float("nan")]):
        with pytest.raises(ValueError):
            shard_records(spark.range(1).toDF("k"), "k", bad)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "c"), (2, None)] + [(7, "hot")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Shard", F.lit("theirs")).withColumn("slot", F.lit(-1))
    out = number_slots(shard_records(df, "doc_id", [1.0] * 3), "doc_id", buckets=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    shards, slots = defaultdict(set), defaultdict(list)
    for r in out:
        shards[r["doc_id"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = number_slots(shard_records(df.repartition(7), "doc_id", [1.0] * 3), "doc_id", buckets=4).collect()
    assert Counter(out) == Counter(again)
    assert number_slots(shard_records(df.limit(0), "doc_id", [1.0]), "doc_id").collect() == []


def drawn(key, shards):
    """The shard with the smallest draw, by the xxhash library."""

    def bits(j):
        h = xxhash.xxh64_intdigest("\x00null" if key is None else str(key), 42)
        for part in (SEED, j):
            h = xxhash.xxh64_intdigest(part.to_bytes(4, "little"), h)
        return h >> 11

    return min(range(shards), key=lambda j: (-math.log((bits(j) + 0.5) * 2.0**-53), j))


def test_query_against_brute_force(spark):
    got = queries.op7_rendezvous_shards(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for doc in docs:
        raw = (doc["text"] or "").encode()
        want[doc["doc_id"], len(raw) + 1, zlib.crc32(raw), "key", drawn(doc["doc_id"], 16), drawn(doc["doc_id"], 17)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_null_key_against_brute_force(spark):
    df = spark.createDataFrame([(None,), (-3,), (2**40,)], "k long")
    got = {r["k"]: (r["shard"], r["grown_shard"]) for r in shard_records(df, "k", [1.0] * 16, grown=[1.0] * 17).collect()}
    assert got == {k: (drawn(k, 16), drawn(k, 17)) for k in (None, -3, 2**40)}
