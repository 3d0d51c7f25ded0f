"""Weighted rendezvous sharding of records, on DataFrame functions alone.

Every record key meets every shard in a draw; the record goes to the shard with
the best draw.  A draw depends on the key and that one shard only, so a shard
that is added takes records to itself and moves none between the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import without

SEED = 20_240_117


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard (0-based int) of ``key`` among ``len(weights)`` shards.

    Shard ``j`` draws ``-ln(u) / weight`` with ``u`` uniform in (0, 1) from
    XXH64 of (key, seed, j); the smallest draw wins, so shares follow the
    weights.  Shards of weight 0 get nothing.  A null key is a key like any
    other: all null keys share one shard.
    """
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and not all zero")
    known = F.coalesce(key.cast("string"), F.lit("\x00null"))
    draws = []
    for j, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(known, F.lit(seed), F.lit(j)), 11)
            u = (bits + F.lit(0.5)) * F.lit(2.0**-53)
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(j).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"].cast("int")


def shard_records(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    *,
    grown: Sequence[float] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``shard``, and with ``grown_shard`` for the weights in
    ``grown``.  No shuffle.

    Input columns named like an output column are replaced; all others pass
    through untouched.  Rows with equal keys go to one shard.  An empty table
    gives an empty table.
    """
    added = {"shard": rendezvous(F.col(f"`{key}`"), weights, seed)}
    if grown is not None:
        added["grown_shard"] = rendezvous(F.col(f"`{key}`"), grown, seed)
    names = [c for c in df.columns if c.lower() not in added]
    return df.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in added.items()])


def number_slots(df: DataFrame, order: str, *, buckets: int = 1024, seed: int = SEED) -> DataFrame:
    """``df``, which has ``shard``, with ``slot``: 0, 1, ... in every shard.

    Give it narrow rows: all columns are shuffled.  Equal rows are first counted
    (with partial aggregation), so a key that holds a third of all rows is one
    row here and is spread out again at the end.  The rows of a shard are split
    by a hash of ``order`` and the other columns into ``buckets``; only the
    bucket counts are summed per shard, and rows are ranked inside a bucket.

    Slots follow (bucket, order column, other columns) and so are the same in
    every run and for every layout of the input.
    """
    df = without(df, "slot", "__n", "__bucket", "__before", "__at")
    others = [c for c in df.columns if c not in ("shard", order)]
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in [order, *others]])
    counted = (
        df.groupBy(*[F.col(f"`{c}`") for c in df.columns])
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bucket", F.pmod(hashed, F.lit(buckets)).cast("int"))
    )
    inside = W.partitionBy("shard", "__bucket").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in [order, *others]])
    placed = counted.withColumn("__at", F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    below = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = (
        counted.groupBy("shard", "__bucket")
        .agg(F.sum("__n").alias("__sum"))
        .withColumn("__before", F.sum("__sum").over(below) - F.col("__sum"))
        .drop("__sum")
    )
    first = F.col("__before") + F.col("__at")
    return (
        placed.join(starts, ["shard", "__bucket"])
        .select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("slot"))
    )
