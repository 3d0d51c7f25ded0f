"""What both vector searches share: valid vectors, and visits of queries to groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HITS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("cand", pa.int64()), ("vec_id", pa.int64()), ("value", pa.float64()), ("exact", pa.int64())])
HITS_DDL = "query long, query_id long, cand long, vec_id long, value double, exact long"


def finite(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), fine), F.lit(False))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def visit(
    members: DataFrame,
    visits: DataFrame,
    keys: list[str],
    prepare: Callable[[np.ndarray, np.ndarray, np.ndarray], object],
    search: Callable[[object, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]],
) -> DataFrame:
    """Hits of each visiting query among the members of the group it visits.

    ``members``: ``keys``, ``row``, ``id``, ``v``; ``visits``: the same and
    ``floor``, a bound that is known for the query.  One shuffle brings a group
    together, members first: ``prepare(vectors, ids, rows)`` runs once for a
    group, whose members have to fit a task; the queries, however many, stream
    past it in Arrow batches through ``search(prepared, vectors, rows, floors)``,
    which yields (number in the batch, candidate rows, candidate ids, values,
    exact values).
    """
    order = [*keys, "kind"]
    both = members.select(*keys, F.lit(0).alias("kind"), "row", "id", "v", F.lit(None).cast("double").alias("floor")).unionByName(
        visits.select(*keys, F.lit(1).alias("kind"), "row", "id", "v", "floor")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys] + [batch.column("kind").to_numpy().astype(np.int64)], axis=1)
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                own = tuple(key[a, :-1].tolist())
                if own != group:
                    group, held, ready = own, [], None
                vectors, ids, rows = matrix(part.column("v")), part.column("id").to_numpy(), part.column("row").to_numpy()
                if key[a, -1] == 0:
                    held.append((vectors, ids, rows))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = prepare(*[np.concatenate(x) for x in zip(*held, strict=True)])
                floors = part.column("floor").to_numpy(zero_copy_only=False)
                hits = list(search(ready, vectors, rows, floors))
                if hits:
                    sizes = [len(h[1]) for h in hits]
                    at = np.repeat([h[0] for h in hits], sizes)
                    columns = [rows[at], ids[at], *[np.concatenate([h[i] for h in hits]) for i in (1, 2, 3, 4)]]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)

    return both.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, HITS_DDL)


def ranked(hits: DataFrame, k: int, best: list[Column]) -> DataFrame:
    """The first ``k`` different candidates of each query in the order ``best``."""
    once = hits.dropDuplicates(["query", "cand"])
    place = F.row_number().over(W.partitionBy("query").orderBy(*best, "vec_id", "cand"))
    return once.withColumn("rank", place).where(F.col("rank") <= k)
