"""Exact top-k by inner product of quantised vectors, with a KD-tree per shard.

A tree is split at medians and keeps a tight box for each node.  A query walks
it best-first: the node whose box allows the largest product comes next, until no
box reaches the k-th best product found so far.  That k-th product travels with
the query from its home shard to all others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import finite, ranked, visit

LEAF = 256
#: Numbers in the vectors of one shard: what a task holds at once.
SHARD_NUMBERS = 1 << 22
SHARD_ROWS = 4096
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Vectors with a larger component are kept out of the tree and meet queries in
#: Python's integers.
PLAIN = float(1 << 20)
LARGEST = 1.7976931348623157e308


class KdTree:
    """Median splits along the widest side, tight boxes, contiguous leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        self.low, self.high, self.children, self.span = [], [], [], []
        todo = [(0, len(vectors), None)]
        while todo:
            a, b, parent = todo.pop()
            own = vectors[order[a:b]]
            node = len(self.span)
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if b - a <= leaf or not low.size or (low == high).all():
                continue
            wide = int((high - low).argmax())
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], half)]
            todo += [(a, a + half, node), (a + half, b, node)]
        self.vectors, self.ids, self.rows = vectors[order], ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = float(np.abs(vectors).max(initial=0))


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:k]


def search_tree(tree: KdTree, queries: np.ndarray, own_rows: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple]:
    """The up to ``k`` best of the tree for each query, none worse than its floor.
    Products have to be exact in doubles."""
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    for i, q in enumerate(queries):
        kth = -math.inf if np.isnan(floors[i]) else floors[i]
        scores, ids, rows = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-bounds[i, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[i, child] >= kth:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            a, b = tree.span[node]
            got = tree.vectors[a:b] @ q
            near = np.flatnonzero((got >= kth) & (tree.rows[a:b] != own_rows[i]))
            if not len(near):
                continue
            scores = np.concatenate([scores, got[near]])
            ids, rows = np.concatenate([ids, tree.ids[a:b][near]]), np.concatenate([rows, tree.rows[a:b][near]])
            keep = _best(scores, ids, rows, k)
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
            if len(scores) == k:
                kth = max(kth, scores[-1])
        if len(scores):
            yield i, rows, ids, scores, scores.astype(np.int64)


class Shard:
    """A tree of the vectors of moderate components, and the few others."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        large = np.abs(vectors).max(axis=1, initial=0) > PLAIN
        self.tree = KdTree(vectors[~large], ids[~large], rows[~large]) if not large.all() else None
        self.large = vectors[large], ids[large], rows[large]

    def search(self, queries: np.ndarray, own_rows: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple]:
        """The up to ``k`` best for each query, as ``search_tree`` gives them."""
        most = self.tree.most if self.tree else 0.0
        plain = queries.shape[1] * most * np.abs(queries).max(axis=1, initial=0) < EXACT
        found: dict[int, list[tuple]] = {i: [] for i in range(len(queries))}
        if self.tree and plain.any():
            at = np.flatnonzero(plain)
            for i, rows, ids, _, exact in search_tree(self.tree, queries[at], own_rows[at], floors[at], k):
                found[int(at[i])] = list(zip((-exact).tolist(), ids.tolist(), rows.tolist(), strict=True))
        for i, q in enumerate(queries):
            if len(self.large[0]):
                found[i] += _in_integers(*self.large, q, own_rows[i])
            if self.tree and not plain[i]:
                found[i] += _in_integers(self.tree.vectors, self.tree.ids, self.tree.rows, q, own_rows[i])
            if best := heapq.nsmallest(k, found[i]):
                exact = np.array([-s for s, _, _ in best], np.int64)
                yield i, np.array([r for *_, r in best]), np.array([n for _, n, _ in best]), exact.astype(np.float64), exact


def _in_integers(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int) -> list[tuple]:
    """(the negated product, id, row) where doubles would round: in Python's
    integers, products cut to the range of a long."""
    whole = [int(x) for x in q]
    scored = []
    for v, n, r in zip(vectors, ids.tolist(), rows.tolist(), strict=True):
        if r != own:
            product = sum(int(a) * b for a, b in zip(v, whole, strict=True))
            scored.append((max(-LONG, min(LONG + 1, -product)), n, r))
    return scored


def floored(x: Column) -> Column:
    """The floor as a double; beyond 2**52 every double is whole, and beyond the
    largest it is cut to that."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)))


def exact_top_k(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    every: int = 100,
    factor: float = 1024.0,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row whose key is
    divisible by ``every``, the ``k`` other rows (all, if fewer) of largest inner
    product of ``floor(factor * x)``; ties go to the smaller key.

    Rows with a null key or vector, or with a component that is null or not
    finite, take no part.  Vectors meet those of equal length only.  Repeated
    rows count each, and a query skips just its own row.  A scaled component beyond
    the largest double is cut to it, and a product beyond the range of a long to
    that; products so cut are equal, and the smaller key comes first.  Shards hold a bounded number of components,
    so their number grows with the table.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    base = settle(
        df.where(F.col(f"`{key}`").isNotNull() & finite(v)).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{key}`").cast("long").alias("id"),
            F.transform(v.cast("array<double>"), lambda x: floored(x * factor)).alias("v"),
            F.size(v).alias("dim"),
        ),
        "topk",
    )
    n, numbers = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, math.ceil(numbers / SHARD_NUMBERS), min(spark.sparkContext.defaultParallelism, math.ceil(n / SHARD_ROWS)))
    placed = base.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = placed.where(F.col("id") % every == 0)

    def search(shard: Shard, vectors: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> Iterator[tuple]:
        return shard.search(vectors, rows, floors, k)

    home = settle(visit(placed, queries.withColumn("floor", F.lit(None).cast("double")), ["dim", "shard"], Shard, search), "topk-home")
    hits = home
    if shards > 1:
        floors = home.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).select(
            F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("floor")
        )
        away = queries.join(floors, "row", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("other <> shard")
        away = away.select("row", "id", "v", "dim", F.col("other").alias("shard"), "floor")
        hits = home.unionByName(visit(placed, away, ["dim", "shard"], Shard, search))
    best = ranked(hits, k, [F.col("exact").desc()])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("exact").alias("score"))
