"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample.  Each has a price, as one more
coordinate that vectors and queries have zero in: crowded lists get farther from
all, which keeps lists balanced, and queries look for vectors where these went.
Every vector goes to the list of its nearest centroid; one near a boundary is
copied to further lists too.  A query finds centroids by walking a graph of them in
memory, and visits the lists whose centroid is not much farther than the nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import finite, matrix, ranked, visit

#: The sample that centroids and prices are fitted on: at most so many rows and
#: numbers, and so many rows for each list where the table has them.
SAMPLE_ROWS, SAMPLE_NUMBERS, SAMPLE_PER_LIST = 1 << 16, 1 << 23, 64
LIST_ROWS, MOST_LISTS = 200, 8192
#: Lists of more than so many times the mean of the sample are split.
CROWDED = 1.6
#: Members of a list that a task holds at once; longer lists are split in blocks.
BLOCK_ROWS = 4096
#: Distances that are held at once while vectors are given to lists.
HELD = 1 << 20
#: A vector is copied to lists whose centroid is at most so many times as far as
#: its nearest; so many lists at most.
COPY_RATIO, COPIES = 1.04, 2
#: A query visits lists whose centroid is at most so many times as far as the
#: nearest; the ratio alone decides how many these are.
VISIT_RATIO = 1.125
NEIGHBOURS = 16


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with a zero in the coordinate of prices."""
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def _blocks(n: int, lists: int) -> Iterator[slice]:
    step = max(1, min(4096, HELD // lists))
    return (slice(a, a + step) for a in range(0, n, step))


def _assigned(sample: np.ndarray, c: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, float]:
    """(list of each row, mean of the squared distances to the nearest centroid)."""
    own, near = np.empty(len(sample), np.int64), 0.0
    for rows in _blocks(len(sample), len(c)):
        d = _squared(sample[rows], c)
        near += d.min(axis=1).sum()
        own[rows] = np.add(d, price, out=d).argmin(axis=1)
    return own, near / len(sample)


def balanced_centroids(sample: np.ndarray, lists: int, *, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of about ``lists`` balanced lists, with the root of their price as
    last coordinate.  k-means first; then crowded lists get dearer and empty ones
    cheaper; lists that stay crowded are split."""
    rng = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    c = distinct[rng.choice(len(distinct), lists, replace=False)].copy()
    price, mean = np.zeros(lists), len(sample) / lists
    for turn in range(2 * rounds):
        own, near = _assigned(sample, c, price)
        size = np.bincount(own, minlength=len(c)).astype(float)
        if turn < rounds:
            sums = np.zeros_like(c)
            np.add.at(sums, own, sample)
            full = size > 0
            c[full] = sums[full] / size[full, None]
            if (~full).any():  # an empty list starts again from a member of the largest
                c[~full] = sample[rng.choice(np.flatnonzero(own == size.argmax()), (~full).sum())]
        else:
            price += near * 0.03 / (1 + (turn - rounds) / 4) * np.clip(size / mean - 1, -1, 2)
            price -= price.min()
    for _ in range(8):
        own, _ = _assigned(sample, c, price)
        size = np.bincount(own, minlength=len(c))
        fresh = []
        for i in np.flatnonzero(size > CROWDED * mean):
            rows = sample[own == i]
            ends = np.unique(rows, axis=0)
            if len(ends) > 1:
                pair = ends[rng.choice(len(ends), 2, replace=False)].copy()
                for _ in range(6):
                    side = _squared(rows, pair).argmin(axis=1)
                    pair = np.array([rows[side == k].mean(axis=0) if (side == k).any() else pair[k] for k in (0, 1)])
                c[i] = pair[0]
                fresh.append((pair[1], price[i]))
        if not fresh:
            break
        c, price = np.concatenate([c, [x for x, _ in fresh]]), np.concatenate([price, [p for _, p in fresh]])
    return np.concatenate([c, np.sqrt(price)[:, None]], axis=1)


class CentroidGraph:
    """Each centroid with its nearest ones, and with one of lower number, so that
    all can be reached; walked best-first."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        links: list[set[int]] = [set() for _ in range(n)]
        for a in range(0, n, 512):
            d = _squared(centroids[a : a + 512], centroids)
            for i, row in enumerate(d, a):
                for j in np.argsort(row, kind="stable")[: NEIGHBOURS + 1].tolist():
                    if j != i:
                        links[i].add(j)
                        links[j].add(i)
                if i:
                    j = int(row[:i].argmin())
                    links[i].add(j)
                    links[j].add(i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entry = int(_squared(centroids.mean(axis=0)[None], centroids)[0].argmin()) if n else 0

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of about ``width`` nearest centroids, nearest first."""
        far = lambda at: np.sqrt(((self.c[at] - q) ** 2).sum(axis=1))
        first = float(far(np.array([self.entry]))[0])
        seen = np.zeros(len(self.c), bool)
        seen[self.entry] = True
        todo, best = [(first, self.entry)], [(-first, self.entry)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for x, j in zip(far(new).tolist(), new.tolist(), strict=True):
                if len(best) < width or x < -best[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, j))
                    if len(best) > width:
                        heapq.heappop(best)
        out = sorted((-d, j) for d, j in best)
        return np.array([j for _, j in out], np.int64), np.array([d for d, _ in out])


def lists_of(x: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector, that of the nearest centroid first; a vector near
    a boundary has several.  Vectors are taken in blocks of ``HELD`` distances."""
    out: list[np.ndarray] = []
    for rows in _blocks(len(x), len(c)):
        d = _squared(lifted(x[rows]), c)
        few = np.argpartition(d, min(COPIES, d.shape[1]) - 1, axis=1)[:, :COPIES]
        far = np.sqrt(np.take_along_axis(d, few, axis=1))
        order = np.lexsort((few, far), axis=1)
        top, far = np.take_along_axis(few, order, axis=1), np.take_along_axis(far, order, axis=1)
        out += [near[: max(1, int(n))] for near, n in zip(top, (far <= COPY_RATIO * far[:, :1]).sum(axis=1), strict=True)]
    return out


def visits_of(graph: CentroidGraph, q: np.ndarray, primary: np.ndarray, k: int, width: int = 64) -> np.ndarray:
    """The lists that a query visits: all that the distance ratio allows, and at
    least as many as hold ``k`` different rows besides the query.  The graph is
    walked wider until what it finds goes beyond both."""
    while True:
        at, d = graph.nearest(np.append(q, 0.0), min(width, len(graph.c)))
        by_ratio = int((d <= VISIT_RATIO * d[0]).sum())
        enough = np.flatnonzero(np.cumsum(primary[at]) > k)
        if len(at) >= len(graph.c) or (len(enough) and by_ratio < len(at)):
            return at[: max(by_ratio, int(enough[0]) + 1 if len(enough) else len(at))]
        width *= 2


def nearest_neighbours(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row whose key is
    divisible by ``every``, the ``k`` nearest other rows found (all, if fewer),
    with their Euclidean distance in double precision; ties go to the smaller key.

    Rows with a null key or vector, a zero vector, or a component that is null
    or not finite take no part.  Vectors meet those of equal length only.  All
    rows are indexed; only the centroids come from a sample.  Repeated rows count
    each, and a query skips just its own row.  Lists that grow beyond a task,
    for instance where one vector repeats without end, are split in blocks, all
    of which are visited.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    base = settle(
        df.where(F.col(f"`{key}`").isNotNull() & finite(F.col(f"`{vector}`")) & F.exists(v, lambda x: x != 0)).select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")
        ),
        "ann",
    )
    hits = [_of_length(base.where(F.col("dim") == dim), n, dim, k, every) for dim, n in sorted(map(tuple, base.groupBy("dim").count().collect()))]
    if not hits:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    best = ranked(found, k, [F.col("value")])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("value").alias("score"))


def _of_length(base: DataFrame, n: int, dim: int, k: int, every: int) -> DataFrame:
    spark = base.sparkSession
    wanted = max(1, min(MOST_LISTS, n // LIST_ROWS))
    most = min(SAMPLE_ROWS, max(SAMPLE_NUMBERS // dim, 64), max(1 << 13, SAMPLE_PER_LIST * wanted))
    drawn = base.orderBy(F.xxhash64("row"), "row").limit(most).select("v").toArrow()
    sample = matrix(drawn.column("v").combine_chunks())
    centroids = balanced_centroids(sample, max(1, min(wanted, len(sample) // 8)))
    shared = spark.sparkContext.broadcast(centroids)  # about MOST_LISTS rows at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = lists_of(matrix(batch.column("v")), shared.value)
                where = pa.array(np.repeat(np.arange(len(at)), [len(a) for a in at]))
                first = np.concatenate([np.arange(len(a)) == 0 for a in at])
                columns = [batch.column(c).take(where) for c in ("row", "id", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(at)), pa.array(first)], ["row", "id", "v", "list", "primary"])

    postings = settle(base.select("row", "id", "v").mapInArrow(post, "row long, id long, v array<double>, list long, primary boolean"), "ann-postings")
    sizes = {r["list"]: r for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("primary").alias("own")).collect()}
    primary = np.array([sizes[i]["own"] if i in sizes else 0 for i in range(len(centroids))])
    blocks = np.array([math.ceil(sizes[i]["n"] / BLOCK_ROWS) if i in sizes else 0 for i in range(len(centroids))])
    graph = CentroidGraph(centroids)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, q in enumerate(matrix(batch.column("v"))):
                at = visits_of(graph, q, primary, k)
                pairs = [(j, b) for j in at.tolist() for b in range(blocks[j])]
                where = pa.array([i] * len(pairs), pa.int64())
                columns = [batch.column(c).take(where) for c in ("row", "id", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([j for j, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["row", "id", "v", "list", "block"])

    count = F.element_at(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("list").cast("int") + 1)
    members = postings.withColumn("block", F.pmod(F.xxhash64("row"), count).cast("long")).select("row", "id", "v", "list", "block")
    queries = base.where(F.col("id") % every == 0).select("row", "id", "v")
    visits = queries.mapInArrow(choose, "row long, id long, v array<double>, list long, block long").withColumn("floor", F.lit(None).cast("double"))

    def near(ready: tuple, vectors: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> Iterator[tuple]:
        x, ids, own = ready
        for i, q in enumerate(vectors):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            d[own == rows[i]] = np.inf
            keep = np.lexsort((own, ids, d))[:k] if len(d) <= 4 * k else _least(d, ids, own, k)
            keep = keep[np.isfinite(d[keep])]
            if len(keep):
                yield i, own[keep], ids[keep], d[keep], np.zeros(len(keep), np.int64)

    return visit(members, visits, ["list", "block"], lambda x, ids, rows: (x, ids, rows), near)


def _least(d: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest by (distance, key, row)."""
    kth = np.partition(d, k - 1)[k - 1]
    near = np.flatnonzero(d <= kth)
    return near[np.lexsort((rows[near], ids[near], d[near]))[:k]]
