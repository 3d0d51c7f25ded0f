"""Vector searches against brute force."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import ann, topk
from folioguard.llm.ann import CentroidGraph, balanced_centroids, lists_of, nearest_neighbours, visits_of
from folioguard.llm.topk import KdTree, exact_top_k, search_tree

NAN, INF = float("nan"), float("inf")
ODD = [(None, [1.0, 2.0]), (7, None), (8, [1.0, None]), (9, [NAN, 1.0]), (100, [INF, 1.0]), (101, []), (200, []), (300, [1.0]), (301, [2.0])]


def rows_of(n, d, seed, spread=2):
    rng = random.Random(seed)
    return [(i, [float(rng.randint(-spread, spread)) / 8 for _ in range(d)]) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("row", F.lit("theirs")).withColumn("shard", F.lit(1)).withColumn("rank", F.lit(1))


def usable(rows, zero):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute(rows, k, measure, zero=True):
    rows, out = usable(rows, zero), []
    for a, (i, q) in enumerate(rows):
        if i % 100 == 0:
            scored = sorted((measure(q, v), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q))[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def product(q, v):
    return -sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, v, strict=True))


@pytest.mark.parametrize("shards", [1, 5])
def test_exact_top_k(spark, monkeypatch, shards):
    monkeypatch.setattr(topk, "SHARD_ROWS", 10_000 if shards == 1 else 80)
    rows = rows_of(350, 3, 1) + ODD + [(100, [0.1, 0.2, 0.3])] * 3
    got = exact_top_k(frame(spark, rows)).collect()
    want = brute(rows, 10, product)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], -r["score"]) for r in got) == want
    assert exact_top_k(frame(spark, rows).limit(0)).collect() == []


def test_huge_components(spark):
    rows = [(0, [2.0**60, 1.0]), (1, [2.0**40, 3.0]), (2, [-(2.0**60), 3.0]), (3, [1.0, 5.0])]
    got = [(r["vec_id"], r["score"]) for r in exact_top_k(frame(spark, rows)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    x = np.rint(rng.normal(0, 30, (3000, 4)))
    tree = KdTree(x, np.arange(3000), np.arange(3000), leaf=16)
    q = np.rint(rng.normal(0, 30, (20, 4)))
    for i, rows, _, scores, _ in search_tree(tree, q, np.full(20, -1), np.full(20, np.nan), 10):
        s = x @ q[i]
        want = np.lexsort((np.arange(3000), -s))[:10]
        assert rows.tolist() == want.tolist() and scores.tolist() == s[want].tolist()


def test_graph_reaches_all_centroids():
    c = np.concatenate([np.random.default_rng(1).normal(m, 0.01, (40, 5)) for m in (0, 50, 100)])
    graph = CentroidGraph(c)
    at, d = graph.nearest(c[100], len(c))
    assert sorted(at.tolist()) == list(range(len(c))) and at[0] == 100 and (np.diff(d) >= 0).all()


def test_neighbours_of_small_tables(spark):
    rows = rows_of(180, 3, 5) + ODD + [(300, [0.0, 0.0])] + [(5, [0.5, 0.5, 0.5])] * 4
    got = nearest_neighbours(frame(spark, rows)).collect()
    want = brute(rows, 10, lambda q, v: float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), zero=False)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert nearest_neighbours(frame(spark, rows).limit(0)).collect() == []


def test_one_vector_repeated_and_split_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rows = [(i, [1.0, 2.0]) for i in range(600)]
    got = nearest_neighbours(frame(spark, rows)).collect()
    assert len(got) == 60 and all(r["score"] == 0 for r in got)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == list(range(10))


def test_recall(spark):
    import pyarrow.dataset as ds

    sf = "/root/testdata/sf0.1"
    x = ds.dataset(f"{sf}/embeddings.parquet").to_table()
    ids, v = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_pylist()).astype(float)
    got = nearest_neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hits.append(len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_top_k_of_huge_finite_components_against_integers(spark):
    rng = random.Random(12)
    one = lambda: rng.choice([rng.uniform(-2, 2), 1e6, -3e7, 1e300, -1.7e308, 0.0, 2.5e305])
    rows = [(i, [one() if rng.random() < 0.4 else rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=20).collect()
    big = 1.7976931348623157e308
    whole = {i: [math.floor(max(-big, min(big, 1024.0 * x))) for x in v] for i, v in rows}
    most = (1 << 63) - 1
    want = []
    for q in range(0, 120, 20):
        scored = sorted((max(-most, min(most + 1, -sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i, _ in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])]
    assert sorted(map(tuple, got)) == want


def test_lists_are_balanced_and_the_ratio_prunes():
    """Over 50,000 vectors of 40 clusters: sizes, share of postings read, recall."""
    rng = np.random.Generator(np.random.PCG64(2))
    centres = rng.normal(0, 1, (40, 24))
    v = centres[rng.integers(0, 40, 52_000)] + rng.normal(0, 0.45, (52_000, 24))
    c = balanced_centroids(v[:16_640], 260)
    lists = lists_of(v, c)
    primary, every = np.bincount([a[0] for a in lists], minlength=len(c)), np.bincount(np.concatenate(lists), minlength=len(c))
    assert primary.max() <= 2 * primary.mean() and 1.1 < every.sum() / len(v) <= 2
    posted = [[] for _ in c]
    for i, a in enumerate(lists):
        for j in a:
            posted[j].append(i)
    graph, read, right = CentroidGraph(c), 0, 0
    for q in range(0, 52_000, 1300):
        at = visits_of(graph, v[q], primary, 10)
        read += every[at].sum()
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        found = np.unique(np.concatenate([posted[j] for j in at]))
        right += (far[found] <= np.partition(far, 9)[9]).sum()
    assert right >= 0.9 * 400 and read <= 0.15 * 40 * every.sum()


def test_lists_are_found_in_bounded_memory():
    """10,000 vectors against 8,192 lists: a matrix of all would take 655 MB."""
    rng = np.random.Generator(np.random.PCG64(4))
    c, v = rng.normal(0, 1, (8192, 33)), rng.normal(0, 1, (10_000, 32))
    tracemalloc.start()
    lists = lists_of(v, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    for i in range(0, 10_000, 500):
        d = np.sqrt(((v[i] - c[:, :-1]) ** 2).sum(axis=1) + c[:, -1] ** 2)
        near = np.argsort(d)[:2]
        assert lists[i].tolist() == near[: 1 + (d[near[1]] <= 1.04 * d[near[0]])].tolist()
