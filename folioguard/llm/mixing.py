"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources a document
belongs to).  A network of the patterns and sources decides how many words of
each pattern every source takes: pattern capacity comes in layers, one for each
repetition, whose cost rises from layer to layer, so a second copy is only taken
where first copies have run out.  Then documents are drawn by a seeded hash.

Only sums by pattern, and quotas by source, reach the driver; both are bounded
by the number of source sets, not by the number of documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, without

SEED = 17
#: Patterns up to which the plan is broadcast (some hundred bytes each).
SMALL_PLAN = 10_000


def quotas(sizes: Mapping, weights: Mapping, total: float, most: float) -> dict:
    """Split ``total`` by weight; no source gets over ``most`` times its size,
    and what is cut off is shared again by weight until none is above.

    A source of size or weight zero gets zero.  If all sources are full, the
    rest stays unassigned.
    """
    out = {s: 0.0 for s in sizes}
    open_, left = [s for s in sizes if weights[s] > 0 and sizes[s] > 0], float(total)
    while open_:
        base = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / base for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
        left = max(left, 0.0)
    return out


def min_cost_flow(arcs: Iterable[tuple], start, end) -> dict:
    """Flow of a largest flow of least cost from ``start`` to ``end``.

    ``arcs``: (tail, head, capacity, cost), integers, costs not negative.
    Returns {arc number: flow}.  Successive shortest paths with potentials.
    """
    graph: dict = {}
    ends: list = []
    for tail, head, capacity, cost in arcs:
        for a, b, cap, c in ((tail, head, capacity, cost), (head, tail, 0, -cost)):
            graph.setdefault(a, []).append(len(ends))
            graph.setdefault(b, [])
            ends.append([b, cap, c])
    height = dict.fromkeys(graph, 0)
    while start in graph:
        best, via, heap, count = {start: 0}, {}, [(0, 0, start)], 1
        while heap:
            far, _, a = heapq.heappop(heap)
            if far > best[a]:
                continue
            for i in graph[a]:
                b, cap, c = ends[i]
                if cap > 0 and (d := far + c + height[a] - height[b]) < best.get(b, float("inf")):
                    best[b], via[b] = d, i
                    heapq.heappush(heap, (d, count, b))
                    count += 1
        if end not in best:
            break
        for a in graph:
            height[a] += best.get(a, best[end])
        path, a = [], end
        while a != start:
            path.append(via[a])
            a = ends[via[a] ^ 1][0]
        push = min(ends[i][1] for i in path)
        for i in path:
            ends[i][1] -= push
            ends[i ^ 1][1] += push
    return {i // 2: ends[i + 1][1] for i in range(0, len(ends), 2)}


def route(patterns: Mapping[tuple, int], quota: Mapping, most: int) -> dict[tuple, dict]:
    """Words that each source takes from each pattern: {pattern: {source: words}}."""
    arcs: list[tuple] = []
    for p, words in patterns.items():
        for copy in range(most):
            arcs.append(("start", ("p", p), words, copy))
    middle = len(arcs)
    pairs = [(p, s) for p in patterns for s in p]
    arcs += [(("p", p), ("s", s), most * patterns[p], 0) for p, s in pairs]
    arcs += [(("s", s), "end", round(q), 0) for s, q in quota.items()]
    flow = min_cost_flow(arcs, "start", "end")
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for i, (p, s) in enumerate(pairs, middle):
        out[p][s] = flow[i]
    return out


def mix_sources(
    df: DataFrame,
    *,
    members: str,
    size: str,
    key: str,
    weights: Sequence[float] | Mapping = (1.0,),
    share: float = 1.0,
    most: int = 2,
    whole: bool = False,
    buckets: int = 4096,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with ``target`` and ``taken``.

    ``members``: array of the document's sources (a null element is the source
    of unknown documents; an empty or null array belongs to none and is never
    taken).  ``size``: words, not negative (null: 0).  ``key``: what the seeded
    order hashes.  ``weights``: a mapping by source, or numbers dealt to the
    sources in code-point order, null last, repeating.  All targets add up to
    ``share`` times the words of all documents, and no document is taken more
    than ``most`` times its size.

    ``target``: the words wanted from the document's sources (the sum over
    them).  ``taken``: the words taken of the document.  ``taken`` adds up to
    the routed words exactly, as one document for each pattern is taken in part;
    with ``whole`` that document is taken if over half of it would be, so that
    documents count 0, 1, ... ``most`` times in full.

    ``df`` is read twice and must give the same rows both times.  Rows are
    shuffled only where their hash bucket is the one in which a pattern's words
    run out.  Equal rows are interchangeable.
    Columns named ``target``, ``taken`` or with the prefix ``__mix`` are replaced.
    """
    spark = df.sparkSession
    df = without(df, "target", "taken", "__mix_p", "__mix_n", "__mix_h", "__mix_b")
    kept = [F.col(f"`{c}`") for c in df.columns]
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(F.col(f"`{members}`").cast("array<string>"))).alias("m")))
    work = df.select(
        *kept,
        pattern.alias("__mix_p"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("__mix_n"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("__mix_h"),
    ).withColumn("__mix_b", F.pmod(F.shiftrightunsigned("__mix_h", 20), F.lit(buckets)).cast("int"))
    sums = settle(work.groupBy("__mix_p", "__mix_b").agg(F.sum("__mix_n").alias("n")), "mix-sums")
    listed = T.StructType([T.StructField("m", T.ArrayType(T.StringType()))])
    totals = [
        (r["__mix_p"], tuple(r["m"] or ()), r["n"])
        for r in sums.groupBy("__mix_p").agg(F.sum("n").alias("n"))
        .select("__mix_p", F.from_json("__mix_p", listed)["m"].alias("m"), "n").collect()
    ]
    sources = sorted({s for _, m, _ in totals for s in m}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, m, n in totals if s in m) for s in sources}
    by = weights if isinstance(weights, Mapping) else {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target = quotas(sizes, by, share * sum(n for _, _, n in totals), most)
    routed = route({m: n for _, m, n in totals}, target, most)
    plan = []
    for text, m, n in totals:
        words = sum(routed[m].values())
        full = min(words // n, most) if n else 0
        plan.append((text, float(sum(target[s] for s in m)), int(full), int(words - full * n)))
    plan_df = spark.createDataFrame(plan, "__mix_p string, target double, __mix_full long, __mix_left long")

    # The bucket of each pattern in which the words left over run out.
    upto = W.partitionBy("__mix_p").orderBy("__mix_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = (
        sums.withColumn("__mix_end", F.sum("n").over(upto))
        .join(plan_df.select("__mix_p", "__mix_left"), "__mix_p")
        .where((F.col("__mix_end") - F.col("n") < F.col("__mix_left")) & (F.col("__mix_left") <= F.col("__mix_end")))
        .select("__mix_p", F.col("__mix_b").alias("__mix_edge"), (F.col("__mix_left") - F.col("__mix_end") + F.col("n")).alias("__mix_rest"))
    )
    # As many rows as the plan, whose number is known: where they are few, the
    # documents are joined without a shuffle.
    edges = {r["__mix_p"]: (r["__mix_edge"], r["__mix_rest"]) for r in edge.collect()}
    known = spark.createDataFrame(
        [(p, target, times, *edges.get(p, (-1, 0))) for p, target, times, _ in plan], "__mix_p string, target double, __mix_full long, __mix_edge int, __mix_rest long"
    )
    full = work.join(F.broadcast(known) if len(plan) <= SMALL_PLAN else known, "__mix_p")
    base = F.col("__mix_n") * F.col("__mix_full")

    clear = full.where(F.col("__mix_b") != F.col("__mix_edge")).select(
        *kept, "target", (base + F.when(F.col("__mix_b") < F.col("__mix_edge"), F.col("__mix_n")).otherwise(0)).alias("taken")
    )
    # Equal rows count once with their number, so a key that repeats without end
    # is one row here too; they are dealt out again at the end.
    same = [*df.columns, "__mix_p", "__mix_n", "__mix_h", "target", "__mix_full", "__mix_rest"]
    tied = full.where(F.col("__mix_b") == F.col("__mix_edge")).groupBy(*[F.col(f"`{c}`") for c in same]).agg(F.count(F.lit(1)).alias("__mix_c"))
    order = [F.col("__mix_h"), *[F.col(f"`{c}`").asc_nulls_first() for c in df.columns]]
    all_of = F.col("__mix_n") * F.col("__mix_c")
    upto = W.partitionBy("__mix_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    each = tied.withColumn("__mix_before", F.sum(all_of).over(upto) - all_of).withColumn(
        "__mix_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_c") - 1))
    )
    part = F.greatest(F.lit(0), F.least(F.col("__mix_n"), F.col("__mix_rest") - F.col("__mix_before") - F.col("__mix_i") * F.col("__mix_n")))
    if whole:
        part = F.when(2 * part > F.col("__mix_n"), F.col("__mix_n")).otherwise(0)
    return clear.unionByName(each.select(*kept, "target", (base + part).cast("long").alias("taken")))
