"""Frames of sessions that are cut at spans, against plain folds."""

import math
import random

import pytest

from folioguard.operators import frames as fr

POINT = "struct<x: double, y: double>"
SCHEMA = f"session_id string, ts timestamp, frame_no long, document_detected boolean, movement double, corners struct<top_left: {POINT}, top_right: {POINT}, bottom_right: {POINT}, bottom_left: {POINT}>"


def frames_of(seed, n):
    """Quiet, moving and lost stretches of sessions, most frames in one."""
    import datetime

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        phase = (i // 37) % 5
        detected = rng.choice([True, False]) if phase == 0 else None if rng.random() < 0.05 else phase < 4 or rng.random() < 0.03
        movement = rng.choice([None, math.nan, math.inf, 4.0, 12.0, 40.0]) if rng.random() < 0.05 else rng.choice([1.0, 3.0, 10.0 if phase == 2 else 2.0])
        at = 0.3 * (rng.random() < 0.02) + rng.random() * 0.01
        corners = None if rng.random() < 0.1 else tuple((0.1 + at + k / 10, None if rng.random() < 0.01 else 0.2 + at) for k in range(4))
        ts = None if rng.random() < 0.003 else datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=75 * (i // 2))
        rows.append((rng.choice(["hot"] * 8 + ["a", None]), ts, i, detected, movement, corners))
    rng.shuffle(rows)
    return rows


def folded(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for key, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1], r[2]) if r[1] else (False, 0, r[2]))
        yield key, own


def plain(rows):
    live, counts, tracked = {}, {}, {}
    for _, own in folded(rows):
        misses, corners, stable, simple = 0, None, 0, 0
        for _, _, no, detected, movement, points in own:
            flat = None if points is None else [x for p in points for x in p]
            flat = None if flat is None or None in flat else flat
            misses, corners, seen = fr.track(misses, corners, detected, flat)
            moved = math.inf if movement is None or math.isnan(movement) else movement
            stable = stable + 1 if seen and moved <= 9.0 else max(0, stable - 1) if not seen or moved <= 9.0 * 1.7 else 0
            simple = 0 if not math.isfinite(moved) else max(0, simple - 1) if moved > 4.8 else simple + 1
            live[no] = (stable, "positioning" if not seen else "ready" if stable >= 4 else "moving", seen and stable >= 5)
            counts[no] = simple
            tracked[no] = (seen, corners)
    return live, counts, tracked


@pytest.mark.parametrize(("hot", "span_us"), [(1 << 16, 600_000_000), (50, 3_000_000), (0, 400_000)])
def test_cut_sessions_equal_the_fold(spark, hot, span_us):
    rows = frames_of(hot, 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    live, counts, tracked = plain(rows)
    assert {r["frame_no"]: (r["stable"], r["status"], r["capture"]) for r in fr.live_states(df, hot=hot, span_us=span_us).collect()} == live
    assert {r["frame_no"]: r["stable"] for r in fr.stability_counts(df, hot=hot, span_us=span_us).collect()} == counts
    got = {r["frame_no"]: (r["seen"], r["tracked"]) for r in fr.tracked_corners(df, hot=hot, span_us=span_us).collect()}
    assert got.keys() == tracked.keys()
    for no, (seen, corners) in tracked.items():
        assert got[no][0] == seen and (got[no][1] is None) == (corners is None)
        assert corners is None or max(abs(a - b) for a, b in zip(got[no][1], corners, strict=True)) < 1e-9


def test_a_hot_session_is_in_many_tasks(spark):
    """A million frames of one session: no task holds more than a span of it."""
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select(
        F.lit("s").alias("session_id"), F.timestamp_millis(F.col("id") * 75).alias("ts"), F.col("id").alias("frame_no"), (F.col("id") % 50 != 0).alias("document_detected"), (F.col("id") * 37 % 11).cast("double").alias("movement")
    )
    simple, want = 0, 0
    for i in range(1_000_000):
        simple = simple + 1 if i * 37 % 11 <= 4.8 else max(0, simple - 1)
        want += simple
    out = fr.stability_counts(df)
    assert out.agg(F.sum("stable")).first()[0] == want
    assert "__span" in out._jdf.queryExecution().toString()


def test_no_frames(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fr.live_states(none).collect() == fr.stability_counts(none).collect() == fr.tracked_corners(none).collect() == []
