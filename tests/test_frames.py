"""Counters over the frames of long sessions."""

from pyspark.sql import functions as F

from folioguard.operators.frames import live_states, stability_counts
from folioguard.streaming.live import next_stable


def test_a_session_is_streamed_and_not_collected(spark):
    rows = [("s", 0, i, i % 7 > 0, float(i * 37 % 19)) for i in range(500)] + [("t", 0, 0, True, None), ("t", 0, 1, True, float("nan"))]
    df = spark.createDataFrame(rows, "session_id string, at long, frame_no long, document_detected boolean, movement double")
    df = df.withColumn("ts", F.timestamp_micros("at")).drop("at").repartition(3)
    live, simple, want = 0, 0, {}
    for s, _, i, seen, m in rows[:500]:
        live = (live + 1 if m <= 9 else max(0, live - 1) if m <= 9 * 1.7 else 0) if seen else max(0, live - 1)
        simple = simple + 1 if m <= 4.8 else max(0, simple - 1)
        want[s, i] = live, simple
    want |= {("t", 0): (0, 0), ("t", 1): (0, 0)}
    jobs = [live_states(df), stability_counts(df)]
    found = [{(r["session_id"], r["frame_no"]): r["stable"] for r in job.collect()} for job in jobs]
    assert found == [{k: v[n] for k, v in want.items()} for n in (0, 1)]
    for job in jobs:
        plan = job._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan


def test_a_movement_at_the_threshold_in_decimals_takes_one_off(spark):
    """9 * 1.7 is below 15.3 in binary, not in decimals."""
    rows = [("s", i, True, m) for i, m in enumerate([1.0, 9.0, 2.0, 15.3, 15.31, 1.0, 1.0, 15.29])]
    df = spark.createDataFrame(rows, "session_id string, frame_no long, document_detected boolean, movement double").withColumn("ts", F.timestamp_micros("frame_no"))
    want = [1, 2, 3, 2, 0, 1, 2, 1]
    for hot in (1 << 16, 0):
        assert [r["stable"] for r in live_states(df, hot=hot, span_us=3).orderBy("frame_no").collect()] == want
    counts, streamed = 0, []
    for _, _, _, m in rows:
        counts = next_stable(counts, True, m, 9.0)
        streamed.append(counts)
    assert streamed == want
