"""Streams against their batch twins on the same events."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from folioguard.operators import edits, frames
from folioguard.plans import fixtures as fx
from folioguard.streaming.live import live_stream, settle_stream
from folioguard.streaming.logs import autosave_stream, page_edit_stream, scan_state_stream

SF = "/root/testdata/sf0.001"


def streamed(spark, df, order, parts=3):
    """``df`` as a stream of ``parts`` files, one micro-batch each, in order."""
    path = tempfile.mkdtemp(prefix="spark-")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def few(spark):
    return fx.frames(spark, SF).where("frame_no < 200")


def test_live_states_of_always_seen_documents(spark, few):
    f = few.withColumn("document_detected", F.lit(True))
    got = run(live_stream(streamed(spark, f, "frame_no")), "live").select("session_id", "frame_no", "stable", "status", "capture")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.live_states(f).collect()))


def test_live_states_and_corners_with_misses_and_jumps(spark, few):
    """Frames 9 to 30 of every 40 miss the document, and its corners jump at times."""
    seen = (F.col("frame_no") % 40 < 9) | (F.col("frame_no") % 40 > 30) | (F.col("frame_no") % 3 == 0) & (F.col("frame_no") > 100)
    moved = F.col("corners")
    far = F.when(F.col("frame_no") % 7 == 0, 0.4).otherwise(0.0)
    jumped = F.struct(*[F.struct((moved[n]["x"] + far).alias("x"), moved[n]["y"].alias("y")).alias(n) for n in ("top_left", "top_right", "bottom_right", "bottom_left")])
    f = few.withColumn("session_id", (F.col("frame_no") % 2).cast("string")).withColumns({"document_detected": seen, "corners": jumped, "movement": (F.col("frame_no") * 7 % 17).cast("double")})
    got = run(live_stream(streamed(spark, f, "frame_no")), "missed")
    rows = got.select("session_id", "frame_no", "stable", "status", "capture").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, frames.live_states(f).collect())) and {r["status"] for r in rows} == {"positioning", "moving", "ready"}
    corners = {r["frame_no"]: r["corners"] for r in got.collect()}
    batch = {r["frame_no"]: r["tracked"] for r in frames.tracked_corners(f).collect()}
    assert corners.keys() == batch.keys() and all((corners[i] or None) == batch[i] for i in batch)
    assert None in batch.values()


def test_misses_keep_and_then_drop_corners(spark, few):
    one = few.withColumn("session_id", F.lit("s")).withColumn("movement", F.lit(1.0)).withColumn("document_detected", F.col("frame_no") < 3).where("frame_no < 14")
    rows = {r["frame_no"]: r for r in run(live_stream(streamed(spark, one, "frame_no")), "misses").collect()}
    assert [rows[i]["status"] == "positioning" for i in range(14)] == [False] * 10 + [True] * 4
    assert rows[9]["corners"] and not rows[10]["corners"] and rows[5]["stable"] == 6 and rows[13]["stable"] == 6


def test_late_and_repeated_frames_are_dropped(spark, few):
    one = few.withColumn("session_id", F.lit("s")).withColumn("document_detected", F.lit(True)).where("frame_no < 9")
    again = one.unionByName(one.where("frame_no = 2"))
    ordered = again.withColumn("n", F.monotonically_increasing_id())
    got = run(live_stream(streamed(spark, ordered, "n").drop("n")), "late").count()
    assert got == 9


def test_settle(spark, few):
    quick = few.withColumn("ts", F.timestamp_millis(F.col("frame_no") * 40))
    got = run(settle_stream(streamed(spark, quick, "frame_no", 1)), "settle")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.settle_frames(quick).collect()))


def captures(spark, rows):
    return spark.createDataFrame(rows, "session_id string, frame_no long, ms long, movement double").withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_the_timer_goes_off_without_a_further_frame(spark):
    """One session stops after one frame, one after two; others move the watermark."""
    rows = [("once", 1, 1000, 9.0), ("twice", 1, 1100, 9.0), ("twice", 2, 1500, 1.0), ("moves", 1, 2000, 9.0), ("moves", 2, 3300, 9.0), ("quiet", 1, 3400, 9.0), ("quiet", 2, 3500, 1.0), ("quiet", 3, 3600, 1.0),
            ("clock", 1, 200_000, 9.0), ("quiet", 4, 210_000, 1.0)]
    df = captures(spark, rows)
    batch = {(r["session_id"], r["frame_no"], r["why"]) for r in frames.settle_frames(df).collect()}
    assert batch == {("once", 1, "timeout"), ("twice", 2, "timeout"), ("moves", 2, "timeout"), ("quiet", 3, "quiet"), ("clock", 1, "timeout")}
    got = run(settle_stream(streamed(spark, df, "ts", 5)), "timer").collect()
    # The last session waits until the watermark passes its timer.
    assert sorted(map(tuple, got)) == sorted(batch - {("clock", 1, "timeout")})


def test_the_timer_by_the_clock(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    df = captures(spark, [("once", 7, 1000, 9.0), ("quiet", 1, 1000, 9.0), ("quiet", 2, 1100, 1.0), ("quiet", 3, 1200, 1.0)])
    df.coalesce(1).write.mode("append").parquet(path)
    stream = settle_stream(spark.readStream.schema(df.schema).parquet(path), clock="processing")
    query = stream.writeStream.format("memory").queryName("clock").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            rows = sorted(map(tuple, spark.table("clock").collect()))
            if len(rows) == 2:
                break
        assert rows == [("once", 7, "timeout"), ("quiet", 3, "quiet")]
    finally:
        query.stop()


def test_autosaves_and_the_gap_itself(spark):
    ms = [0, 100, 800, 1499, 2199, 2900, 60_000]
    rows = [("d", f"t{i}", m, i) for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "id string, title string, ms long, seq long").select("id", "title", F.timestamp_millis("ms").alias("updated_at"), "seq")
    batch = sorted((r["seq"], r["n_edits"]) for r in frames.autosaves(df).collect())
    # Edits exactly 700 ms apart are one burst; 701 ms starts another.
    assert batch == [(4, 5), (5, 1), (6, 1)]
    got = run(autosave_stream(streamed(spark, df, "seq")), "autosave")
    assert sorted((r["seq"], r["n_edits"]) for r in got.collect()) == batch[:-1]  # the last burst waits for the watermark


def test_scan_states(spark):
    rows = [("f", 1, "loading", 0.2, 0, 1), ("f", 1, "done", 1.0, 3, 2), ("f", 2, "error", 0.4, 5, 3), ("f", 3, "loading", 0.1, 0, 4), ("f", 3, "loading", 0.9, 0, 5)]
    df = spark.createDataFrame(rows, "folder_id string, doc_id long, status string, progress double, n_detections int, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    got = run(scan_state_stream(streamed(spark, df, "seq")), "states", "complete")
    want = [("f", 1, "done", 1.0, 3), ("f", 2, "error", 0.4, 0), ("f", 3, "loading", 0.9, 0)]
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, frames.latest_states(df).collect()))


def test_page_edits(spark):
    log = [("add", "a", None, None, None, 0), ("add", "b", None, None, None, 1), ("add", "c", None, None, None, 2), ("move", None, 2, -1, None, 3), ("move", None, 9, 1, None, 4),
           ("remove", "c", None, None, None, 100), ("undo", None, None, None, None, 4000), ("replace", "b", None, None, "B", 5000), ("remove", "a", None, None, None, 6000), ("undo", None, None, None, None, 12000)]
    rows = [("s", i, *r[:-1], 1_000_000 + r[-1]) for i, r in enumerate(log)]
    df = spark.createDataFrame(rows, "session_id string, seq long, op string, page string, index int, direction int, payload string, ms long")
    assert [r["pages"] for r in edits.page_edits(df).collect()] == [["c", "B"]]
    last = run(page_edit_stream(streamed(spark, df, "seq")), "edits", "update").collect()
    assert last[-1]["pages"] == ["c", "B"] and len(last) == 3


def test_review_clicks(spark):
    rows = [(1, -1, ["a"], True), (1, -1, ["b"], False), (1, 1, ["a", "b"], None), (1, 2, ["a"], None), (1, 3, ["zz"], None), (2, -1, ["x"], True), (2, 5, ["x"], None)]
    got = {r["doc_id"]: r["selected"] for r in edits.review_clicks(spark.createDataFrame(rows, "doc_id long, seq long, ids array<string>, start boolean")).collect()}
    assert got == {1: ["b"], 2: []}
