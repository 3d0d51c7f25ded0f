"""Camera frames of a session in batch: movement, states, bursts, edits.

The folds over ordered frames stream a sorted session through one counter; they
are the batch twins of the streaming jobs.  Sessions of very many frames are cut at
spans of time instead, and what spans do to a counter is composed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructType

from ..sources.scratch import settle
from .fold import gathered
from .running import HOT, SPAN_US, Running, span_of, split_hot

#: Fixed value: with so many missed frames in a row a document is lost.
MISSES = 8
CORNERS = tuple((name, axis) for name in ("top_left", "top_right", "bottom_right", "bottom_left") for axis in ("x", "y"))


def frame_pairs(frames: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``frames`` with ``previous_<column>`` of the session's frame before."""
    order = W.partitionBy("session_id").orderBy("ts", "frame_no")
    return frames.withColumns({f"previous_{c}": F.lag(c).over(order) for c in columns})


def slack(threshold: float) -> float:
    """The movement up to which a counter falls by one instead of to 0: 1.7 times the
    threshold in decimals, as SQL multiplies; 9 * 1.7 in binary is just below 15.3."""
    return round(threshold * 1.7, 9)


def progress(stable: Column, capture_frames: int = 4) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), stable / float(capture_frames)))


def _folded(frames: DataFrame, columns: list[str], start: Callable[[], tuple], step: Callable[..., tuple], added: list[tuple]) -> DataFrame:
    """(``session_id``, ``frame_no``, ``columns``, ``added``) after each frame.

    Sessions are shuffled, sorted and streamed; a task holds one state.
    ``step``: (state, values of ``columns``) -> state, whose first numbers are the
    values of ``added`` ((name, Spark type, Arrow type) each).
    """
    kept = frames.select("session_id", "ts", "frame_no", *columns)
    schema = StructType([f for f in kept.schema.fields if f.name != "ts"])
    names = [f.name for f in schema.fields]
    for name, kind, _ in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, start(), False
        for batch in batches:
            out = []
            values = [batch.column(c).to_pylist() for c in columns]
            for session, *row in zip(batch.column("session_id").to_pylist(), *values, strict=True):
                if not begun or session != at:
                    at, state, begun = session, start(), True
                state = step(state, *row)
                out.append(state)
            made = [pa.array([x[i] for x in out], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, *[n for n, _, _ in added]])

    return gathered(kept, ["session_id"], "ts", "frame_no").mapInArrow(run, schema)


def smooth(previous: list[float] | None, current: list[float], weight: float = 0.58, jump: float = 0.18) -> list[float]:
    """Eight numbers, x and y of each corner: a moving average that starts again
    where the corners jump."""
    if not previous:
        return current
    far = sum(math.hypot(previous[i] - current[i], previous[i + 1] - current[i + 1]) for i in range(0, 8, 2)) / 4
    return current if far > jump else [p * (1 - weight) + c * weight for p, c in zip(previous, current, strict=True)]


def track(misses: int, corners: list[float] | None, detected: bool | None, current: list[float] | None) -> tuple[int, list[float] | None, bool]:
    """Misses in a row, tracked corners, and whether the document counts as seen
    after a frame: for up to seven frames that miss it; with the eighth its
    corners are dropped.  The average runs on the tracked corners."""
    if detected:
        return 0, smooth(corners, current) if current is not None else corners, True
    misses += 1
    corners = None if misses >= MISSES else corners
    return misses, corners, corners is not None


def _with_flat_corners(frames: DataFrame) -> DataFrame:
    """``corners`` as eight numbers, null where one is or where there are none."""
    if "corners" not in frames.columns:
        return frames.withColumn("corners", F.lit(None).cast("array<double>"))
    numbers = F.array(*[F.col(f"corners.{n}.{a}").cast("double") for n, a in CORNERS])
    return frames.withColumn("corners", F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers))


_TRACKED = "misses int, corners array<double>"


def _tracked(frames: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """``frames``, which have ``start`` (struct of misses and corners), folded in
    order within ``keys``: (``session_id``, ``frame_no``, ``seen``, ``tracked``) of
    each frame, or (``keys``, ``end``) alone.

    Keys are shuffled, sorted and streamed; a task holds one state.
    """
    fields = [f for f in frames.select(*(["session_id", "frame_no"] if every else keys)).schema.fields]
    schema = StructType(fields)
    schema = schema.add("seen", BooleanType()).add("tracked", ArrayType(DoubleType())) if every else schema.add("end", frames.schema["start"].dataType)
    names = [f.name for f in schema.fields]
    end_type = pa.struct([("misses", pa.int32()), ("corners", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, ends, begun = None, (0, None), [], False
        for batch in batches:
            out = []
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            values = zip(ids, batch.column("document_detected").to_pylist(), batch.column("corners").to_pylist(), batch.column("start").to_pylist(), strict=True)
            for key, detected, current, start in values:
                if not begun or key != at:
                    if begun:
                        ends.append((*at, {"misses": state[0], "corners": state[1]}))
                    at, begun = key, True
                    state = (start["misses"], start["corners"]) if start else (0, None)
                misses, corners, seen = track(*state, detected, current)
                state = (min(misses, MISSES), corners)
                if every:
                    out.append((seen, corners))
            if every:
                yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("frame_no"), pa.array([s for s, _ in out], pa.bool_()), pa.array([c for _, c in out], pa.list_(pa.float64()))], names)
        if not every:
            if begun:
                ends.append((*at, {"misses": state[0], "corners": state[1]}))
            columns = list(zip(*ends, strict=True)) if ends else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) if ends else pa.array([], pa.null()) for c in columns[:-1]], pa.array(columns[-1], end_type)], names)

    return gathered(frames, keys, "ts", "frame_no").mapInArrow(run, schema)


def tracked_corners(frames: DataFrame, *, hot: int = HOT, span_us: int = SPAN_US, exact: float = 1e-12) -> DataFrame:
    """(``session_id``, ``frame_no``, ``seen``, ``tracked``: eight numbers or null)
    after each frame, in order of (``ts``, ``frame_no``).

    Sessions of over ``hot`` frames are cut at spans of time.  Each span is folded
    from what the one before ended with in the last round, the first time from
    nothing, until no start changes by more than ``exact``.  The average forgets
    (0.42 of it stays per frame, none after a jump or a loss), so a span's end
    hardly ever depends on its start and few rounds are needed; each round settles
    one more span at the least.
    """
    work = _with_flat_corners(frames.select("session_id", "ts", "frame_no", "document_detected", *[c for c in frames.columns if c == "corners"]))
    none = F.lit(None).cast(f"struct<{_TRACKED.replace(' ', ': ', 1).replace(', corners ', ', corners: ')}>")
    cool, much = split_hot(work, "session_id", hot)
    made = _tracked(cool.withColumn("start", none), ["session_id"], True)
    if much.isEmpty():
        return made
    spans = settle(much.withColumn("span", span_of(F.col("ts"), span_us)), "frames-spans")
    keys = ["session_id", "span"]
    starts = settle(spans.select(*keys).distinct().withColumn("start", none), "frames-starts")
    todo = starts
    ends = None
    while True:
        new = _tracked(spans.join(todo, keys), keys, False)
        if ends is not None:
            new = ends.join(todo.select(*keys), keys, "left_anti").unionByName(new)
        ends = settle(new, "frames-ends")
        follow = ends.select(*keys, F.lag("end").over(W.partitionBy("session_id").orderBy("span")).alias("start"))
        both = follow.join(starts.withColumnRenamed("start", "old"), keys)
        near = F.forall(F.zip_with("start.corners", "old.corners", lambda a, b: F.abs(a - b) <= exact), lambda same: same)
        kept = F.col("start.corners").isNull() & F.col("old.corners").isNull() | F.coalesce(near, F.lit(False))
        same = (F.coalesce("start.misses", F.lit(0)) == F.coalesce("old.misses", F.lit(0))) & kept
        judged = settle(both.select(*keys, F.when(same, F.col("old")).otherwise(F.col("start")).alias("start"), (~same).alias("changed")), "frames-starts")
        starts = judged.drop("changed")
        todo = judged.where("changed").drop("changed")
        if todo.isEmpty():
            break
    return made.unionByName(_tracked(spans.join(starts, keys), keys, True))


#: A reset of a counter: lower than any count can be high; sums hold four billion.
RESET = -(1 << 31)


def _counted(made: Running, step: Column) -> DataFrame:
    """``stable``: a counter from 0 that adds ``step`` and never falls below 0.

    A step is the function ``x -> max(0, x + step)``; such functions compose to
    ``x -> max(floor, x + sum)``, so the counter is the running sum less the lowest
    running sum up to there.
    """
    made = made.add(__sum=("sum", step.cast("long")))
    df = made.add(__low=("min", F.col("__sum"))).df
    return df.withColumn("stable", (F.col("__sum") - F.least(F.lit(0), F.col("__low"))).cast("int"))


def _seen(made: Running) -> Running:
    """``seen`` of each frame, as ``track`` says: up to seven frames may miss a
    document whose corners are known; with the eighth they are dropped."""
    found = F.coalesce("document_detected", F.lit(False))
    made = made.add(__n=("sum", F.lit(1)))
    made = made.add(__found=("max", F.when(found, F.col("__n"))), __known=("max", F.when(found & F.col("has_corners"), F.col("__n"))))
    missed = F.col("__n") - F.coalesce("__found", F.lit(0))
    made = made.add(__dropped=("max", F.when(missed >= MISSES, F.col("__n"))))
    made.df = made.df.withColumn("seen", found | (F.coalesce("__known", F.lit(0)) > F.coalesce("__dropped", F.lit(0))))
    return made


def _over_sessions(frames: DataFrame, fold: Callable[[DataFrame], DataFrame], spans: Callable[[Running], DataFrame], hot: int, span_us: int) -> DataFrame:
    """``fold`` of sessions in one pass each and, for those of over ``hot`` frames,
    ``spans`` composed over them."""
    if frames.groupBy("session_id").count().where(F.col("count") > hot).isEmpty():
        return fold(frames)
    cool, much = split_hot(frames, "session_id", hot)
    return fold(cool).unionByName(spans(Running(much, "session_id", ("ts", "frame_no"), span_us)))


def live_states(frames: DataFrame, *, threshold: float = 9.0, ready: int = 4, capture: int = 5, hot: int = HOT, span_us: int = SPAN_US) -> DataFrame:
    """(``session_id``, ``frame_no``, ``stable``, ``status``, ``capture``) after
    each frame, in order of (``ts``, ``frame_no``).  A document stays seen over
    missed frames as ``track`` says; a movement that is null or no number counts
    as too much.  Sessions of over ``hot`` frames are cut at spans of time; frames
    of one span share a task."""
    kept = _with_flat_corners(frames).select("session_id", "ts", "frame_no", "document_detected", "movement", "corners")
    most = slack(threshold)

    def step(state: tuple, detected: bool | None, movement: float | None, current: list[float] | None) -> tuple:
        stable, _, misses, corners = state
        misses, corners, seen = track(misses, corners, detected, current)
        moved = math.inf if movement is None or movement != movement else movement
        if seen and moved <= threshold:
            stable += 1
        else:
            stable = max(0, stable - 1) if not seen or moved <= most else 0
        return stable, seen, misses, corners

    def fold(cool: DataFrame) -> DataFrame:
        added = [("stable", IntegerType(), pa.int32()), ("seen", BooleanType(), pa.bool_())]
        return _folded(cool, ["document_detected", "movement", "corners"], lambda: (0, False, 0, None), step, added).select("session_id", "frame_no", "stable", "seen")

    def spans(made: Running) -> DataFrame:
        made.df = made.df.withColumn("has_corners", F.col("corners").isNotNull())
        made, seen = _seen(made), F.col("seen")
        moved = F.when(F.isnan("movement"), None).otherwise(F.col("movement"))
        change = F.when(seen & (moved <= threshold), 1).when(~seen | (moved <= most), -1).otherwise(RESET)
        return _counted(made, change).select("session_id", "frame_no", "stable", "seen")

    each, seen, stable = _over_sessions(kept, fold, spans, hot, span_us), F.col("seen"), F.col("stable")
    status = F.when(~seen, "positioning").when(stable >= ready, "ready").otherwise("moving")
    return each.select("session_id", "frame_no", "stable", status.alias("status"), (seen & (stable >= capture)).alias("capture"))


def stability_counts(frames: DataFrame, *, threshold: float = 4.8, capture: int = 4, hot: int = HOT, span_us: int = SPAN_US) -> DataFrame:
    """(``session_id``, ``frame_no``, ``stable``, ``progress``) of the simpler
    counter after each frame, in order of (``ts``, ``frame_no``): up to the
    threshold, else down by one; a movement that is null or not finite resets it."""

    def step(state: tuple, movement: float | None) -> tuple:
        if movement is None or not math.isfinite(movement):
            return (0,)
        return (max(0, state[0] - 1) if movement > threshold else state[0] + 1,)

    def fold(cool: DataFrame) -> DataFrame:
        return _folded(cool, ["movement"], lambda: (0,), step, [("stable", IntegerType(), pa.int32())]).select("session_id", "frame_no", "stable")

    def spans(made: Running) -> DataFrame:
        finite = F.coalesce(~F.isnan("movement") & (F.abs("movement") < float("inf")), F.lit(False))
        change = F.when(~finite, RESET).when(F.col("movement") > threshold, -1).otherwise(1)
        return _counted(made, change).select("session_id", "frame_no", "stable")

    each = _over_sessions(frames.select("session_id", "ts", "frame_no", "movement"), fold, spans, hot, span_us)
    return each.select("session_id", "frame_no", "stable", progress(F.col("stable"), capture).alias("progress"))


def settle_frames(frames: DataFrame, *, threshold: float = 4.8, timeout_ms: int = 1200) -> DataFrame:
    """The frame at which a manual capture of each session goes off: the second of
    two quiet comparisons in a row, or the first frame after the timeout; of a
    session that ends before either, the last frame, by the timeout."""
    order = W.partitionBy("session_id").orderBy("ts", "frame_no")
    f = frames.withColumn("quiet", F.col("movement") <= threshold).withColumn("n", F.row_number().over(order)).withColumn("began", F.min("ts").over(W.partitionBy("session_id")))
    two = F.col("quiet") & F.coalesce(F.lag("quiet").over(order), F.lit(False)) & (F.col("n") > 2)
    late = F.unix_micros("ts") - F.unix_micros("began") >= timeout_ms * 1000
    f = f.withColumn("two", F.coalesce(two, F.lit(False))).withColumn("late", late)
    place, why = F.struct("ts", "frame_no"), F.when(F.col("two") & ~F.col("late"), "quiet").otherwise("timeout")
    hit = F.min_by(F.struct("frame_no", why.alias("why")), F.when(F.col("two") | F.col("late"), place))
    last = F.struct(F.max_by("frame_no", place).alias("frame_no"), F.lit("timeout").alias("why"))
    return f.groupBy("session_id").agg(F.coalesce(hit, last).alias("x")).select("session_id", "x.frame_no", "x.why")


def sharpest(frames: DataFrame) -> DataFrame:
    """The sharpest frame of each burst; of equal ones the first."""
    best = F.max_by(F.struct("frame_no", "score"), F.struct("score", -F.col("frame_no")))
    return frames.groupBy("session_id", "burst").agg(best.alias("b")).select("session_id", "burst", "b.frame_no", "b.score")


def latest_states(log: DataFrame) -> DataFrame:
    """The last state of each document by (``ts``, ``seq``); an error resets the
    number of detections."""
    last = F.max_by(F.struct("status", "progress", F.when(F.col("status") == "error", 0).otherwise(F.col("n_detections")).alias("n_detections")), F.struct("ts", "seq"))
    return log.groupBy("folder_id", "doc_id").agg(last.alias("s")).select("folder_id", "doc_id", "s.*")


def toggled(detections: DataFrame, log: DataFrame) -> DataFrame:
    """``detections`` after single toggles (``doc_id``, ``detection_id``): an odd
    number flips ``selected``; ``changed`` says that the document was touched."""
    flips = log.groupBy("doc_id", "detection_id").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    touched = log.select("doc_id").distinct().withColumn("changed", F.lit(True))
    out = detections.join(flips, ["doc_id", "detection_id"], "left").join(touched, "doc_id", "left")
    return out.withColumn("selected", F.col("selected") != F.coalesce("odd", F.lit(False))).withColumn("changed", F.coalesce("changed", F.lit(False))).drop("odd")


def autosaves(versions: DataFrame, gap: str = "700 milliseconds") -> DataFrame:
    """The last version of each burst of edits that ``gap`` of quiet ends.  Edits
    exactly ``gap`` apart are one burst."""
    last = F.max_by(F.struct("seq", "title"), F.struct("updated_at", "seq"))
    return versions.groupBy("id", F.session_window("updated_at", gap).alias("w")).agg(last.alias("v"), F.count(F.lit(1)).alias("n_edits")).select(
        "id", F.col("w.start").alias("started"), "v.seq", "v.title", "n_edits"
    )
