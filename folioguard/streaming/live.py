"""Live capture: stability and tracked corners per session, over a stream.

The reference rules know no event time.  Frames of a micro-batch are put in order
of (``ts``, ``frame_no``); a frame older than one already counted for its session
is dropped; a session's state goes once the watermark is ten minutes past its
last frame.  Watermark and expiry are ours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import CORNERS, slack, track

QUIET_MS = 600_000
CORNER = "struct<top_left: struct<x: double, y: double>, top_right: struct<x: double, y: double>, bottom_right: struct<x: double, y: double>, bottom_left: struct<x: double, y: double>>"
OUT = "session_id string, frame_no long, stable int, status string, capture boolean, progress double, corners array<double>"
STATE = "last_ts double, last_frame long, stable int, misses int, corners array<double>"


def next_stable(stable: int, detected: bool, movement: float, threshold: float) -> int:
    if detected and movement <= threshold:
        return stable + 1
    if not detected or movement <= slack(threshold):
        return max(0, stable - 1)
    return 0


def flat(corners: dict | None) -> list[float] | None:
    return None if corners is None else [corners[n][a] for n, a in CORNERS]


def expire(state: GroupState, last_ms: float) -> None:
    """Let a state go when the watermark is ``QUIET_MS`` past the last event."""
    state.setTimeoutTimestamp(int(max(last_ms, state.getCurrentWatermarkMs())) + QUIET_MS)


def live_stream(frames: DataFrame, *, late: str = "1 minute", threshold: float = 9.0, ready: int = 4, capture: int = 5) -> DataFrame:
    """The state after each frame of a stream of (``session_id``, ``ts``,
    ``frame_no``, ``document_detected``, ``movement``, ``corners``).

    A document counts as seen for up to seven frames that miss it; with the eighth
    its corners are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_ts, last_frame, stable, misses, corners = state.get if state.exists else (-math.inf, -1, 0, 0, None)
        corners = list(corners) if corners is not None and len(corners) else None
        rows = sorted((r for p in parts for r in p.to_dict("records")), key=lambda r: (r["ts"], r["frame_no"]))
        out = []
        for r in rows:
            at = r["ts"].timestamp()
            if (at, r["frame_no"]) <= (last_ts, last_frame):
                continue
            last_ts, last_frame = at, int(r["frame_no"])
            misses, corners, seen = track(misses, corners, bool(r["document_detected"]), flat(r["corners"]))
            stable = next_stable(stable, seen, r["movement"], threshold)
            status = "positioning" if not seen else "ready" if stable >= ready else "moving"
            out.append((key[0], last_frame, stable, status, seen and stable >= capture, min(1.0, stable / capture), corners))
        state.update((last_ts, last_frame, stable, misses, corners or []))
        expire(state, last_ts * 1000)
        yield pd.DataFrame(out, columns=["session_id", "frame_no", "stable", "status", "capture", "progress", "corners"])

    return frames.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle_stream(frames: DataFrame, *, late: str = "1 minute", threshold: float = 4.8, timeout_ms: int = 1200, clock: str = "event") -> DataFrame:
    """The frame at which a manual capture of each session goes off, once: after
    two quiet comparisons in a row, or by the timer, ``timeout_ms`` after the
    session's first frame.

    The timer reports ``timeout`` with the first frame past it or, where none has
    come when it goes off, with the last frame there was.  ``clock``: ``event``
    lets it go off when the watermark passes it, so that a replay gives the same
    rows; ``processing`` by the cluster's clock, for a capture that waits for it.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    by_event = clock == "event"

    def wait(state: GroupState, due: float, done: bool, last: float) -> None:
        if by_event:
            if done:
                expire(state, last)
            else:
                state.setTimeoutTimestamp(int(max(due, state.getCurrentWatermarkMs() + 1)))
        else:
            state.setTimeoutDuration(QUIET_MS if done else int(max(1, due - state.getCurrentProcessingTimeMs())))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, due, n, quiet, done, last, frame_no = state.get if state.exists else (0.0, 0.0, 0, 0, False, 0.0, -1)
        out = []
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            out.append((key[0], frame_no, "timeout"))
            done = True
        for r in sorted((r for p in parts for r in p.to_dict("records")), key=lambda r: (r["ts"], r["frame_no"])):
            last = max(last, r["ts"].timestamp() * 1000)
            if done:
                continue
            at, frame_no = r["ts"].timestamp() * 1000, int(r["frame_no"])
            if not n:
                began, due = at, (at if by_event else state.getCurrentProcessingTimeMs()) + timeout_ms
            quiet = (quiet + 1 if r["movement"] <= threshold else 0) if n else 0
            n += 1
            over = at - began >= timeout_ms
            if quiet >= 2 or over:
                out.append((key[0], frame_no, "timeout" if over else "quiet"))
                done = True
        state.update((began, due, n, quiet, done, last, frame_no))
        wait(state, due, done, last)
        yield pd.DataFrame(out, columns=["session_id", "frame_no", "why"])

    timed = frames.withWatermark("ts", late) if by_event else frames
    return timed.groupBy("session_id").applyInPandasWithState(
        step, "session_id string, frame_no long, why string", "began double, due double, n int, quiet int, done boolean, last double, frame_no long", "append",
        GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout,
    )
