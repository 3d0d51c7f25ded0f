"""Autosaves, scan states and page edits over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edits import edit
from ..operators.frames import autosaves, latest_states
from .live import expire


def autosave_stream(versions: DataFrame, *, gap: str = "700 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of draft edits, once the watermark is past its gap.
    Versions later than ``late`` are dropped; that bound is ours."""
    return autosaves(versions.withWatermark("updated_at", late), gap)


def scan_state_stream(log: DataFrame) -> DataFrame:
    """The last state of each document, for update or complete mode."""
    return latest_states(log)


def page_edit_stream(log: DataFrame, *, late: str = "1 minute") -> DataFrame:
    """The pages of a session after each micro-batch that edits it (``ms`` is the
    event time)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {"pages": [], "gone": None, "seq": -1, "ms": 0}
        for p in parts:
            for r in p.sort_values("seq").astype(object).where(p.notna(), None).to_dict("records"):
                if r["seq"] > now["seq"]:
                    seq = int(r["seq"])
                    now = edit(now, r | {"index": None if r["index"] is None else int(r["index"]), "direction": None if r["direction"] is None else int(r["direction"])})
                    now |= {"seq": seq, "ms": max(now["ms"], int(r["ms"]))}
        state.update((json.dumps(now, default=int),))
        expire(state, float(now["ms"]))
        yield pd.DataFrame({"session_id": [key[0]], "pages": [now["pages"]]})

    timed = log.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(step, "session_id string, pages array<string>", "state string", "update", GroupStateTimeout.EventTimeTimeout)


def batch_progress_of(states: DataFrame) -> DataFrame:
    """``completed`` and ``total`` of the folders in a table of last states."""
    return states.groupBy("folder_id").agg(F.count_if(F.col("status") == "done").alias("completed"), F.count(F.lit(1)).alias("total"))
