"""Slots of a folder's documents after many turns.

A turn depends on all before it, but on little of them: which of the few slots for
a single document are free, and where its own document is.  Turns are cut into
ranges of even size.  A folder in one range is streamed.  Of a larger one, each range
is run from every state that the single slots can be in, all at once: free, held by
one document, or held by more than leave it in the range.  The tables of ranges are
walked through to find the state that each starts from, and the ranges are then run
from it, side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules import MULTI, SLOTS
from ..sources.scratch import settle

#: More documents than can leave a slot: what a slot holds that stays taken.
FULL = 1 << 40
KEYS = ["folder_id", "part"]
ROWS = ["turn", "id", "now", "wanted", "held"]
_HELD = {"folder_id": pa.string(), "part": pa.int32(), "held": pa.list_(pa.int64())}
_MOVE = {"folder_id": pa.string(), "part": pa.int32(), "id": pa.int64(), "turn": pa.int64(), "seq": pa.int64(), "slot": pa.string()}


def _codes(singles: list[str]) -> dict[str | None, int]:
    return {None: -1} | {s: i for i, s in enumerate(singles)}


def patterns(m: int) -> np.ndarray:
    """All states of ``m`` single slots: free, one document, more than one."""
    return np.array(list(itertools.product((0, 1, FULL), repeat=m)), np.int64).reshape(3**m, m)


def pattern_of(held: list[int]) -> int:
    """The row of ``patterns`` for a number of documents in each slot."""
    at = 0
    for n in held:
        at = 3 * at + min(n, 2)
    return at


def table_of(turns: list[tuple], singles: list[str]) -> np.ndarray:
    """The states after ``turns`` (id, slot, wanted slot) from each of ``patterns``;
    the slots that documents had at first are those given."""
    m, codes = len(singles), _codes(singles)
    counts = patterns(m)
    own: dict[object, object] = {}
    for i, now, wanted in turns:
        at, want = own.get(i, codes.setdefault(now, len(codes))), codes.setdefault(wanted, len(codes))
        ok = np.broadcast_to(np.asarray(at != want), len(counts))
        if want < m:
            ok = ok & (counts[:, want] == 0)
        if not ok.any():
            continue
        for s in {at} if isinstance(at, int) else set(at.tolist()):
            if 0 <= s < m:
                counts[ok & (at == s), s] -= 1
        if want < m:
            counts[ok, want] += 1
        own[i] = want if ok.all() else np.where(ok, want, at)
    return counts


def walk(held: list[int], table: np.ndarray) -> list[int] | None:
    """What the slots hold after a range; None if a slot that holds several
    documents may become free within it, which the table does not tell."""
    after = table[pattern_of(held)]
    out = [int(n) if before < 2 else before - (FULL - int(n)) for before, n in zip(held, after, strict=True)]
    return None if any(before >= 2 and n < 1 for before, n in zip(held, out, strict=True)) else out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    yield from itertools.groupby(rows, key=lambda r: r[:2])


def _run(rows: DataFrame, singles: list[str], moves: bool) -> DataFrame:
    """Each range of ``rows`` (``folder_id``, ``part``, ``turn``, ``id``, ``now``,
    ``wanted``, ``held``: what its single slots hold at its start) in order: its
    ``moves``, or what its slots hold at the end."""
    places = {s: i for i, s in enumerate(singles)}
    made = _MOVE if moves else _HELD

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), made.values(), strict=True)], list(made))

        for (folder, part), turns in _groups(batches):
            held: list[int] | None = None
            moved: dict[int, str] = {}
            for seq, (_, _, turn, i, now, wanted, start) in enumerate(turns):
                held = list(start) if held is None else held
                now, want = moved.get(i, now), places.get(wanted)
                if wanted != now and (want is None or not held[want]):
                    if now in places:
                        held[places[now]] -= 1
                    if want is not None:
                        held[want] += 1
                    moved[i] = wanted
                    if moves:
                        out.append((folder, part, i, turn, seq, wanted))
                        if len(out) >= 10_000:
                            yield batch()
                            out.clear()
            if not moves:
                out.append((folder, part, held))
        if out:
            yield batch()

    schema = "folder_id string, part int, id long, turn long, seq long, slot string" if moves else "folder_id string, part int, held array<long>"
    return _ordered(rows).mapInArrow(fold, schema)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, *ROWS).repartition(*KEYS).sortWithinPartitions(*KEYS, "turn", "id", "wanted")


def _tables(rows: DataFrame, singles: list[str]) -> DataFrame:
    """(``folder_id``, ``part``, ``table``: 64-bit numbers) of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (folder, part), turns in _groups(batches):
            table = table_of([(i, now, wanted) for _, _, _, i, now, wanted, _ in turns], singles)
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([part], pa.int32()), pa.array([table.tobytes()])], [*KEYS, "table"])

    return _ordered(rows).mapInArrow(run, "folder_id string, part int, table binary")


def _starts(tables: DataFrame, singles: list[str], known: DataFrame | None, first: DataFrame) -> DataFrame:
    """(``folder_id``, ``part``, ``held``, ``open``) of the ranges whose start
    follows from ``first`` (``folder_id``, ``held``), the ``tables`` and what is
    ``known`` to be held at the end of some; ``open``: the range has to be run."""
    m = len(singles)
    joined = tables.join(first, "folder_id").withColumn("end", F.lit(None).cast("array<long>"))
    if known is not None:
        joined = joined.drop("end").join(known.select(*KEYS, F.col("held").alias("end")), KEYS, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, held, begun = None, None, False
        for batch in batches:
            out = []
            for f, part, table, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or f != folder:
                    folder, held, begun = f, list(start), True
                if held is None:
                    continue
                after = list(end) if end is not None else walk(held, np.frombuffer(table, np.int64).reshape(-1, m))
                out.append((f, part, held, after is None))
                held = after
            if out:
                types = (*_HELD.values(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*_HELD, "open"])

    ordered = joined.select("folder_id", "part", "table", "held", "end").repartition("folder_id").sortWithinPartitions(*KEYS)
    return ordered.mapInArrow(run, "folder_id string, part int, held array<long>, open boolean")


def _moves_of_large(rows: DataFrame, first: DataFrame, singles: list[str]) -> DataFrame:
    """The moves of folders that are in several ranges.

    Where documents have turns in several ranges, ranges are run with the slots
    that the run before gave them, until these no longer change.  What every run
    has right grows by a range at least; where turns of a document are far apart,
    as in passes over a folder, by a whole pass.
    """
    strays = settle(rows.groupBy("folder_id", "id").agg(F.collect_set("part").alias("parts")).where(F.size("parts") > 1), "assign-strays")
    entered: DataFrame | None = None
    while True:
        now = rows
        if entered is not None:
            now = rows.join(entered, [*KEYS, "id"], "left").withColumn("now", F.coalesce("entered", "now")).drop("entered")
        tables = settle(_tables(now.withColumn("held", F.lit(None).cast("array<long>")), singles), "assign-tables")
        known: DataFrame | None = None
        while True:
            starts = settle(_starts(tables, singles, known, first), "assign-starts")
            todo = starts.where("open")
            if todo.isEmpty():
                break
            ends = settle(_run(now.join(todo.drop("open"), KEYS), singles, False), "assign-ends")
            known = ends if known is None else known.unionByName(ends)
        moves = settle(_run(now.join(starts.drop("open"), KEYS), singles, True), "assign-moves")
        if strays.isEmpty():
            return moves
        last = moves.join(strays.select("folder_id", "id"), ["folder_id", "id"]).groupBy("folder_id", "id", "part").agg(F.max_by("slot", F.struct("turn", "seq")).alias("slot"))
        before = W.partitionBy("folder_id", "id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        each = strays.select("folder_id", "id", F.explode("parts").alias("part")).join(last, ["folder_id", "id", "part"], "left")
        again = settle(each.withColumn("entered", F.last("slot", ignorenulls=True).over(before)).where("entered is not null").select(*KEYS, "id", "entered"), "assign-entered")
        if entered is None:
            same = again.isEmpty()
        else:
            old = entered.withColumnRenamed("entered", "old")
            same = again.join(old, [*KEYS, "id"], "full").where(~F.col("entered").eqNullSafe(F.col("old"))).isEmpty()
        if same:
            return moves
        entered = again


def assign_slots(documents: DataFrame, turns: DataFrame, *, slots=SLOTS, multi=MULTI) -> DataFrame:
    """(``folder_id``, ``id``, ``slot``) after all ``turns`` (``folder_id``,
    ``id``, ``turn``, ``wanted``) in order.

    A turn moves its document to the wanted slot if that takes several documents
    or no other document is in it; else nothing happens.  A turn without a wanted
    slot does nothing, nor one of a document that is not there.  A moved document
    frees its slot.  Turns of one number follow the id, then the wanted slot.
    Slots that are not among ``slots`` take several documents.

    A range of turns has to fit a task, whatever its folder; a slot's states and
    the tables of ranges are of fixed size.
    """
    singles = [s for s in slots if s not in multi]
    counts = [F.count_if(F.col("slot") == s).alias(f"n{i}") for i, s in enumerate(singles)]
    first = documents.groupBy("folder_id").agg(*counts).select("folder_id", F.array(*[F.col(f"n{i}") for i in range(len(singles))]).alias("held"))
    steps = turns.where("wanted is not null").select("folder_id", "id", F.col("turn").cast("long").alias("turn"), "wanted").join(documents.select("folder_id", "id", F.col("slot").alias("now")), ["folder_id", "id"])
    rows = settle(steps.repartitionByRange("folder_id", "turn", "id", "wanted").withColumn("part", F.spark_partition_id()), "assign-turns")
    spread = rows.groupBy("folder_id").agg((F.min("part") < F.max("part")).alias("large"))
    if spread.where("large").isEmpty():
        moves = _run(rows.join(first, "folder_id"), singles, True)
    else:
        sized = rows.join(spread, "folder_id")
        moves = _run(sized.where("not large").join(first, "folder_id"), singles, True).unionByName(_moves_of_large(settle(sized.where("large").drop("large"), "assign-large"), first, singles))
    last = moves.groupBy("folder_id", "id").agg(F.max_by("slot", _place()).alias("moved"))
    return documents.join(last, ["folder_id", "id"], "left").select("folder_id", "id", F.coalesce("moved", "slot").alias("slot"))


def _place() -> Column:
    return F.struct("part", "turn", "seq")
