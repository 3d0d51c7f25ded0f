"""Assignment of slots in folders that are cut into ranges, against a plain loop."""

import random

import numpy as np
import pytest

from folioguard.operators import assign
from folioguard.rules import MULTI, SLOTS

DOCS, TURNS = "folder_id string, id long, slot string", "folder_id string, id long, turn long, wanted string"
SINGLES = [s for s in SLOTS if s not in MULTI]


def plain(docs, turns):
    slot = {(f, i): s for f, i, s in docs}
    for f, i, _, wanted in sorted((t for t in turns if t[0] is not None and t[3] is not None), key=lambda t: (t[0], t[2], t[1], t[3])):
        if (f, i) not in slot or slot[f, i] == wanted:
            continue
        if wanted not in SINGLES or not any(s == wanted for (g, j), s in slot.items() if g == f):
            slot[f, i] = wanted
    return slot


def case(seed, n, crowd, again):
    rng = random.Random(seed)
    docs = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice(SINGLES) if rng.random() < crowd else rng.choice([None, MULTI[0]])) for i in range(n)]
    turns = []
    for f, i, _ in docs:
        for _ in range(rng.choice(again)):
            turns.append((f, i, rng.randrange(3 * n), rng.choice([*SLOTS, MULTI[0], MULTI[0], None])))
    turns += [("hot", -5, 3, SLOTS[0]), ("none", 1, 1, SLOTS[0])]
    rng.shuffle(turns)
    return docs, turns


@pytest.mark.parametrize(("seed", "n", "crowd", "again", "parts"), [(1, 300, 0.02, (1,), 9), (2, 300, 0.3, (1, 1, 2), 7), (3, 200, 0.05, (0, 2, 5), 6), (4, 120, 0.9, (3,), 5), (5, 100, 0.1, (1, 2), 1)])
def test_cut_folders_equal_a_plain_loop(spark, seed, n, crowd, again, parts):
    docs, turns = case(seed, n, crowd, again)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = assign.assign_slots(spark.createDataFrame(docs, DOCS), spark.createDataFrame(turns, TURNS))
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(docs)
    assert {(r["folder_id"], r["id"]): r["slot"] for r in rows} == plain(docs, turns)


def test_tables_compose_like_runs():
    rng = random.Random(7)
    for _ in range(200):
        held = [rng.choice([0, 1, 3, 50]) for _ in SINGLES]
        slots = [s for s, n in zip(SINGLES, held, strict=True) for _ in range(n)] + [None] * 10
        turns = [(i, slots[i], rng.choice(SLOTS)) for i in (rng.randrange(len(slots)) for _ in range(40))]
        after = assign.walk(held, assign.table_of(turns, SINGLES))
        now, left = list(slots), list(held)
        least = list(held)
        for i, _, wanted in turns:
            if wanted != now[i] and (wanted in MULTI or wanted not in now):
                now[i] = wanted
            left = [now.count(s) for s in SINGLES]
            least = np.minimum(least, left).tolist()
        if after is None:
            assert any(n >= 2 and k < 1 for n, k in zip(held, least, strict=True)) or any(n >= 2 for n in held)
        else:
            assert after == left


def test_no_turns(spark):
    docs = [("f", 1, SLOTS[0]), ("f", 2, None)]
    got = assign.assign_slots(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], TURNS)).collect()
    assert {(r["id"], r["slot"]) for r in got} == {(1, SLOTS[0]), (2, None)}
