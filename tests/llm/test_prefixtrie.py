"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from folioguard.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """The turns of each conversation; ties follow the digest."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[c].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(r, t) for _, _, r, _, t in sorted(ts)] for c, ts in turns.items()}


def spliced(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100 * (1 if c >= 0 else -1)
        out[c] = turns.get(c - rest, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, out = defaultdict(list), {}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in kids[p]) or 1
        saved = sum(totals[k][1] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        totals[p] = leaves, saved
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], sha)
    return out


def got(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def some(seed, n, hot):
    """Conversations of few different turns: common starts, copies, one of them hot."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 3000), n):
        length = rng.choice([1, 1, 2, 3, 5, 9])
        words = ["same"] * length if rng.random() < hot else [rng.choice(["a", "bb", "", "äö"]) for _ in range(length)]
        rows += [(c, i, rng.choice(["user", "user", None]) if i % 2 == 0 else "assistant", w) for i, w in enumerate(words)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "hot", "parts", "fan"), [(1, 400, 0.3, 7, 64), (2, 400, 0.9, 13, 2), (3, 60, 0.0, 40, 3), (4, 300, 1.0, 9, 4)])
def test_trie_against_a_dictionary(spark, seed, n, hot, parts, fan):
    rows = some(seed, n, hot)
    turns = ordered(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        convs = pt.sequences(spark.createDataFrame(rows, SCHEMA))
        assert got(pt.prefix_trie(convs, fan=fan)) == plain(turns)
        assert got(pt.prefix_trie(pt.rebuilt(convs), fan=fan)) == plain(spliced(turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_ties_repeats_turnless_and_long_conversations(spark):
    long = [(700, i, "user", "x" * (i % 5)) for i in range(3000)]
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, None, None), (1, 3, "a", "tie"), (1, 3, "a", "other tie"), (1, 2, "user", "y"), *long,
            *[(800, t, r, x) for _, t, r, x in long], (305, 0, "user", "gone"), (0, None, "", "first")]
    turns = ordered(rows)
    clash = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", seq string, lens int")
    convs = pt.sequences(clash)
    assert got(pt.prefix_trie(convs)) == plain(turns)
    again = got(pt.prefix_trie(pt.rebuilt(convs)))
    assert again == plain(spliced(turns))
    assert pt.prefix_trie(pt.rebuilt(pt.sequences(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)  # its first turn is replaced by none
    rows = [(turnless, 0, "user", "a")]
    out = got(pt.prefix_trie(pt.rebuilt(pt.sequences(spark.createDataFrame(rows, SCHEMA)))))
    assert out == {(turnless, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
