"""SimHash groups against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folioguard.llm import simhash
from folioguard.llm.components import components
from folioguard.llm.simhash import fingerprint, near_groups, signature_links


def plain_print(text, width=3):
    out, words = [], []
    word = ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words = [w for w in [*words, word] if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def unsigned(x):
    return x & (1 << 64) - 1


def plain_roots(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \n", "One", "one two", "One TWO three", "É é Ö", "a b c d " * 30, "x\x1cy z w v", "日本 語 です ね"]


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(rng.choices("ab cd\nEf G h".split(" "), k=rng.randint(0, 40))) for _ in range(100))]
    for t in texts:
        for width in (1, 3, 5):
            assert unsigned(fingerprint(t, width)) == plain_print(t, width), t
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    for t in texts:
        assert unsigned(fingerprint(t)) == plain_print(t), t


def cluster(rng, n, bits):
    """Fingerprints around a few centres, some with one segment in common."""
    out = set()
    while len(out) < n:
        x = rng.choice([0, 2**64 - 1, 0x123456789ABCDEF0, 0xFFFFFFFF << 32])
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.choice(bits)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("crowded", [3, 1000])
@pytest.mark.parametrize("max_bits", [0, 2, 3, 5])
def test_links(spark, max_bits, crowded):
    rng = random.Random(max_bits)
    prints = cluster(rng, 130, range(64) if max_bits != 2 else [*range(8), 40, 63])
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(r["a"], r["b"]) for r in signature_links(df, max_bits=max_bits, crowded=crowded).collect()]
    want = [(a, b) for a in signed for b in signed if a < b and (unsigned(a) ^ unsigned(b)).bit_count() <= max_bits]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 230)] + [(5, 5), (None, 3), (7, 6)]
    rng.shuffle(links)
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_with_nulls_copies_and_clashing_names(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices(["ka", "lo", "mi", "nu", "re"], k=60)) for _ in range(12)]
    texts = [None, "", "same words here", "same words here", *base, *(b + " tail" for b in base), *(b.replace("ka", "KA") for b in base)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "alone in the world"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("theirs")).withColumn("least", F.lit(0))
    got = near_groups(df).collect()
    assert len(got) == len(rows)
    keyed = [(i, t) for i, t in rows if i is not None]
    roots = plain_roots([plain_print(t) for _, t in keyed], 2)
    least = {}
    for (i, _), r in zip(keyed, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, plain_print(t), least[r]) for (i, t), r in zip(keyed, roots, strict=True))
    assert sorted((r["doc_id"], unsigned(r["fingerprint"]), r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert near_groups(df.limit(0)).collect() == []
