"""Fingerprints against plain sets of shingles."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioguard.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def shingles(text, width=5):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]

    def chained(part):
        h = 42
        for w in part:
            h = xxhash.xxh64_intdigest(w, h)
        return h - (1 << 64) if h >= 1 << 63 else h

    if not words:
        return set()
    return {chained(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_sketch(text, size=128, width=5):
    return sorted(shingles(text, width))[:size]


def plain_near(a, b, size=128):
    u = sorted(set(a) | set(b))[:size]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def shown(sketch):
    return "".join(f"{h & (2**64 - 1):016x}" for h in sketch)


def digest(key, text):
    return hashlib.md5((("" if key is None else f"={key}") + "\x00" + (text or "")).encode()).digest()


def plain(docs):
    rows = sorted(((k is not None, k or 0, digest(k, t), t or "") for k, t in docs))
    out = []
    for i, (there, k, _, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][3]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        out.append((k if there else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), plain_near(a, b), plain_near(a, c)))
    return out


def prose(rng, n):
    return "".join(rng.choice(["wort", "die", "é", "straße", "x" * 30, "🙂"]) + rng.choice([" ", "  ", "\n", "\t \r\n"]) for _ in range(n))


@pytest.mark.parametrize("part", [7, 64, 1000, 1 << 16])
def test_sketches_read_in_parts(spark, part):
    rng = random.Random(part)
    texts = [None, "", " \n ", "one", "a b c d", "a b c d e", " a b c d e f ", "y" * 300, *[prose(rng, n) for n in (1, 4, 5, 6, 40, 300, 900)]]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r[0]: r[1] for r in df.select("doc_id", fp.sketch(F.col("text"), part=part)).collect()}
    assert got == {i: plain_sketch(t) for i, t in enumerate(texts)}
    small = {r[0]: r[1] for r in df.select("doc_id", fp.sketch(F.col("text"), part=part, width=2, size=4)).collect()}
    assert small == {i: plain_sketch(t, 4, 2) for i, t in enumerate(texts)}


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(3)
    sets = [{rng.getrandbits(63) - (1 << 62) * rng.choice([0, 1]) for _ in range(n)} for n in (0, 5, 60, 5000)]
    sets.append(set(rng.sample(sorted(sets[3]), 2500)) | {rng.getrandbits(62) for _ in range(500)})
    rows = [(i, j, sorted(sets[i])[:128], sorted(sets[j])[:128]) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("i", "j", fp.merged(a, b).alias("m"), fp.resemblance(a, b).alias("r"), fp.containment(a, b).alias("c"), fp.distinct_shingles(a).alias("n")).collect():
        x, y = sets[r["i"]], sets[r["j"]]
        assert r["m"] == sorted(x | y)[:128]
        assert abs(r["r"] - (len(x & y) / len(x | y) if x | y else 1)) < 0.12 and 0 <= r["c"] <= 1
        assert abs(r["c"] - (len(x & y) / len(x) if x else 1)) < 0.25
        # Hashes are drawn from half of all numbers here, so only sets known exactly are counted.
        assert len(x) >= 128 or r["n"] == len(x)
        assert r["i"] != r["j"] or r["r"] == 1


def test_distinct_shingles_of_a_long_text(spark):
    text = " ".join(str(i % 7000) for i in range(20_000))
    n = spark.createDataFrame([(1, text)], SCHEMA).select(fp.distinct_shingles(fp.sketch(F.col("text")))).first()[0]
    assert abs(n - 7000) < 0.25 * 7000


def test_sketches_merge_over_rows(spark):
    rng = random.Random(5)
    texts = [(rng.choice([1, 1, 1, 2, None]), prose(rng, 60) if rng.random() < 0.9 else "") for _ in range(300)] + [(3, ""), (3, None)]
    df = spark.createDataFrame(texts, SCHEMA).select("doc_id", F.lit("clash").alias("size"), fp.sketch(F.col("text")).alias("s"))
    got = {r["doc_id"]: r["s"] for r in fp.merged_by(df, ["doc_id"], "s").collect()}
    want = {k: sorted(set().union(*[shingles(t) for d, t in texts if d == k]))[:128] for k in (1, 2, 3, None)}
    assert got == want


def rows_of(df):
    made = df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), fp.as_text(F.col("sketch")), fp.as_text(F.col("edited_sketch")), fp.resemblance(F.col("sketch"), F.col("edited_sketch")), fp.resemblance(F.col("sketch"), F.col("next_sketch"))
    )
    return sorted(repr(tuple(r)) for r in made.collect())


def test_edited_texts_with_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN", 4)
    rng = random.Random(8)
    docs = [(rng.choice([None, 3, 3, rng.randrange(-50, 50)]), rng.choice([None, "", "kurz", prose(rng, rng.choice([3, 40, 200]))])) for _ in range(80)]
    docs += [(3, "gleich und oft " * 3)] * 30 + [(9, "🙂é" * 5), (10, "a"), (11, "")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], SCHEMA + ", edited string, n long")
    assert rows_of(fp.edited_fingerprints(df)) == sorted(map(repr, plain(docs)))


def test_one_row_follows_itself_and_no_rows_give_none(spark):
    one = [(5, "eins zwei drei vier fünf sechs")]
    assert rows_of(fp.edited_fingerprints(spark.createDataFrame(one, SCHEMA))) == list(map(repr, plain(one)))
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
