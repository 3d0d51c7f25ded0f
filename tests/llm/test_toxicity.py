"""Toxicity: held-out accuracy on the given tables, misspellings, odd inputs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs, labels, held


@pytest.fixture(scope="module")
def model(tables):
    docs, labels, held = tables
    return toxicity.fit(docs.where(~held), labels.where(~held))


def test_held_out_accuracy(tables, model):
    docs, labels, held = tables
    rows = docs.join(labels, "doc_id").where(held).select("toxic", toxicity.score_column(F.col("text"), model).alias("score")).toPandas()
    said = rows["score"] >= 0.5
    assert (said == (rows["toxic"] == 1)).mean() > 0.97
    assert (rows["toxic"][said] == 1).mean() > 0.9
    assert said[rows["toxic"] == 1].mean() > 0.75


#: Words and beginnings of words that mark the toxic texts of the given tables.
TELLING = "stupid clown moron scum disgusting loser idiot worthless pathetic trash achlich achkeit réeux bomente boco".split()


@pytest.mark.parametrize("kind,least", [("swap", 0.6), ("drop", 0.6), ("double", 0.6)])
def test_misspelled_telling_words(tables, model, kind, least):
    docs, labels, held = tables
    draw = random.Random(3)

    def damaged(match):
        w = match.group()
        i = draw.randrange(1, len(w) - 2)
        return {"swap": w[:i] + w[i + 1] + w[i] + w[i + 2 :], "drop": w[:i] + w[i + 1 :], "double": w + w[-1]}[kind]

    texts = [r["text"] for r in docs.join(labels.where("toxic = 1"), "doc_id").where(held & F.col("text").isNotNull()).select("text").collect()]
    said = [model.score(re.sub("|".join(TELLING), damaged, t, flags=re.IGNORECASE)) >= 0.5 for t in texts]
    assert np.mean(said) >= least


def test_misspelled_words_keep_their_first_letter():
    draw = random.Random(1)
    seen = {toxicity.misspelled("idiot", draw) for _ in range(400)}
    assert seen == {"iidot", "idoit", "iiot", "idot", "iddiot", "idiiot", "idioot", "idiott"}
    assert toxicity.misspelled("a bcd ef1 !", draw) == "a bcd ef1 !"


ODD = ["", "İSTANBUL ΑΣ.Β don't a_b x1y2 ÉCOLE", " ", "🙂🙂 abcd", "abcd\nefgh ab", "some words and some words more", "!?"]


def test_many_texts_misspelled_at_once():
    one, many = random.Random(5), toxicity.as_numpy(random.Random(5))
    for _ in range(50):
        assert toxicity.all_misspelled(ODD, [toxicity.longer_words(t) for t in ODD], many) == [toxicity.misspelled(t, one) for t in ODD]


def test_bags_hash_each_word_once():
    bags = toxicity.Bags.of(ODD)
    assert len(toxicity.Bags.of(ODD * 100).bucket) == len(bags.bucket)
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), 1.0, 0.0)
    means, values = bags.means(model.weight, len(ODD)), rng.normal(0, 1, len(ODD))
    assert np.allclose(means, [model.raw(t) for t in ODD])
    assert np.isclose(bags.spread(values) @ model.weight, values @ means, rtol=1e-4)


def test_misspelling_shares_ngrams(model):
    clean = "the cat sat on a mat and looked at rain "
    assert model.raw(clean + "disgustingg ") > model.raw(clean + "umbrella ")


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "!!!"), (5, "🙂" * 9), (6, "a " * 400_000), (6, "a " * 400_000), (7, "x" * 600_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("theirs"))
    got = df.select("doc_id", toxicity.score_column(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
    assert got[0]["s"] == got[1]["s"] == got[2]["s"] == got[3]["s"] < 0.5


def test_blocks_do_not_change_a_text(model, monkeypatch):
    text = "some worthless words in a row " * 40
    whole = model.raw(text)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 64)
    assert abs(model.raw(text) - whole) < 1e-9


def test_without_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none).score("a") < 0.5
    assert toxicity.fit(docs, one).score("a") < 0.5
    assert toxicity.train([], np.array([])).score("") < 0.5


def plain_score(text, model):
    """The mean over words of the mean of their rows, n-gram by n-gram."""
    gaps = set(map(chr, range(33))) | set("\"#%&()+,-./:;<=>?[\\]^_`{|}~!")
    factors = [int(f) for f in toxicity._FACTORS]

    def weight(codes, first, order):
        h = sum(c * factors[first(j)] for j, c in enumerate(codes)) + order
        h = h * int(toxicity._MIX) % 2**64
        h ^= h >> 29
        return model.weight[(h * int(toxicity._MIX) % 2**64) >> (65 - toxicity.BUCKETS.bit_length())]

    means = []
    for word in "".join(" " if c in gaps else c for c in text.lower()).split(" "):
        if not word:
            continue
        codes = [ord(c) for c in f" {word} "]
        rows = [weight([ord(c) for c in word], lambda j: 8 + j % 56, 0)]
        for n in toxicity.ORDERS:
            rows += [weight(codes[i : i + n], lambda j: j, n) for i in range(len(codes) - n + 1)]
        means.append(sum(rows) / len(rows))
    z = model.scale * (sum(means) / len(means) if means else 0.0) + model.shift
    return 1 / (1 + math.exp(-min(40, max(-40, z))))


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.where(rng.random(toxicity.BUCKETS) < 0.5, rng.normal(0, 3, toxicity.BUCKETS), 0.0), 1.5, -0.3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60)
    odd = spark.createDataFrame([(None,), ("",), (" !? ",), ("a",), ("Ünï çode 🙂🙂",), ("x" * 200,), ("don't a_b",)], "text string")
    for r in docs.unionByName(odd).select("text", toxicity.score_column(F.col("text"), model).alias("s")).collect():
        assert abs(r["s"] - plain_score(r["text"] or "", model)) < 1e-6, r["text"]
