"""Personal data: base patterns against the plain regular expressions, the trees
on held-out lines, redaction, odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        odd = d[-1::-2]
        even = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 13 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_against_brute_force():
    rng = random.Random(8)
    parts = ["a", "@", ".", "_", "-", "b.c", "1", "25", "256", "10.0.0.1", "4111111111111111", " ", "+1", "(017) 555-7713", "é", "%", "4111 1111-1111 1111", "٣", "\n", "+"]
    for text in ["", "a@b.c_x@y.z", "a@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8", "1.2.3.999.1.2.3.4", "+1 (017) 555-7713", "000001.2.3.4"]:
        assert pii.base_spans(text) == plain(text), text
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_trees_on_other_lines(model):
    x, y = pii.examples(2000, 77)
    said = model.probability(x) >= np.array([model.threshold[pii.KINDS[int(k)]] for k in x[:, 0]])
    assert y[said].mean() > 0.95 and said[y == 1].mean() > 0.95


def test_spans_by_the_trees(model):
    kinds = lambda t: [k for k, _, _ in pii.find_spans(t, model)]
    assert kinds('my token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here') == ["secret"]
    assert kinds("please call (017) 555-7713 today") == ["number"]
    assert kinds("plain words only, chapter 12, pages 1990-1999") == []
    spans = pii.find_spans("a.b@c.de and a.b@c.de", model)
    assert spans == [("email", 0, 8), ("email", 13, 21)]


def test_redaction(model):
    text = "mail a.b@c.de or +1 (017) 555-7713 now"
    assert pii.redact_text(text, pii.find_spans(text, model)) == "mail [EMAIL] or [PHONE] now"
    assert pii.redact_text("abcdef", [("x", 1, 4), ("y", 2, 5)]) == "a[X]f"


def test_table_with_nulls_and_repeats(spark, model):
    rows = [(1, None), (1, None), (2, ""), (3, "1" * 200_000), (4, "@" * 5000), (5, "x a@b.co " * 3000), (None, "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("theirs"))
    got = df.select("doc_id", pii.spans_column(F.col("text"), model).alias("s"), pii.redact_column(F.col("text"), model).alias("r")).collect()
    assert [len(r["s"]) for r in got] == [0, 0, 0, 0, 0, 3000, 1]
    assert got[0]["r"] is None and got[2]["r"] == "" and got[6]["r"] == "[EMAIL]"
    assert df.limit(0).select(pii.spans_column(F.col("text"), model)).collect() == []
