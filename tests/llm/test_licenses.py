"""License scans against a plain search over word lists."""

import random
import re

from pyspark.sql import functions as F

from folioguard.llm.licenses import PHRASES, TEMPLATES, Automaton, scan, scan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def check(text):
    got = scan_text(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain(text), repr(text)


def test_base_against_brute_force():
    rng = random.Random(4)
    parts = ["MIT", "License", "cc", "by", "Apache", "GNU General Public License", ".", " ", "\n", "é", "x", "cc by", "0", "ÀB"]
    for text in [None, "", " ", "...", "mit license", "MIT-License mit license", "cc by cc by", "\x7fcc\x00by"]:
        check(text)
    for _ in range(500):
        check(rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 30))))


def test_templates_take_their_own_regions():
    a = Automaton("start <<beginOptional>>maybe so<<endOptional>> then <<var;name=x;words=1..2>> end")
    run = lambda t: a.matches(iter(t.encode().split()))
    assert run("start then a end") == [(0, 4)]
    assert run("x start maybe so then a b end y") == [(1, 8)]
    assert run("start maybe then a end") == [] and run("start then end") == [] and run("start then a b c end") == []
    assert run("start then a end start then b end") == [(0, 4), (4, 8)]


def test_known_notices_and_changed_wording():
    labels = lambda t: {m["label"] for m in scan_text(t)["matches"]}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-notice"}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0-notice"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-notice"}
    assert labels("Released under the MIT License.") == {"mit-notice"}
    mit = re.sub(r"<<[^>]*Optional>>", " ", TEMPLATES["mit-text"]).replace("<<var;name=holder;words=1..12>>", "the authors or copyright holders")
    assert "mit-text" in labels("Copyright 2020 Somebody\n" + mit)
    assert "mit-text" not in labels(mit.replace("free of charge", "for a fee"))


def test_table_with_nulls_and_repeats(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "cc by " * 50_000), (4, "mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1))
    got = [r["s"] for r in df.select("doc_id", scan(F.col("text")).alias("s")).collect()]
    assert [g["n_words"] for g in got] == [0, 0, 0, 100_000, 2]
    assert got[3]["n_base"] == 50_000 and got[3]["last_word"] == 99_998 and got[0]["first_word"] is None
    assert df.limit(0).select(scan(F.col("text"))).collect() == []
