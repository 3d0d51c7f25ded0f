"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from folioguard.llm import variants as v

SCHEMA = "word string, n long"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts, times=10):
    words = sorted(counts)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (counts[w], form[w], root(w), len(near[w]), counts[form[w]] if form[w] else None) for w in words}


def damaged(docs, least=7):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def vocabulary(seed, alphabet, sizes, n):
    """Random words and, of many of them, words one or two edits away."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        for _ in range(rng.choice([1, 2])):
            i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.add(w)
    return {w: rng.choice([1, 2, 3, 25, 300, 4000]) for w in sorted(words) if w}


@pytest.mark.parametrize(
    ("seed", "alphabet", "sizes", "frequent", "rare"),
    [(1, "ab", (7, 8, 9), 1 / 50, 1 / 500), (2, "abcdé", (7, 8, 12), 1 / 100, 1 / 1000), (3, "ab", (1, 2, 3, 4), 0.0, 0.0), (4, "abc", (7, 9, 20), 0.0, 0.0), (5, "xyzäöü", (3, 7, 10), 1.0, 1.0)],
)
def test_variants_against_all_pairs(spark, seed, alphabet, sizes, frequent, rare):
    counts = vocabulary(seed, alphabet, sizes, 400)
    df = spark.createDataFrame(sorted(counts.items()), SCHEMA)
    assert got(v.spelling_variants(df, frequent=frequent, rare=rare)) == plain(counts)


def test_the_bound_holds_for_every_single_edit():
    """Grams that no edit changes stay the first and the last of the other word."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abc") for _ in range(k)) for k in (4, 5) for _ in range(60)]
    grams = frozenset(g for g in pool)
    begins, ends = frozenset(g[:k] for g in grams for k in range(3, len(g))), frozenset(g[-k:] for g in grams for k in range(3, len(g)))
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.choice([4, 7, 10])))
        body = "\x02\x02" + w + "\x03\x03"
        mine = v.decompose(body, grams, 3, 5)
        bound = v.unaffected(body, mine, begins, ends, 3, 5)
        for i in range(len(w) + 1):
            for other in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in "abc"), *(w[:i] + c + w[i + 1 :] for c in "abc")} - {w}:
                b2 = "\x02\x02" + other + "\x03\x03"
                a, b = [body[p : e + 1] for p, e in mine], [b2[p : e + 1] for p, e in v.decompose(b2, grams, 3, 5)]
                first = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                last = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
                assert min(first + last, len(a), len(b)) >= bound


def test_whole_query_on_texts(spark):
    rng = random.Random(4)
    base = ["ciónquebo", "erheaeon", "Thheorou", "Größenwahn", "überraschend", "Straßenbahn", "éaêonment", "×÷×÷×÷×", "ABCDEFG"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "", "s", "."]) for _ in range(rng.choice([0, 3, 200])))) for i in range(300)]
    docs += [(None, "ciónquebo " * 40), (7, None), (8, ""), (8, ""), (-3, "x" * 50_000 + " " + "x" * 50_000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in docs], "doc_id long, text string, word string")
    counts = damaged(docs)
    assert len(counts) > 40 and got(v.spelling_variants(v.damaged_words(df))) == plain(counts)
    assert any(form for _, form, *_ in plain(counts).values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert v.spelling_variants(v.damaged_words(empty)).collect() == []
