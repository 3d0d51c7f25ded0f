"""Spelling variants: words one edit apart, by variable-length grams.

A dictionary of grams holds, beyond the shortest length, the longer grams that
begin with a frequent one; rare ones are pruned.  A word, padded at both ends,
falls into the longest dictionary grams at its places, without those that lie
within another.  For every place at which one edit may happen, the grams that it
can change are counted; all others, at least ``bound`` of them, stay in any word
that is one edit away: the first few and the last few, with all that stands before
or behind them.  So for each split of the bound into first and last grams a word is
listed under what they cover, and words that meet in a list are verified.  No near
word is lost, and lists hold words that differ in a short window alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Lengths of grams; a gram of over this share of all words is frequent and made
#: longer; longer grams in under this share are pruned.
SHORT, LONG, FREQUENT, RARE = 3, 5, 1 / 500, 1 / 5000
#: Grams by which a word is listed, at most: a smaller bound holds as well, and very
#: long words need no more.
MOST = 16
#: Stand before and behind a word, ``SHORT - 1`` times; no part of any word.
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def padded(word: Column, short: int = SHORT) -> Column:
    return F.concat(F.lit(START * (short - 1)), word, F.lit(END * (short - 1)))


def gram_dictionary(words: DataFrame, *, short: int = SHORT, long: int = LONG, frequent: float = FREQUENT, rare: float = RARE) -> frozenset[str]:
    """Grams of over ``short`` characters that words are cut into; all of
    ``short`` are known.  ``words``: distinct ``word``.

    A gram of each length is made from a frequent gram one shorter, and kept if it
    is in a share of ``rare`` of the words or more.  There are at most (mean length
    of a word, pads included) / ``rare`` of a length, whatever the number of words.
    """
    total = words.count()
    kept: set[str] = set()
    open_: DataFrame | None = None
    for q in range(short, long + 1):
        body = padded(F.col("word"), short)
        places = F.sequence(F.lit(1), F.length(body) - q + 1)
        grams = words.where(F.length(body) >= q).select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(body, i, F.lit(q))))).alias("g"))
        if open_ is not None:
            grams = grams.join(open_.select(F.col("g").alias("begin")), F.left("g", F.lit(q - 1)) == F.col("begin"), "left_semi")
        counted = settle(grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rare * total), "variants-grams")
        if q > short:
            kept |= {r["g"] for r in counted.select("g").toLocalIterator()}
        open_ = counted.where(F.col("n") > frequent * total)
    return frozenset(kept)


def decompose(body: str, grams: frozenset[str], short: int, long: int) -> list[tuple[int, int]]:
    """(first, last) place of the grams of a padded word, in order."""
    out: list[tuple[int, int]] = []
    for p in range(len(body) - short + 1):
        size = short
        for q in range(min(long, len(body) - p), short, -1):
            if body[p : p + q] in grams:
                size = q
                break
        if not out or p + size - 1 > out[-1][1]:
            out.append((p, p + size - 1))
    return out


def unaffected(body: str, cut: list[tuple[int, int]], begins: frozenset[str], ends: frozenset[str], short: int, long: int) -> int:
    """A lower bound on the grams that no single edit of the word changes.

    An edit changes the grams over its place.  It may also make a longer gram that
    covers one before it, if what stands up to the edit begins a dictionary gram,
    or one behind it, if what stands from the edit on ends one.
    """
    n, pad = len(body), short - 1
    starts, lasts = [p for p, _ in cut], [e for _, e in cut]
    before, behind = [0] * (n + 1), [0] * (n + 2)
    i = 0
    for x in range(n + 1):  # grams that end before x, but for those that a gram over x could cover
        while i < len(lasts) and lasts[i] < x:
            i += 1
        reach = next((p for p in range(max(0, x - long + 1), x - short + 1) if body[p:x] in begins), n)
        k = i
        while k and starts[k - 1] >= reach:
            k -= 1
        before[x] = k
    i = len(starts)
    for y in range(n, -1, -1):  # grams that start at y or later
        while i and starts[i - 1] >= y:
            i -= 1
        reach = next((e for e in range(min(n, y + long - 1), y + short - 1, -1) if body[y:e] in ends), -1) - 1
        k = i
        while k < len(lasts) and lasts[k] <= reach:
            k += 1
        behind[y] = len(starts) - k
    edits = [before[i] + behind[i + 1] for i in range(pad, n - pad)]
    return min([*edits, *(before[g] + behind[g] for g in range(pad, n - pad + 1))])


def cut_column(word: Column, grams: frozenset[str], short: int, long: int) -> Column:
    """struct(bound, heads: length up to the end of each gram, tails: length from
    the start of each gram), lengths without pads."""
    begins = frozenset(g[:k] for g in grams for k in range(short, len(g)))
    ends = frozenset(g[-k:] for g in grams for k in range(short, len(g)))

    @F.arrow_udf("struct<bound: int, heads: array<int>, tails: array<int>>")
    def run(words: pa.Array) -> pa.Array:
        bounds, heads, tails = [], [], []
        for w in words.to_pylist():
            body = START * (short - 1) + w + END * (short - 1)
            cut = decompose(body, grams, short, long)
            bounds.append(min(MOST, unaffected(body, cut, begins, ends, short, long)))
            heads.append([min(max(0, e + 2 - short), len(w)) for _, e in cut])
            tails.append([min(max(0, len(body) - p - short + 1), len(w)) for p, _ in cut])
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(bounds, pa.int32()), pa.array(heads, kind), pa.array(tails, kind)], ["bound", "heads", "tails"])

    return run(word)


def near_words(words: DataFrame, *, short: int = SHORT, long: int = LONG, frequent: float = FREQUENT, rare: float = RARE) -> DataFrame:
    """(``a``, ``b``): every two of the distinct ``word`` that differ by exactly one
    inserted, deleted or replaced code point, each pair once, ``a`` before ``b``.

    Two words meet in the lists of the larger of their bounds.  Words whose bound
    is zero (short ones, or of frequent grams throughout) may share no gram with one
    another; they alone are met by their forms with one character left out.
    """
    grams = gram_dictionary(words.select("word"), short=short, long=long, frequent=frequent, rare=rare)
    cut = settle(words.select("word", F.length("word").alias("n"), cut_column(F.col("word"), grams, short, long).alias("c")).select("word", "n", "c.*"), "variants-cut")
    # A word is listed under its own bound and the larger ones of words about as long.
    most = cut.groupBy("n").agg(F.collect_set("bound").alias("own"))
    around = most.select(F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("n"), F.explode("own").alias("t")).groupBy("n").agg(F.collect_set("t").alias("bounds"))
    # A row for each length: written, so that Spark sees how small it is and does not
    # shuffle the words by their length.
    around = settle(around, "variants-bounds")
    usable = F.filter("bounds", lambda t: (t >= 1) & (t >= F.col("bound")) & (t <= F.size("heads")))
    listed = cut.join(around, "n").select("word", "n", "bound", "heads", "tails", F.explode(usable).alias("t"))
    first, last = F.col("a"), F.col("t") - F.col("a")
    head = F.when(first > 0, F.left("word", F.get("heads", first - 1))).otherwise("")
    tail = F.when(last > 0, F.right("word", F.get("tails", F.size("heads") - last))).otherwise("")
    keyed = listed.withColumn("a", F.explode(F.sequence(F.lit(0), "t"))).select("word", "n", (F.col("bound") == F.col("t")).alias("own"), F.xxhash64("t", "a", head, tail).alias("key"))
    left, right = keyed.toDF("a", "na", "owna", "key"), keyed.toDF("b", "nb", "ownb", "key2")
    may = (F.col("a") < F.col("b")) & (F.col("owna") | F.col("ownb")) & (F.abs(F.col("na") - F.col("nb")) <= 1)
    # Lists are much larger than the files that they come from: never broadcast.
    met = left.join(right.hint("merge"), (F.col("key") == F.col("key2")) & may).select("a", "b")
    free = cut.where("bound < 1").select("word", F.explode(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat(F.left("word", i - 1), F.substring("word", i + 1, F.length("word")))))).alias("form")).distinct()
    rest = free.toDF("a", "form").join(free.toDF("b", "form").hint("merge"), "form").where("a < b").select("a", "b")
    return met.unionByName(rest).where(F.levenshtein("a", "b", 1) == 1).distinct()


def damaged_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(``word``, ``n``): the words of all texts, counted, that have ``least`` code
    points or more and occur twice or more.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case.  Of a run for which
    ``every`` divides the crc32 of ``<key>:<run>`` one code point is left out, at
    that number modulo the run's length.  Null texts have no words; a null key is
    empty text.
    """
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "k").withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    left_out = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, left_out).otherwise(F.col("run"))
    return low.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def spelling_variants(words: DataFrame, *, times: int = 10, **lengths) -> DataFrame:
    """(``word``, ``n``, ``form``, ``root``, ``n_near``, ``form_n``) of distinct
    words (``word``, ``n``: how often, 1 or more).

    ``n_near``: words one edit away, as ``near_words`` finds them.  ``form``: that
    of them with the largest ``n`` (ties: smallest in code-point order), if it
    occurs ``times`` as often as the word; else null.  ``root``: the last of the
    word's forms.  No words give no rows.
    """
    words = settle(words.select("word", "n"), "variants-words")
    pairs = near_words(words, **lengths)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), "b")).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.less") >= F.col("n") * times
    formed = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.b")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "variants-forms")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    # A form occurs ``times`` as often, so chains are short; each round doubles what is known of them.
    top = formed.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(top, times) + 1)) if times > 1 else 0):
        roots = settle(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")
    return formed.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
