"""Document fingerprints: bottom-k sketches of shingle hashes, on DataFrame
functions alone.

A sketch is the sorted array of the smallest ``size`` distinct hashes of a text's
shingles.  The sketch of a whole is the sketch of the union of its parts' sketches,
so texts are read part by part, and sketches of rows merge.  Two sketches estimate
the resemblance of their sets, the containment of one in the other and the number
of distinct shingles of each.  Sets of under ``size`` shingles are known exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

#: Words of a shingle, hashes of a sketch, and characters of a text that are cut
#: into words at once.
WIDTH, SIZE, PART = 5, 128, 1 << 16
SPACES = r"[\x20\x09-\x0D]+"
SKETCH = "array<bigint>"
#: Equal rows are spread out again in runs of this many.
RUN = 1 << 16


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _least(hashes: Column, size: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def sketch(text: Column, *, width: int = WIDTH, size: int = SIZE, part: int = PART) -> Column:
    """The sketch of ``text``: XXH64 (seed 42, chained over the words, signed) of
    its shingles of ``width`` words ``[^\\x20\\x09-\\x0D]+``.

    A text of fewer words has one shingle, all of them; one without words, and a
    null, has the empty sketch.  Repeated shingles count once.  Texts of any
    length are read ``part`` characters at a time; between parts go the sketch and
    the last ``width`` words, of which the last may go on in the next part.
    """

    def of(body: Column) -> Column:
        last = F.greatest(F.lit(1), F.ceil(F.length(body) / F.lit(part))).cast("int") - 1
        none = F.struct(F.array().cast(SKETCH).alias("kept"), F.lit("").alias("tail"))

        def step(state: Column, i: Column) -> Column:
            chunk = F.concat(state["tail"], F.substring(body, i * part + 1, F.lit(part)))
            return _bound(chunk, lambda c: _bound(F.filter(F.split(c, SPACES), lambda w: w != ""), lambda words: cut(state, i, c, words)))

        def cut(state: Column, i: Column, chunk: Column, words: Column) -> Column:
            done = F.size(words) - F.when(i < last, 1).otherwise(0)  # the last word of a part may go on
            shingles = F.transform(F.sequence(F.lit(1), done - width + 1), lambda at: F.xxhash64(F.slice(words, at, F.lit(width))))
            short = F.when((i == last) & (done > 0), F.array(F.xxhash64(words))).otherwise(F.array().cast(SKETCH))
            kept = _least(F.concat(state["kept"], F.when(done >= width, shingles).otherwise(short)), size)
            tail = F.concat(F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - width + 1), F.lit(width)), " "), F.when(chunk.rlike(r"[\x20\x09-\x0D]$"), " ").otherwise(""))
            return F.struct(kept.alias("kept"), F.when(i < last, tail).otherwise("").alias("tail"))

        return F.aggregate(F.sequence(F.lit(0), last), none, step, lambda state: state["kept"])

    return _bound(F.coalesce(text, F.lit("")), of)


def merged(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return _least(F.concat(a, b), size)


def merged_by(df: DataFrame, keys: list[str], column: str, *, size: int = SIZE) -> DataFrame:
    """(``keys``, ``column``): the sketch of the union over all rows of each key.

    A key may hold any share of the rows: each task passes on at most ``size``
    hashes of a key.  Null sketches count as empty; a key whose sketches are all
    empty has the empty sketch; null keys are one key.
    """
    names = [F.col(f"`{k}`") for k in keys]
    hashes = df.select(*names, F.explode_outer(F.col(f"`{column}`")).alias("__h"))
    ranked = hashes.withColumn("__r", F.dense_rank().over(W.partitionBy(*names).orderBy(F.col("__h").asc_nulls_last()))).where(F.col("__r") <= size)
    return ranked.groupBy(*names).agg(F.sort_array(F.collect_set("__h")).alias(column))


def resemblance(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """The estimated Jaccard similarity of two sets, 0 to 1: the share of the
    ``size`` smallest hashes of both that are in both.  1 for two empty sets."""
    smallest = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    share = _bound(smallest, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u).cast("double"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def distinct_shingles(a: Column, *, size: int = SIZE) -> Column:
    """The estimated number of distinct shingles; exact under ``size``."""
    spread = F.element_at(a, -1).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(float(size - 1)) / spread)


def containment(a: Column, b: Column, *, size: int = SIZE) -> Column:
    """The estimated share of the first set that is in the second, 0 to 1; 1 where
    the first is empty."""
    na, nb, j = distinct_shingles(a, size=size), distinct_shingles(b, size=size), resemblance(a, b, size=size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (j + 1) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, smallest first."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def followers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``id``: digest of key and text, ``key``, ``next``: the ``id`` of the next
    row by ascending key, ``n``: code points, ``times``: rows that this stands
    for).  After the last row comes the first; one row follows itself.

    Null keys come first; rows of one key are in the order of ``id``.  Of rows
    equal in both, all but one are followed by themselves.  The order is built on
    these narrow rows, in ranges; only the first rows of ranges meet in one task.
    """
    narrow = docs.select(F.col(f"`{key}`").alias("key"), row_id(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("id"), F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n"))
    counted = narrow.groupBy("key", "id", "n").agg(F.count(F.lit(1)).alias("times"))
    ranged = settle(counted.repartitionByRange("key", "id").withColumn("part", F.spark_partition_id()), "fingerprints-order")
    firsts = ranged.groupBy("part").agg(F.min_by("id", F.struct("key", "id")).alias("first"))
    ring = firsts.agg(F.sort_array(F.collect_list(F.struct("part", "first"))).alias("r"))
    ring = ring.select(F.inline(F.transform("r", lambda x, i: F.struct(x["part"].alias("part"), F.get("r", (i + 1) % F.size("r"))["first"].alias("beyond")))))
    after = F.lead("id").over(W.partitionBy("part").orderBy("key", "id"))
    rows = ranged.withColumn("after", after).join(ring, "part").withColumn("next", F.coalesce("after", "beyond"))
    one = rows.select("id", "key", "next", "n", F.lit(1).cast("long").alias("times"))
    return one.unionByName(rows.where("times > 1").select("id", "key", F.col("id").alias("next"), "n", (F.col("times") - 1).alias("times")))


def row_id(key: Column, text: Column) -> Column:
    known = F.concat(F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key.cast("string"))), F.lit("\x00"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(known.cast("binary")))


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """(``key``, ``n_chars``, ``edited``, ``sketch``, ``edited_sketch``,
    ``next_sketch``) for each row of ``docs``.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points
    replaced by the first as many (or all) of the next row's text, as ``followers``
    orders them.  Null texts count as empty; the edited text of an empty one is
    empty.  Rows that repeat are computed once and spread out again.  Texts are
    shuffled once by their id, and halves of them once more, with sketches.  Other columns are
    left out.  An empty table gives an empty table.
    """
    links = settle(followers(docs, key, text), "fingerprints-next")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Both joins read one shuffle of this, of the same columns.  Each makes sketches
    # behind it, which costs time but keeps their bytes out of it.
    texts = docs.select(row_id(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("id"), body.alias("body")).dropDuplicates(["id"])
    asked = links.select(F.col("id").alias("of"), "key", "n", "times", "next")
    half = F.floor(F.col("n") / 2).cast("int")
    heads = texts.join(asked, F.col("id") == F.col("next")).select("of", "key", "n", "times", F.left("body", half).alias("head"), sketch(F.col("body"), width=width, size=size).alias("next_sketch"))
    both = texts.join(heads, F.col("id") == F.col("of"))
    edited = both.select("key", F.col("n").alias("n_chars"), F.concat(F.left("body", F.col("n").cast("int") - half), "head").alias("edited"), "body", "next_sketch", "times")
    made = edited.select("key", "n_chars", "edited", sketch(F.col("body"), width=width, size=size).alias("sketch"), sketch(F.col("edited"), width=width, size=size).alias("edited_sketch"), "next_sketch", "times")
    runs = made.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))))
    spread = runs.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("times") - F.col("__at")).cast("int"))))
    return spread.select(F.col("key").alias(key), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
