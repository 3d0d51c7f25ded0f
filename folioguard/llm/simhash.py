"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most ``k`` bits, cut into ``k // 2 + 1``
segments, have a segment in which they differ by one bit at most.  So every
fingerprint is indexed under each segment with each of its bits deleted in turn;
equal keys meet in a join, which checks the whole distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components

BITS = 64
SEED = 42
#: Segment values that more fingerprints than this share are indexed a level deeper.
CROWDED = 1024
#: Words that are hashed at once, so that very long texts need no more memory.
BLOCK_WORDS = 1 << 16

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, with A-Z in lower case."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES)
    return [w for w in raw.split(b" ") if w]


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles; all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of ``text`` as a signed 64-bit number; no words give zero."""
    words = words_of(text)
    ones, total = np.zeros(BITS, np.int64), 0
    for at in range(0, max(len(words) - width + 1, 1), BLOCK_WORDS):
        h = shingle_hashes(words[at : at + BLOCK_WORDS + width - 1], width)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """:func:`fingerprint` of every text as a long; a null text has no words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return run(text)


def _mask(bits) -> int:
    """A signed 64-bit mask of the given bit numbers."""
    m = sum(1 << i for i in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _cut(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` dealt to ``n`` segments of nearly equal length."""
    ends = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _variants(segment: list[int]) -> list[tuple[int, int, bool]]:
    """(bits that must agree, deleted bit, whether it speaks for equal segments
    too) for each one-wildcard variant: two segments that differ in one bit meet
    under that bit alone, two equal ones are counted under the first."""
    return [(_mask(b for b in segment if b != bit), _mask([bit]), bit == segment[0]) for bit in segment]


def _keyed(prints: DataFrame, table: list[tuple]) -> DataFrame:
    """``prints`` under the key of each variant in ``table``."""
    options = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(keep).cast("long").alias("keep")) for n, (keep, _) in enumerate(table)])
    return prints.select("fp", F.explode(options).alias("o")).select(F.col("o.kind").alias("kind"), F.col("fp").bitwiseAND(F.col("o.keep")).alias("key"), "fp")


def _matched(prints: DataFrame, table: list[tuple], max_bits: int) -> DataFrame:
    """Links of fingerprints that meet under a key of ``table``, whose entries
    are (bits that must agree, [(deleted bit, speaks for equal), ...])."""
    keys = _keyed(prints, table)
    x = F.col("a").bitwiseXOR(F.col("b"))
    holds = (F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits)
    for deleted in zip(*[w for _, w in table], strict=True):
        bits = F.array(*[F.lit(bit).cast("long") for bit, _ in deleted])
        equal = F.array(*[F.lit(first) for _, first in deleted])
        at = F.col("kind") + 1
        holds &= (F.element_at(bits, at).bitwiseAND(x) != 0) | F.element_at(equal, at)
    left, right = keys.withColumnRenamed("fp", "a"), keys.withColumnRenamed("fp", "b")
    # Spark takes the many keys of a small table for small: they are never broadcast.
    return left.join(right.hint("merge"), ["kind", "key"]).where(holds).select("a", "b")


def signature_links(prints: DataFrame, *, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(``a``, ``b``) of all pairs of distinct fingerprints, ``a < b``, that
    differ in at most ``max_bits`` bits, each once.

    ``prints``: a column ``fp`` (long) without repeats or nulls.  Where more than
    ``crowded`` fingerprints share the value of a segment, they and all within a
    bit of that value are indexed by two wildcards, one in that segment and one
    in a segment of the remaining bits.  That finds every link as well, and what
    meets under a key is bounded by the bits that both segments leave open.
    """
    n = max_bits // 2 + 1
    segments = _cut(list(range(BITS)), n)
    flat = [[(keep, [(bit, first)]) for keep, bit, first in _variants(seg)] for seg in segments]
    values = [F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_mask(seg)).cast("long")).alias("v")) for i, seg in enumerate(segments)]
    cut = prints.select("fp", F.explode(F.array(*values)).alias("s")).select("fp", "s.seg", "s.v")
    hot = settle(cut.groupBy("seg", "v").count().where(F.col("count") > crowded).select("seg", "v"), "simhash-crowded")
    if hot.isEmpty():
        return _matched(prints, [x for rows in flat for x in rows], max_bits).distinct()

    near = hot
    for i, seg in enumerate(segments):
        flips = F.explode(F.array(*[F.lit(_mask([bit])).cast("long") for bit in seg]))
        near = near.unionByName(hot.where(F.col("seg") == i).select("seg", "v", flips.alias("f")).select("seg", F.col("v").bitwiseXOR(F.col("f")).alias("v")))
    near = settle(near.distinct(), "simhash-near")
    found = []
    for i, seg in enumerate(segments):
        own = cut.where(F.col("seg") == i)
        found.append(_matched(own.join(hot, ["seg", "v"], "left_anti").select("fp"), flat[i], max_bits))
        deep = [
            (_mask(seg) & ~bit | keep, [(bit, first), (other, second)])
            for _, bit, first in _variants(seg)
            for rest in _cut([b for b in range(BITS) if b not in seg], n)
            for keep, other, second in _variants(rest)
        ]
        found.append(_matched(own.join(near, ["seg", "v"], "left_semi").select("fp"), deep, max_bits))
    out = found[0]
    for links in found[1:]:
        out = out.unionByName(links)
    return out.distinct()


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(``key``, ``fingerprint`` as long, ``component_id``) for every row.

    Rows link where fingerprints of ``width``-word shingles differ in at most
    ``max_bits`` bits; ``component_id`` is the smallest key that links lead to,
    its own included.  Only distinct fingerprints are compared, so exact copies
    cost one comparison, and no pairs within a group are listed.

    Null or empty texts have fingerprint zero and link like any other.  Null
    keys never are a component's id unless it has no other.  Repeated rows stay.
    """
    rows = settle(docs.select(F.col(f"`{key}`"), fingerprints(F.col(f"`{text}`"), width).alias("fingerprint")), "simhash")
    least = settle(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(f"`{key}`").alias("least")), "simhash-prints")
    links = signature_links(least.select("fp"), max_bits=max_bits, crowded=crowded)
    groups = settle(components(links), "simhash-groups")
    named = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(named, "fingerprint").select(F.col(f"`{key}`"), "fingerprint", "component_id")
