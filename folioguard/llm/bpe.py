"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut, wherever that may be, into pieces that tasks encode in
parallel.  The pieces are put together again in a tree, by encoding a window around
each join anew, and a larger one until the window's outer tokens are those of both
sides.

A window in running text begins and ends between a character and a white space
behind it.  The tokenizer splits there whatever else the text says, so what lies
outside keeps its tokens.  In a stretch that the tokenizer does not split there is
no such place; but there a token row is the encoding of its text exactly if all its
neighbouring pairs are, so agreement at both ends proves the whole join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Fixed value: the split pattern of the tokenizer file's ByteLevel step.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters than this are cut into pieces of this many at most.
LONG = 1 << 15
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 8
#: How a piece goes on with the one before it.
APART, STRETCH, TEXT = 0, 1, 2
#: Bytes in which a white space may end.
WHITE = frozenset(b"".join(chr(i).encode()[-1:] for i in range(0x3001) if chr(i).isspace()))

_SPLIT = regex.compile(PATTERN)
_EDGE = re.compile(r"\S(?=[ \t\n\r])")


class Bpe:
    """A byte-level BPE tokenizer file, for use inside tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        ranks = {bytes(shown[c] for c in token): i for token, i in stated["model"]["vocab"].items() if token not in self.special}
        self.tokens = {i: token for token, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def decode(self, ids) -> str:
        """The text of ``ids``; ids without a token are left out, and bytes that
        are no UTF-8 become U+FFFD."""
        return b"".join([self.tokens.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def decodes_to(self, ids: np.ndarray, digest: str) -> bool:
        """Whether the text of ``ids`` has this SHA-256 (lowercase hex, UTF-8)."""
        return hashlib.sha256(self.decode(ids.tolist()).encode()).hexdigest() == digest

    def _halves(self, stretch: str, most: int) -> list[str]:
        if len(stretch) <= most:
            return [stretch]
        middle = len(stretch) // 2
        return self._halves(stretch[:middle], most) + self._halves(stretch[middle:], most)

    def pieces(self, text: str, most: int = LONG) -> list[tuple[str, int]]:
        """``text`` cut into pieces of at most ``most`` characters (a special
        token stays whole), each with how it goes on with the one before it:
        ``APART``, in one unsplit ``STRETCH``, or in one ``TEXT``."""
        out: list[tuple[str, int]] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append((part, APART))
                continue
            at, first = 0, APART
            while len(part) - at > most:
                near = _EDGE.search(part, at, at + most), _EDGE.search(part, at + most, at + 2 * most)
                if near[0] and near[1]:
                    out.append((part[at : at + most], first))
                    at, first = at + most, TEXT
                    continue
                if first == TEXT:  # what follows is cut in another way behind the next edge
                    edge = _EDGE.search(part, at).end()
                    out.append((part[at:edge], TEXT))
                    at, first = edge, APART
                    continue
                edge = 0
                for m in _EDGE.finditer(part, at, at + most + 1):
                    edge = m.end()
                if edge > at:
                    out.append((part[at:edge], APART))
                    at = edge
                    continue
                m = _EDGE.search(part, at)
                stop = m.end() if m else len(part)
                pack = ""
                for unsplit in _SPLIT.findall(part[at:stop]):
                    alone = len(unsplit) > most or unsplit.isspace()  # how spaces split depends on what follows
                    if pack and (alone or len(pack) + len(unsplit) > most):
                        out.append((pack, APART))
                        pack = ""
                    if alone:
                        out += [(half, STRETCH if i else APART) for i, half in enumerate(self._halves(unsplit, most))]
                    else:
                        pack += unsplit
                if pack:
                    out.append((pack, APART))
                at = stop
            if at < len(part):
                out.append((part[at:], first))
        return out

    def join_text(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """The encoding of two encoded parts of a text that was cut anywhere."""
        spaces = b" \t\n\r"
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            while a < len(left) and not (self.tokens[int(left[-a])][0] in spaces and self.tokens[int(left[-a - 1])][-1] not in WHITE):
                a += 1
            while b < len(right) and not (self.tokens[int(right[b])][0] in spaces and self.tokens[int(right[b - 1])][-1] not in WHITE):
                b += 1
            inner = [*left[len(left) - a :].tolist(), *right[:b].tolist()]
            fresh = self.encode(b"".join(self.tokens[i] for i in inner).decode("utf-8"))
            if (a == len(left) or fresh[0] == inner[0]) and (b == len(right) or fresh[-1] == inner[-1]):
                return np.concatenate([left[: len(left) - a], fresh, right[b:]])
            window *= 2

    def join(self, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """The encoding of two encoded parts of one unsplit stretch."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            while a < len(left) and self.tokens[int(left[-a])][0] & 0xC0 == 0x80:
                a += 1
            while b < len(right) and self.tokens[int(right[b])][0] & 0xC0 == 0x80:
                b += 1
            inner = [*left[len(left) - a :].tolist(), *right[:b].tolist()]
            fresh = np.asarray(self.core.encode_ordinary(b"".join(self.tokens[i] for i in inner).decode("utf-8")), np.int32)
            if (a == len(left) or fresh[0] == inner[0]) and (b == len(right) or fresh[-1] == inner[-1]):
                return np.concatenate([left[: len(left) - a], fresh, right[b:]])
            window *= 2

    def tree(self, parts: list[np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Join the parts of one stretch or text, neighbours first."""
        while len(parts) > 1:
            parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def assemble(self, parts: list[np.ndarray], goes_on: list[int]) -> np.ndarray:
        """The encoding of a text from those of its pieces, in order."""
        whole, run, how = [], [], APART
        for ids, more in zip(parts, goes_on, strict=True):
            if run and more == APART:
                whole.append(self.tree(run, self.join_text if how == TEXT else self.join))
                run, how = [], APART
            run.append(ids)
            how = max(how, more)
        if run:
            whole.append(self.tree(run, self.join_text if how == TEXT else self.join))
        return np.concatenate(whole) if whole else np.empty(0, np.int32)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _numbers(lists: pa.Array, i: int) -> np.ndarray:
    a, b = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
    return lists.values.slice(a, b - a).to_numpy(zero_copy_only=False)


def encode_column(text: Column, path: str) -> Column:
    """Token ids (array<int>) of each text in one go; a null text is empty."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return _lists([bpe.encode(t.as_py() or "") for t in texts])

    return run(text)


def encode_checked(text: Column, path: str) -> Column:
    """struct(ids, back) of each text: the ids, and whether they decode to it.  One
    pass, so a task needs one Python worker and no second copy of the ids."""

    @F.arrow_udf("struct<ids: array<int>, back: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        bpe, ids, back = load(path), [], []
        for t in texts:
            own = t.as_py() or ""
            ids.append(bpe.encode(own))
            back.append(bpe.decode(ids[-1].tolist()) == own)
        return pa.StructArray.from_arrays([_lists(ids), pa.array(back, pa.bool_())], ["ids", "back"])

    return run(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each row of token ids; null rows give null, null ids and ids
    without a token are left out."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([None if (ids := r.as_py()) is None else bpe.decode(ids) for r in rows], pa.string())

    return run(ids)


def digest_column(ids: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of each row of token ids."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(rows: pa.Array) -> pa.Array:
        bpe = load(path)
        n, raw, text = [], [], []
        for i in range(len(rows)):
            own = _numbers(rows, i)
            n.append(len(own))
            raw.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            text.append(hashlib.sha256(bpe.decode(own.tolist()).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(ids)


def encode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids", checked: str | None = None, long: int = LONG) -> DataFrame:
    """``df`` with ``ids`` (array<int>): the encoding of each whole text.

    Equal to what the tokenizers library returns for the file without adding
    special tokens; the strings of special tokens in a text give their ids.
    Null texts count as empty and give no ids.  Texts of at most ``long``
    characters are encoded where they are read; longer ones are cut, spread over
    tasks and put together again.  With ``checked``, a column of that name tells
    whether the ids decode to the text.  Columns named like these are replaced;
    repeated rows stay.
    """
    df = without(df, ids, *([checked] if checked else []))
    body = F.col(f"`{text}`")
    is_long = F.coalesce(F.length(body), F.lit(0)) > long
    short = df.where(~is_long)
    if checked:
        both = short.withColumn("__both", encode_checked(body, path))
        short = both.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__both.ids").alias(ids), F.col("__both.back").alias(checked))
    else:
        short = short.withColumn(ids, encode_column(body, path))

    @F.arrow_udf("array<struct<piece: string, more: int>>")
    def cut(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        rows = [[{"piece": p, "more": m} for p, m in bpe.pieces(t.as_py(), long)] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("piece", pa.string()), ("more", pa.int32())])))

    @F.arrow_udf("struct<ids: array<int>, back: boolean>")
    def put_together(parts: pa.Array, digests: pa.Array) -> pa.Array:
        bpe, out, back = load(path), [], []
        ids, more, ends = parts.values.field("ids"), parts.values.field("more").to_numpy(zero_copy_only=False), parts.offsets.to_pylist()
        for a, b, digest in zip(ends[:-1], ends[1:], digests.to_pylist(), strict=True):
            out.append(bpe.assemble([_numbers(ids, i) for i in range(a, b)], more[a:b].tolist()))
            back.append(bpe.decodes_to(out[-1], digest) if checked else None)
        return pa.StructArray.from_arrays([_lists(out), pa.array(back, pa.bool_())], ["ids", "back"])

    rest = [c for c in df.columns if c != text]
    digest = F.sha2(body.cast("binary"), 256) if checked else F.lit(None).cast("string")
    pieces = (
        df.where(is_long)
        .select(F.monotonically_increasing_id().alias("row"), F.struct(digest.alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"), body.alias("body"))
        .select("row", "rest", F.posexplode(cut("body")).alias("place", "part"))
        .repartition(F.col("row"), F.col("place"))
        .select("row", "rest", "place", F.col("part.piece").alias("piece"), F.col("part.more").alias("more"), encode_column(F.col("part.piece"), path).alias("ids"))
    )
    # Texts are collected apart from ids, so they stay where they are if nobody asks for them.
    placed = lambda *names: F.array_sort(F.collect_list(F.struct("place", *names)))
    whole = (
        pieces.groupBy("row")
        .agg(F.first("rest").alias("rest"), placed("piece").alias("texts"), placed("more", "ids").alias("parts"))
        .select("rest", F.array_join(F.transform("texts", lambda p: p["piece"]), "").alias("body"), put_together(F.transform("parts", lambda p: F.struct(p["more"], p["ids"])), F.col("rest")["_"]).alias("done"))
        .select(
            *[F.col("body").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in df.columns],
            F.col("done.ids").alias(ids), *([F.col("done.back").alias(checked)] if checked else []),
        )
    )
    return short.unionByName(whole)
