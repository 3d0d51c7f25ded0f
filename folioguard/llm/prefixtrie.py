"""The trie of all prefixes of ordered conversations.

A conversation is the sequence of its turns' digests.  Conversations are sorted by
it in ranges; neighbours are linked by the length of their longest common prefix.
Union-find takes these links from the deepest on: a merge of components at a depth
makes the branching node of that depth, whose members are the component.  What lies
within a range is finished there; the nodes along its two edges may go on beyond it,
and are contracted to a few items with their links.  Such forests are put side by
side and merged in the same way, many at a time, until one is left.

A turn takes 20 bytes here (16 of its digest, 4 of its text's length), whatever its
text.  Those of one conversation have to fit a task, and so do those of a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Bytes of a turn's digest, and forests that are merged in one task.
DIGEST, FAN = 16, 64
#: Bytes of ids that are joined at once for the digest of a node's ends.
CHUNK = 1 << 20
NOTHING = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, ends_key binary"
FOREST = "part long, depth array<long>, n array<long>, least array<long>, kids array<long>, below array<long>, saved array<long>, ended array<boolean>, first_seq binary, last_seq binary, first_cum binary, last_cum binary"
KNOWN = "key binary, conv_id long"
ENDS = "key binary, part long, at long, ids binary"
_KINDS = {"node": NODE, "forest": FOREST, "known": KNOWN, "ends": ENDS}
SCHEMA = ", ".join(f"{kind} struct<" + ", ".join(f.replace(" ", ": ") for f in ddl.split(", ")) + ">" for kind, ddl in _KINDS.items())


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 of role and text, which cannot be mistaken for others."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, DIGEST)


def sequences(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``seq``: digests of its turns in order, ``lens``: the code
    points of their texts, 4 bytes each).

    Turns are in the order of ``turn``, null first; ties follow the role and then
    the digest, so that every run agrees.  Null roles and texts are empty; rows
    that repeat are turns of their own; rows without a conversation are left out.
    Rows without texts are shuffled, sorted and streamed.
    """
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), turn_digest(r, t).alias("digest"), F.length(t).cast("int").alias("n")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, lens = None, bytearray(), bytearray()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in ([i for i, _, _ in out], [s for _, s, _ in out], [n for _, _, n in out])], ["conv_id", "seq", "lens"])

        out: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            digests = b"".join(batch.column("digest").to_pylist())
            sizes = batch.column("n").to_numpy().astype("<i4").tobytes()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist()
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if ids[a] != at:
                    if at is not None:
                        out.append((int(at), bytes(seq), bytes(lens)))
                    at, seq, lens = ids[a], bytearray(), bytearray()
                seq += digests[DIGEST * a : DIGEST * b]
                lens += sizes[4 * a : 4 * b]
            if len(out) >= 2000:
                yield made()
                out = []
        if at is not None:
            out.append((int(at), bytes(seq), bytes(lens)))
        if out:
            yield made()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv_id", "digest", "n").mapInArrow(run, "conv_id long, seq binary, lens binary")


def rebuilt(convs: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """``convs`` (of ``sequences``), each with its first turns replaced by those of
    the conversation ``conv_id - conv_id % every``: as many of them as the crc32 of
    the decimal id gives modulo ``heads``, all if there are fewer, none if that
    conversation is not there.  ``%`` has the sign of the id, as in SQL."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = convs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("of"), F.substring("seq", 1, DIGEST * heads).alias("head"), F.substring("lens", 1, 4 * heads).alias("head_lens")
    )
    both = convs.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left")

    def spliced(head: str, own: str, size: int) -> Column:
        start = F.substring(F.coalesce(head, F.lit(b"")), F.lit(1), F.col("h") * size)
        return F.concat(start, F.substring(F.col(own), F.col("h") * size + 1, F.octet_length(own)))

    return both.select("conv_id", spliced("head", "seq", DIGEST).alias("seq"), spliced("head_lens", "lens", 4).alias("lens"))


def common(a: bytes, b: bytes) -> int:
    """The turns that two sequences begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // DIGEST


def prefix_key(seq: bytes, depth: int) -> bytes:
    return hashlib.blake2b(seq[: DIGEST * depth], digest_size=16).digest()


@dataclass
class Items:
    """Nodes side by side, in the order of the sequences: what is known of each by
    its closed part, a sequence through it, and the prefix sums of text lengths
    along that."""

    depth: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    saved: list[int] = field(default_factory=list)
    ended: list[bool] = field(default_factory=list)
    seq: list[bytes] = field(default_factory=list)
    cum: list[np.ndarray] = field(default_factory=list)

    def add(self, depth, n, least, kids, below, saved, ended, seq, cum) -> None:
        for column, value in zip(vars(self).values(), (depth, n, least, kids, below, saved, ended, seq, cum), strict=True):
            column.append(value)


class Growth:
    """Union-find over the links between neighbours, from the deepest on.

    ``closed``: (node, lowest depth of its chain, parent or -1) of nodes that
    nothing beyond the items can change.  A chain is a node with the depths above
    it up to its parent, at which no member leaves.
    """

    def __init__(self, items: Items, links: list[int], last: bool) -> None:
        self.items, self.count = items, len(items.depth)
        self.left = [-1] * self.count
        self.right = [-1] * self.count
        self.same = list(range(self.count))
        self.closed: list[tuple[int, int, int]] = []
        self.shut: set[int] = set()
        up, low, high, top = list(range(self.count)), list(range(self.count)), list(range(self.count)), list(range(self.count))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def attach(c: int, parent: int) -> None:
            if low[c] and high[c] < self.count - 1:
                self.close(top[c], parent)
            elif not low[c]:
                self.left[parent] = top[c]
            else:
                self.right[parent] = top[c]

        depth = items.depth
        for e in sorted(range(self.count - 1), key=lambda i: -links[i]):
            a, b, d = find(e), find(e + 1), links[e]
            x, y = top[a], top[b]
            if depth[x] > d and depth[y] > d:
                items.add(d, 0, NOTHING, 0, 0, 0, False, items.seq[x], items.cum[x])
                node = len(depth) - 1
                self.left.append(-1)
                self.right.append(-1)
                self.same.append(node)
                attach(a, node)
                attach(b, node)
            elif depth[x] > d:
                node = y
                attach(a, node)
            else:
                node = x
                if depth[y] > d:
                    attach(b, node)
                else:
                    self.join(x, y)
            up[b] = a
            low[a], high[a], top[a] = low[a], high[b], node
        self.top = top[find(0)]
        if last:
            for chain in (self.left, self.right):
                path = self.path(chain)
                for child, parent in zip(path, path[1:], strict=False):
                    self.close(child, parent)
            self.close(self.top, -1)

    def path(self, chain: list[int]) -> list[int]:
        """The nodes along an edge, from the outermost up to the top."""
        found = [self.top]
        while chain[found[-1]] >= 0:
            found.append(chain[found[-1]])
        return found[::-1]

    def join(self, x: int, y: int) -> None:
        """Two parts of one node."""
        it = self.items
        self.same[y] = x
        it.n[x] += it.n[y]
        it.least[x] = min(it.least[x], it.least[y])
        it.kids[x] += it.kids[y]
        it.below[x] += it.below[y]
        it.saved[x] += it.saved[y]
        it.ended[x] = it.ended[x] or it.ended[y]
        self.right[x] = self.right[y]

    def one(self, node: int) -> int:
        while self.same[node] != node:
            node = self.same[node]
        return node

    def close(self, x: int, parent: int) -> None:
        it = self.items
        above = it.depth[parent] if parent >= 0 else -1
        self.closed.append((x, above + 1, parent))
        self.shut.add(x)
        if parent >= 0:
            it.n[parent] += it.n[x]
            it.least[parent] = min(it.least[parent], it.least[x])
            it.kids[parent] += 1
            it.below[parent] += it.below[x] if it.kids[x] else 1
            it.saved[parent] += it.saved[x] + (it.n[x] - 1) * int(it.cum[x][it.depth[x]] - it.cum[x][above])

    def key(self, node: int) -> bytes:
        return prefix_key(self.items.seq[node], self.items.depth[node])

    def rows(self, ends_of) -> Iterator[pa.StructArray]:
        """The rows of closed nodes.  ``ends_of``: node -> (digest, or None and the
        key under which it is found)."""
        it = self.items
        for at in range(0, len(self.closed), 4096):
            out: dict[str, list] = {n.split(" ")[0]: [] for n in NODE.split(", ")}
            for x, low, parent in self.closed[at : at + 4096]:
                p = self.one(parent) if parent >= 0 else -1
                known = p < 0 or p in self.shut
                depth, n, least, cum = it.depth[x], it.n[x], it.least[x], it.cum[x]
                size = depth - low + 1
                before = np.concatenate([[0], cum])[low : depth + 1]  # the root has no text
                out["conv_id"] += [least] * size
                out["depth"] += range(low, depth + 1)
                out["parent_conv_id"] += [it.least[p] if known and p >= 0 else None] + [least] * (size - 1)
                out["parent_key"] += [None if known else self.key(p)] + [None] * (size - 1)
                out["n_convs"] += [n] * size
                out["n_children"] += [1] * (size - 1) + [it.kids[x]]
                out["n_leaves"] += [it.below[x] if it.kids[x] else 1] * size
                out["saved_tokens"] += (it.saved[x] + (n - 1) * (int(cum[depth]) - before)).tolist()
                digest, key = ends_of(x) if it.ended[x] else (NO_ENDS, None)
                out["ends"] += [NO_ENDS] * (size - 1) + [digest]
                out["ends_key"] += [None] * (size - 1) + [key]
            yield _structs(out, NODE)

    def contracted(self, part: int, first: tuple[bytes, bytes], last: tuple[bytes, bytes]) -> pa.StructArray:
        """The nodes along both edges as a forest of their own."""
        it, order = self.items, self.path(self.left) + self.path(self.right)[-2::-1]
        columns = {name: [[getattr(it, name)[i] for i in order]] for name in ("depth", "n", "least", "kids", "below", "saved", "ended")}
        return _structs({"part": [part], **columns, "first_seq": [first[0]], "last_seq": [last[0]], "first_cum": [first[1]], "last_cum": [last[1]]}, FOREST)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _structs(columns: dict[str, list], ddl: str) -> pa.StructArray:
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.StructArray.from_arrays([pa.array(columns[name], _ARROW[kind]) for name, kind in fields], fields=[pa.field(name, _ARROW[kind]) for name, kind in fields])


def _batch(kind: str, rows: pa.StructArray) -> pa.RecordBatch:
    def empty(ddl: str) -> pa.Array:
        return pa.nulls(len(rows), pa.struct([(f.split(" ")[0], _ARROW[f.split(" ")[1]]) for f in ddl.split(", ")]))

    return pa.RecordBatch.from_arrays([rows if k == kind else empty(ddl) for k, ddl in _KINDS.items()], list(_KINDS))


def _sums(lens: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(lens, "<i4"), dtype=np.int64)])


def _range_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a sorted range of (``seq``, ``conv_id``, ``lens``)."""
    items, links, ids, part = Items(), [], [], TaskContext.get().partitionId()
    runs: list[np.ndarray] = []
    for batch in batches:
        for seq, i, lens in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("lens").to_pylist(), strict=True):
            if items.seq and seq == items.seq[-1]:
                items.n[-1] += 1
                ids.append(i)
                continue
            if items.seq:
                links.append(common(items.seq[-1], seq))
                runs.append(np.array(ids, np.int64))
                ids = []
            ids.append(i)
            items.add(len(seq) // DIGEST, 1, i, 0, 0, 0, True, seq, _sums(lens))
    if not items.seq:
        return
    runs.append(np.array(ids, np.int64))
    first, last = (items.seq[0], items.cum[0].tobytes()), (items.seq[-1], items.cum[-1].tobytes())
    count = len(items.seq)
    grown = Growth(items, links, False)

    def text(node: int) -> bytes:
        return ",".join(map(str, runs[node].tolist())).encode()

    for rows in grown.rows(lambda x: (hashlib.sha256(text(x)).hexdigest(), None)):
        yield _batch("node", rows)
    for x in range(count):  # ends of nodes that may go on in other ranges
        if x not in grown.shut:
            for at in range(0, len(runs[x]), CHUNK // 16):
                piece = ",".join(map(str, runs[x][at : at + CHUNK // 16].tolist())).encode()
                yield _batch("ends", _structs({"key": [grown.key(x)], "part": [part], "at": [at], "ids": [piece]}, ENDS))
    yield _batch("forest", grown.contracted(part, first, last))


def _merged(forests: list[dict], part: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One forest of some that stand side by side."""
    items, links = Items(), []
    for k, f in enumerate(forests):
        top = int(np.argmin(f["depth"]))
        first_cum, last_cum = np.frombuffer(f["first_cum"], np.int64), np.frombuffer(f["last_cum"], np.int64)
        if k:
            links.append(common(forests[k - 1]["last_seq"], f["first_seq"]))
        links += [min(a, b) for a, b in zip(f["depth"], f["depth"][1:], strict=False)]
        for i, values in enumerate(zip(*[f[c] for c in ("depth", "n", "least", "kids", "below", "saved", "ended")], strict=True)):
            items.add(*values, *((f["first_seq"], first_cum) if i <= top else (f["last_seq"], last_cum)))
    grown = Growth(items, links, last)
    for rows in grown.rows(lambda x: (None, grown.key(x))):
        yield _batch("node", rows)
    if grown.closed:
        yield _batch("known", _structs({"key": [grown.key(x) for x, _, _ in grown.closed], "conv_id": [items.least[x] for x, _, _ in grown.closed]}, KNOWN))
    if not last:
        yield _batch("forest", grown.contracted(part, (forests[0]["first_seq"], forests[0]["first_cum"]), (forests[-1]["last_seq"], forests[-1]["last_cum"])))


def _merge_forests(forests: DataFrame, fan: int, last: bool) -> DataFrame:
    """Forests of ``fan`` neighbouring numbers as one, or all of them at ``last``."""

    def group(part: int) -> int:
        return 0 if last else part // fan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and group(row["part"]) != at:
                    yield from _merged(held, at, last)
                    held = []
                at = group(row["part"])
                held.append(row)
        if held:
            yield from _merged(held, at, last)

    grouped = forests.withColumn("to", F.lit(0) if last else F.floor(F.col("part") / fan)).repartition("to").sortWithinPartitions("to", "part").drop("to")
    return grouped.mapInArrow(run, SCHEMA)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(``key``, ``sha``): SHA-256 of the pieces of a key in order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        out.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids)
        if at is not None:
            out.append((at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "sha"])

    return ends.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "ids").mapInArrow(run, "key binary, sha string")


def prefix_trie(convs: DataFrame, *, fan: int = FAN) -> DataFrame:
    """One row for each distinct prefix of ``convs`` (``conv_id``, ``seq``,
    ``lens``, as ``sequences`` gives them; ids are distinct): ``conv_id``, the
    smallest that begins with it, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``n_leaves``: nodes without children in its subtree, itself included.
    ``saved_tokens``: over its subtree, each node's last text once for every member
    but one.  ``ends_sha256``: SHA-256 of the ids, in order and comma-joined, of
    those that end here.  No conversations give no rows.

    Ranges split by id where many conversations are equal, so a group of copies of
    any size is in many tasks; what one range leaves open are nodes along the
    longest two conversations at its edges.
    """
    ordered = settle(convs, "trie-sequences").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    made = settle(ordered.select("seq", "conv_id", "lens").mapInArrow(_range_forest, SCHEMA), "trie-ranges")
    parts = [made]
    forests = made.where("forest is not null").select("forest.*")
    count = forests.count()
    while count:
        last = count <= fan
        made = settle(_merge_forests(forests, fan, last), "trie-merged")
        parts.append(made)
        forests = made.where("forest is not null").select("forest.*")
        count = 0 if last else forests.count()

    def rows(kind: str) -> DataFrame:
        out = parts[0].where(f"{kind} is not null").select(f"{kind}.*")
        for p in parts[1:]:
            out = out.unionByName(p.where(f"{kind} is not null").select(f"{kind}.*"))
        return out

    nodes = rows("node")
    here = nodes.where("parent_key is null and ends_key is null")
    open_ = nodes.where("parent_key is not null or ends_key is not null")
    known = rows("known").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    shas = _end_digests(parts[0].where("ends is not null").select("ends.*")).withColumnRenamed("key", "ends_key")
    found = open_.join(known, "parent_key", "left").join(shas, "ends_key", "left")
    found = found.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "parent"), "ends": F.coalesce("ends", "sha")})
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return here.select(*columns).unionByName(found.select(*columns))
