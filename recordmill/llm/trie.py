"""Prefix tries of conversations, built from adaptive radix trees over ranges of sorted keys.

A turn is a fixed-width id, the first 16 bytes of a digest of its role and text, and a conversation is the key made of its
turns' ids, big end first. Keys are dealt by ranges of (key, conv_id), so that a turn, a prefix or a whole conversation that
a third of all rows share spreads over many tasks. A task builds an adaptive radix tree of its range: nodes change their
layout as they fill (4, 16, 48, 256 children) and keep chains of single bytes as one path. Only byte depths at which a turn
ends give a node of the trie. Nodes within a range are final; those on the way to its first and its last key may go on in
the ranges beside it. These few, a path or two for each range, are merged in the order of the ranges by one streaming task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import ship, stash, table

#: Bytes of a turn's id; conversations and bytes of keys of a range; conversation ids of a chunk that is hashed elsewhere.
WIDTH, RANGE_ROWS, RANGE_BYTES, CHUNK_IDS = 16, 32_768, 16 << 20, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: a compressed path, what ends here, and children by byte in the smallest layout that holds them.

    Layouts of 4 and 16 keep a sorted list of bytes beside the children, that of 48 a table from byte to slot, that of 256
    a slot for each byte.
    """

    __slots__ = ("path", "end", "size", "index", "kids")

    def __init__(self, path: bytes):
        self.path, self.end, self.size, self.index, self.kids = path, None, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            return self.kids[self.index[byte]] if self.index[byte] != 255 else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Set the child of a byte, growing the layout when it is full."""
        if self.size <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.kids[at] = kid
                return
            if len(self.kids) < self.size:
                self.index.insert(at, byte)
                self.kids.insert(at, kid)
                return
            if self.size == 4:
                self.size = 16
            else:
                slots = bytearray(b"\xff" * 256)
                for slot, old in enumerate(self.index):
                    slots[old] = slot
                self.size, self.index = 48, slots
            self.put(byte, kid)
        elif self.size == 48:
            if self.index[byte] != 255:
                self.kids[self.index[byte]] = kid
            elif len(self.kids) < 48:
                self.index[byte] = len(self.kids)
                self.kids.append(kid)
            else:
                self.kids = [self.kids[slot] if slot != 255 else None for slot in self.index]
                self.size, self.index = 256, bytearray()
                self.kids[byte] = kid
        else:
            self.kids[byte] = kid

    def children(self) -> list[tuple[int, Node]]:
        """(byte, child) in ascending order of the byte."""
        if self.size <= 16:
            return list(zip(self.index, self.kids))
        if self.size == 48:
            return [(byte, self.kids[slot]) for byte, slot in enumerate(self.index) if slot != 255]
        return [(byte, kid) for byte, kid in enumerate(self.kids) if kid is not None]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` on share at their beginning."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key: bytes, end: object) -> None:
    """Add a key below the root, whose own path is empty."""
    node, up, byte, at = root, None, 0, 0
    while True:
        same = common(node.path, key, at)
        if same < len(node.path):  # the path parts here
            fork = Node(node.path[:same])
            fork.put(node.path[same], node)
            node.path = node.path[same + 1 :]
            up.put(byte, fork)
            node = fork
        at += same
        if at == len(key):
            node.end = end
            return
        kid = node.child(key[at])
        if kid is None:
            leaf = Node(key[at + 1 :])
            leaf.end = end
            node.put(key[at], leaf)
            return
        node, up, byte, at = kid, node, key[at], at + 1


class Carry:
    """What a subtree hands to the turn above it: conversations, smallest id, topmost nodes, leaves, saved tokens, any key's turn lengths."""

    __slots__ = ("n", "least", "tops", "leaves", "saved", "chars", "waiting")

    def __init__(self):
        self.n, self.least, self.tops, self.leaves, self.saved, self.chars, self.waiting = 0, None, 0, 0, 0, None, []

    def add(self, other: Carry) -> None:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.tops, self.leaves, self.saved = self.tops + other.tops, self.leaves + other.leaves, self.saved + other.saved
        self.chars = self.chars if self.chars is not None else other.chars
        if len(self.waiting) < len(other.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting


class Ended:
    """A distinct key's conversations: how many, the smallest id, the digest of all ids, and the lengths of its turns."""

    __slots__ = ("n", "least", "digest", "chars")

    def __init__(self, ids: list[int], chars: list[int]):
        self.n, self.least, self.chars = len(ids), ids[0], chars
        self.digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


#: A node of the trie within a range, in the order of the columns of FOUND from ``depth`` to ``parent_seq``.
FOUND = (
    "kind int, part int, seq int, depth long, id binary, chars long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, parent_seq int, key string, chunk int, text string"
)
_NAMES = [c.split()[0] for c in FOUND.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ARROW = [_TYPES[c.split()[1]] for c in FOUND.split(", ")]
NODE, EDGE, CHUNK = 0, 1, 2


def walk(root: Node, part: int, first: bytes, last: bytes) -> Iterator[dict]:
    """The trie's nodes of a range, by a post-order walk: whole ones, and those on the way to the first and last key.

    An edge counts what hangs on it besides other edges; ``seq`` numbers a range's edges in the order of their keys.
    """
    ahead = len(first) // WIDTH
    todo, done = [(root, 0, True, True, None, False)], {}
    while todo:
        node, start, on_first, on_last, above, seen = todo.pop()
        stop = start + len(node.path)
        if not seen:
            todo.append((node, start, on_first, on_last, above, True))
            reach = [stop if on and common(node.path, whole, start) == len(node.path) else -1 for on, whole in ((on_first, first), (on_last, last))]
            for byte, kid in node.children():
                along = [r == stop and stop < len(whole) and whole[stop] == byte for r, whole in zip(reach, (first, last))]
                todo.append((kid, stop + 1, *along, node, False))
            continue
        carry = done.pop(id(node), None) or Carry()
        end = node.end
        if end is not None:
            own = Carry()
            own.n, own.least, own.chars = end.n, end.least, end.chars
            carry.add(own)
        shared = [start + common(node.path, whole, start) if on else -1 for on, whole in ((on_first, first), (on_last, last))]
        lowest = 0 if above is None else start - 1  # bytes down to here belong to the node above
        for depth in range(stop // WIDTH, -1 if above is None else lowest // WIDTH, -1):
            here = end if end is not None and depth * WIDTH == stop else None
            row = {"part": part, "depth": depth, "conv_id": carry.least, "n_convs": carry.n, "n_children": carry.tops, "n_leaves": carry.leaves, "saved_tokens": carry.saved}
            chars = carry.chars[depth - 1] if depth else 0
            waiting, carry.waiting = carry.waiting, []
            if (on_it := depth * WIDTH <= shared[0]) or depth * WIDTH <= shared[1]:
                whole = first if on_it else last
                row |= {"kind": EDGE, "seq": depth if on_it else ahead + depth, "id": whole[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"", "chars": chars}
                row["key"] = hashlib.sha256(whole[: depth * WIDTH]).hexdigest() if here else None
                for kid in waiting:
                    kid["parent_seq"] = row["seq"]
                carry.n, carry.least, carry.tops, carry.leaves, carry.saved = 0, None, 0, 0, 0
            else:
                row |= {"kind": NODE, "ends_sha256": here.digest if here else EMPTY}
                row["n_leaves"] = carry.leaves or 1
                row["saved_tokens"] += (carry.n - 1) * chars
                for kid in waiting:
                    kid["parent_conv_id"] = carry.least
                carry.tops, carry.leaves, carry.saved, carry.waiting = 1, row["n_leaves"], row["saved_tokens"], [row]
            yield from waiting
            if row["kind"] == EDGE:
                yield row
        if above is not None:
            done.setdefault(id(above), Carry()).add(carry)


def _batches(rows: Iterator[dict], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(_NAMES, _ARROW)], names=_NAMES)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one range of (part, key, conv_id, chars), sorted: its nodes, its edges, and the ids that end at an edge, in chunks."""
    root, key, chars, ids, part, first = Node(b""), None, None, [], None, None
    # The ids of the first key, and of the latest one and the keys that it begins with.
    kept: list[tuple[bytes, list[int]]] = []
    opened: list[tuple[bytes, list[int]]] = []

    def ended() -> None:
        insert(root, key, Ended(ids, chars))
        if key == first:
            kept.append((key, ids))
            return
        while opened and not key.startswith(opened[-1][0]):
            opened.pop()
        opened.append((key, ids))

    for b in batches:
        for own_part, own_key, conv_id, own_chars in zip(*(b.column(i).to_pylist() for i in range(4))):
            if own_key != key:
                if key is not None:
                    ended()
                part, key, chars, ids = own_part, own_key, own_chars, []
                first = key if first is None else first
            ids.append(conv_id)
    if key is None:
        return
    ended()

    def chunks() -> Iterator[dict]:
        for one, its in kept + opened:
            digest = hashlib.sha256(one).hexdigest()
            for n, at in enumerate(range(0, len(its), CHUNK_IDS)):
                yield {"kind": CHUNK, "part": part, "key": digest, "chunk": n, "text": ",".join(map(str, its[at : at + CHUNK_IDS]))}

    yield from _batches(chunks(), 50)
    yield from _batches(walk(root, part, first, key))


MERGED = "mapped boolean, part int, seq int, uid long, parent_uid long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key string"
_MERGED = [c.split()[0] for c in MERGED.split(", ")]
_MERGED_ARROW = [pa.bool_() if c.split()[1] == "boolean" else _TYPES[c.split()[1]] for c in MERGED.split(", ")]


class _Open:
    __slots__ = ("uid", "id", "chars", "key", "sum")

    def __init__(self, uid: int, turn: bytes, chars: int):
        self.uid, self.id, self.chars, self.key, self.sum = uid, turn, chars, None, Carry()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of all ranges, sorted by (part, seq), to the nodes that they make together, and which node each edge is. Only one path is open at a time."""
    path: list[_Open] = []
    out: list[tuple] = []
    uid = 0

    def close() -> None:
        done = path.pop()
        s = done.sum
        leaves, saved = s.leaves or 1, s.saved + (s.n - 1) * done.chars
        out.append((False, None, None, done.uid, path[-1].uid if path else None, len(path), s.least, s.n, s.tops, leaves, saved, done.key))
        if path:
            s.tops, s.leaves, s.saved = 1, leaves, saved
            path[-1].sum.add(s)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MERGED_ARROW)], names=_MERGED)

    columns = ("part", "seq", "depth", "id", "chars", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key")
    for b in batches:
        for part, seq, depth, turn, chars, least, n, tops, leaves, saved, key in zip(*(b.column(i).to_pylist() for i in range(len(columns)))):
            if len(path) > depth and path[depth].id != turn:
                while len(path) > depth:
                    close()
            if len(path) == depth:
                path.append(_Open(uid, turn, chars))
                uid += 1
            one = path[depth]
            one.key = key or one.key
            own = Carry()
            own.n, own.least, own.tops, own.leaves, own.saved = n, least, tops, leaves, saved
            one.sum.add(own)
            out.append((True, part, seq, one.uid, None, None, None, None, None, None, None, None))
        if len(out) >= 10_000:
            yield told()
            out.clear()
    while path:
        close()
    if out:
        yield told()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) sorted by key and place to the SHA-256 of each key's texts, comma-joined, in constant memory."""
    key, digest, out = None, None, []
    for b in batches:
        for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if own != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "ends"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends"])


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 100) -> DataFrame:
    """(base, conv_id, turns): each conversation's turns (turn, id, chars) in order of turn, a null one first; base is conv_id less its remainder by ``block``.

    Rows without a conv_id take no part. Null roles and texts count as empty. Rows of one conversation and turn, repeated
    ones too, are turns of their own in the order of their ids. Texts stay where they lie; digests move, once, by ``base``.
    A conversation is one row, with 16 bytes and a number for each turn.
    """
    c, who, said = F.col(conv_id).cast("long"), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * WIDTH)
    rows = conversations.where(c.isNotNull()).select((c - c % block).alias("base"), c.alias("conv_id"), F.col(turn).alias("turn"), digest.alias("id"), F.char_length(said).alias("chars"))
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))


def spliced(convs: DataFrame, longest: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation ``base``, then a conversation's own after its first h; h is crc32 of its decimal id modulo ``longest``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    lead = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, longest - 1)), ignorenulls=True).over(Window.partitionBy("base"))  # a block's conversations
    told = convs.withColumn("lead", lead).withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return told.select("conv_id", F.when(F.col("lead").isNull(), own).otherwise(F.concat(F.slice("lead", F.lit(1), F.col("h")), own)).alias("turns"))


def prefix_trie(convs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the nodes of the trie of ``convs`` (conv_id, turns).

    A node is a distinct sequence of first turns, the root that of none; conv_id is its smallest member. Conversations without turns end at the root.
    Repeated ids are members of their own. An empty table has no node. ``range_rows`` bounds the conversations of a task.
    ``ends_sha256`` is a digest over one text, which only one task at a time can go on with: where a conversation has more
    copies than a range, ranges make the text's chunks, and a task streams them through the digest.
    """
    spark = convs.sparkSession
    ship(spark)
    keys = stash(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"].cast("long")).alias("chars")), "keys")
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // range_rows), -(-(size["bytes"] or 0) // RANGE_BYTES), min(spark.sparkContext.defaultParallelism, size["n"] // 2000))
    ranges = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("part"), "key", "conv_id", "chars")
    found = stash(ranges.mapInArrow(_range, FOUND), "trie")
    edges = found.where(F.col("kind") == EDGE).select("part", "seq", "depth", "id", "chars", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key")
    merged = stash(edges.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_merge, MERGED), "edges")
    whole = merged.where("not mapped").drop("mapped", "part", "seq")
    ends = found.where(F.col("kind") == CHUNK).select("key", "text", "part", "chunk").repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "text").mapInArrow(_digests, "key string, ends string")
    parents = whole.select(F.col("uid").alias("parent_uid"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = whole.join(parents, "parent_uid", "left").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    nodes = found.where(F.col("kind") == NODE)
    # A part's rows at most meet at one of its edges.
    hung = merged.where("mapped").select("part", F.col("seq").alias("parent_seq"), "uid").join(whole.select("uid", F.col("conv_id").alias("parent_conv_id")), "uid").drop("uid")
    below = nodes.where(F.col("parent_seq").isNotNull()).drop("parent_conv_id").join(hung, ["part", "parent_seq"])
    return shared.select(*out).unionByName(nodes.where(F.col("parent_seq").isNull()).select(*out)).unionByName(below.select(*out))


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(sequences(table(spark, sf_dir, "conversations"))))


ORACLE = """
with o as (select conv_id c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) ts from conversations where conv_id is not null group by conv_id),
hs as (select c, ts, list_reduce(flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(cast(c as varchar), '')]),
 lambda a, x: case when x >= 0 then xor(a, cast(x as bigint)) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint) k from o),
h as (select c, ts, xor(k, 4294967295) % 6 h from hs),
s as (select h.c, list_concat(coalesce(b.ts[:h.h], []), h.ts[h.h + 1:]) ts from h left join o b on b.c = h.c - h.c % 100),
p as (select c, len(ts) n, d, ts[:d] p from (select c, ts, unnest(range(0, len(ts) + 1)) d from s)),
nodes as (select p, any_value(d) d, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where n = d), '')) ends_sha256 from p group by p),
k as (select a.p, count(b.p) n_children from nodes a left join nodes b on b.d = a.d + 1 and b.p[:a.d] = a.p group by a.p),
up as (select n.p, n.d, unnest(range(0, n.d + 1)) j, k.n_children, (n.n_convs - 1) * (case when n.d = 0 then 0 else length(n.p[n.d].t) end) saved from nodes n join k on n.p = k.p),
t as (select p[:j] p, sum(case when n_children = 0 then 1 else 0 end) n_leaves, sum(saved) saved_tokens from up group by p[:j])
select n.conv_id, cast(n.d as bigint) as depth, q.conv_id parent_conv_id, n.n_convs, k.n_children, cast(t.n_leaves as bigint) n_leaves, cast(t.saved_tokens as bigint) saved_tokens, n.ends_sha256
from nodes n join k on n.p = k.p join t on n.p = t.p left join nodes q on n.d > 0 and q.d = n.d - 1 and q.p = n.p[:n.d - 1]
"""
