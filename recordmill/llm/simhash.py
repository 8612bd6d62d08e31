"""SimHash near-duplicates by bit-sliced comparison.

Plan: one pass over the texts makes 64-bit fingerprints (a narrow table, written once). Equal fingerprints are merged by
a partially aggregated groupBy, so exact copies never meet as pairs. The 64 bits are cut into ``m`` bands, and distinct
fingerprints are dealt into buckets by every choice of ``m - radius`` of them: two fingerprints within the radius differ in
at most ``radius`` bands, so they share a bucket and no link is lost. ``m`` grows with the number of fingerprints, so that
a bucket of evenly spread ones holds a few dozen. Within a bucket, blocks of 64 candidates are stored as vertical bit planes; carry-save counters hold 64 distances
at once and a block is abandoned once every distance exceeds the radius. A bucket above ``block_rows`` rows is split
into blocks, and pairs of blocks are compared in tasks of their own, so a hot bucket is never one task. Each group
returns a spanning forest of its links, not the links. Components are then found by repeated hooking and contraction.

``keep_one`` can link by several fingerprints of a text's distinct words instead of one of its shingles: a changed word
touches one of them and not four, and a pair far apart in one fingerprint by chance is often near in another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.common import discard, few_or_merging, map_batches, merging, quoted, ship, stash, table, unused, written

SEED = 42
RADIUS = 4
SHINGLE = 4
#: Fingerprints of distinct words, for stages that needn't keep to one of shingles.
PRINTS = 4


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included. No words give 0; fewer than ``width`` words give one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashing = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hashing(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(joined)]
        hashes = [hashing(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _mixed(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of bijective scramblings of 64 bits, so that one hash of a word serves all fingerprints."""
    x = values + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_prints(text: str | None, prints: int = PRINTS) -> str:
    """SimHashes of the distinct words, A-Z lower-cased, 16 hex digits each; all zero without words."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return "0" * (16 * prints)
    values = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for k in range(1, prints + 1):
        counts = np.zeros(64, np.int64)
        mixed = _mixed(values, k)
        for at in range(0, len(mixed), 65536):
            counts += np.unpackbits(mixed[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(f"{int(np.packbits((2 * counts > len(values)).astype(np.uint8), bitorder='little').view(np.uint64)[0]):016x}")
    return "".join(out)


def _print_array(texts: list[str | None], prints: int) -> pa.Array:
    """The fingerprint of each text as a long; with ``prints`` their word fingerprints as one string."""
    if prints:
        return pa.array([word_prints(t, prints) for t in texts], pa.string())
    return pa.array(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: int = 0) -> DataFrame:
    """One row (id, fp) per input row; fp is the fingerprint's bits as a signed long. Null text counts as no words.

    With ``prints``, fp is a string of so many fingerprints of the distinct words.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _print_array(b.column(1).to_pylist(), prints)], names=["id", "fp"])

    return narrow.mapInArrow(run, f"id {kind}, fp {'string' if prints else 'long'}")


#: Evenly spread fingerprints that a bucket may hold before one more band is cut.
BUCKET_ROWS = 64


def band_masks(radius: int, n: int) -> list[int]:
    """The bits of each bucket key: all choices of m - radius of m bands, with the least m that keeps n fingerprints in small buckets."""
    for m in range(radius + 1, 2 * radius + 2):
        edges = [round(64 * i / m) for i in range(m + 1)]
        own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(choice) for choice in combinations(own, m - radius)]
        if n >> min(x.bit_count() for x in masks) <= BUCKET_ROWS:
            break
    return masks


def planes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertical bit planes of blocks of 64 values: planes[block, bit] is a word whose lane j is that bit of value j."""
    n_blocks = -(-len(values) // 64)
    padded = np.zeros(n_blocks * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n_blocks, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(n_blocks, 64, 8).copy().view(np.uint64)[..., 0]
    lanes = np.zeros(n_blocks * 64, np.uint8)
    lanes[: len(values)] = 1
    return planes, np.packbits(lanes.reshape(n_blocks, 64), axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def near_lanes(queries: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int, every: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query, block of 64 candidates): indices of pairs with a near lane, and the word of near lanes.

    ``radius`` is at most 7: three carry-save counter words hold a distance of 0 to 7 for each lane; a carry out of
    them, or a value above the radius, marks the lane as far. Pairs whose lanes are all far leave the arrays.
    """
    alive = np.arange(len(queries))
    near = valid.copy()
    ones, twos, fours = (np.zeros(len(queries), np.uint64) for _ in range(3))
    for bit in range(64):
        flip = np.uint64(0) - ((queries >> np.uint64(bit)) & np.uint64(1))
        x = planes[:, bit] ^ flip
        carry = ones & x
        ones ^= x
        carry2 = twos & carry
        twos ^= carry
        near &= ~(fours & carry2)
        fours ^= carry2
        if bit % every == every - 1:
            far = _above(ones, twos, fours, radius)
            near &= ~far
            keep = near != 0
            if not keep.all():
                alive, queries, planes, near = alive[keep], queries[keep], planes[keep], near[keep]
                ones, twos, fours = ones[keep], twos[keep], fours[keep]
            if not len(alive):
                break
    return alive, near


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter exceeds the radius."""
    above, equal = np.zeros_like(ones), np.full_like(ones, ~np.uint64(0))
    for word, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            equal = equal & word
        else:
            above |= equal & word
            equal = equal & ~word
    return above


class Forest:
    """Union-find over positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def group_links(left: np.ndarray, right: np.ndarray | None, radius: int, chunk: int = 1 << 14) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``, as pairs of fingerprints."""
    if right is None:
        nodes, queries, offset = left, left, 0
        pool = left
    else:
        nodes, queries, pool, offset = np.concatenate([left, right]), left, right, len(left)
    if len(nodes) < 2:
        return []
    planes, valid = planes_of(pool)
    forest = Forest(len(nodes))
    step = max(1, chunk // len(planes))
    for at in range(0, len(queries), step):
        q = np.arange(at, min(at + step, len(queries)))
        if right is None:  # a block that ends before the query has been compared already
            first = q // 64
            counts = len(planes) - first
            qi = np.repeat(q, counts)
            bi = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        else:
            qi, bi = np.repeat(q, len(planes)), np.tile(np.arange(len(planes)), len(q))
        hit, lanes = near_lanes(queries[qi], planes[bi], valid[bi], radius)
        if len(hit):
            which, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = qi[hit[which]], bi[hit[which]] * 64 + lane + offset
            if right is None:
                up = b > a
                a, b = a[up], b[up]
            for i, j in zip(a.tolist(), b.tolist()):
                forest.join(i, j)
    roots = [forest.root(i) for i in range(len(nodes))]
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(roots) if i != r]


def _linker(radius: int):
    """Walk rows sorted by (band, key, i, j, side); each run of one group becomes at most one spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forests(codes: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
            for part, side, code in zip(np.split(fps, cuts), np.split(sides, cuts), codes[np.r_[0, cuts]]):
                if len(part) > 1:
                    if code[2] == code[3]:
                        out += group_links(part, None, radius)
                    else:
                        out += group_links(part[side == 0], part[side == 1], radius)
            return out

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            sides, fps = b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((codes, sides, fps))
            codes, sides, fps = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((codes != codes[-1]).any(axis=1))
            done = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            held = [(codes[done:], sides[done:], fps[done:])]
            yield _pairs(_pairwise(codes[:done], sides[:done], fps[:done], forests, radius))
        if held:
            yield _pairs(forests(*held[0]))

    return run


def _pairwise(codes: np.ndarray, sides: np.ndarray, fps: np.ndarray, forests, radius: int) -> list[tuple[int, int]]:
    """Groups of up to 64 rows go together, one block of lanes each; larger groups one by one."""
    if not len(codes):
        return []
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(codes)])
    small = (sizes <= 64) & (sizes > 1) & (codes[starts, 2] == codes[starts, 3])
    out: list[tuple[int, int]] = []
    if small.any():
        s, n = starts[small], sizes[small]
        for at in range(0, len(s), 256):
            out += _small_groups(fps, s[at : at + 256], n[at : at + 256], radius)
    large = (sizes > 1) & ~small
    for a, n in zip(starts[large].tolist(), sizes[large].tolist()):
        out += forests(codes[a : a + n], sides[a : a + n], fps[a : a + n])
    return out


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Groups of up to 64 fingerprints, one block of lanes each, compared in one sweep."""
    g = np.repeat(np.arange(len(starts)), sizes)
    lane = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid = np.zeros((len(starts), 64), np.uint64)
    grid[g, lane] = values = fps[np.repeat(starts, sizes) + lane]
    planes, _ = planes_of(grid.reshape(-1))
    after = np.where(sizes >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1))
    below = (np.uint64(1) << lane.astype(np.uint64)) - np.uint64(1)
    valid = after[g] & ~(below | (np.uint64(1) << lane.astype(np.uint64)))  # lanes after the query's own
    hit, lanes = near_lanes(values, planes[g], valid, radius)
    if not len(hit):
        return []
    which, other = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    firsts = np.cumsum(sizes) - sizes
    a, b = hit[which], firsts[g[hit[which]]] + other
    forest = Forest(len(values))
    for i, j in zip(a.tolist(), b.tolist()):
        forest.join(i, j)
    return [(int(values[i]), int(values[forest.root(i)])) for i in np.unique(np.r_[a, b]).tolist() if forest.root(i) != i]


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, block_rows: int = 4096) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within ``radius`` bits; ``fps`` has one row for each distinct fp.

    The closure of these links equals the closure of all links.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be between 0 and 7")
    ship(fps.sparkSession)
    masks = np.array(band_masks(radius, fps.count()), np.uint64).view(np.int64).tolist()
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    sizes = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    placed = dealt.join(merging(sizes), ["band", "key"]).select("fp", "band", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    # A row of block x goes to the pair of blocks (x, y) for each y: as the left side where x is the lower one.
    to = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = placed.select("fp", "band", "key", "own", F.explode(to).alias("other")).select(
        "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"
    )
    grouped = rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "side", "fp")
    return grouped.mapInArrow(_linker(radius), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reachable.

    Each round every node hooks on its smallest neighbour if that is smaller, pointers are halved twice, and edges are
    rewritten between the new labels; edges within a label vanish. All steps are partially aggregated groupBys and
    equi-joins, so a node with very many links is split by the skew-join rule. Rounds grow with the logarithm of a
    component's width; each round's tables are written to the shared folder and those before them deleted.
    """
    spark = edges.sparkSession
    left, old = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mapping, mapped = None, None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root"))
        up, hooks = written(up, "hooks")
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up, halved = written(up.join(merging(over), "root").select("node", F.col("above").alias("root")), "hooks")
            discard(spark, hooks)
            hooks = halved
        for name in ("a", "b"):
            left = left.join(merging(up.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))), name)
        left, edge = written(left.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).where("a <> b").distinct(), "edges")
        discard(spark, old)
        old = edge
        if mapping is None:
            mapping, mapped = up, hooks
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            mapping, path = written(mapping.join(merging(over), "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            discard(spark, mapped, hooks)
            mapped = path
    else:
        raise RuntimeError("components did not converge")
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def word_links(distinct: DataFrame, prints: int, radius: int = RADIUS, block_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct rows of word fingerprints: near in any of them. Their closure is that of all such links.

    Rows with an equal k-th fingerprint hang on the least of them, which alone stands for it in that fingerprint's search,
    so a common one emits a link a row and no pairs.
    """
    found = []
    for k in range(prints):
        own = distinct.select("fp", F.conv(F.substring("fp", 16 * k + 1, 16), 16, -10).cast("long").alias("own"))
        least = stash(own.groupBy("own").agg(F.min("fp").alias("rep"), F.count(F.lit(1)).alias("n")), "reps")
        found.append(own.join(merging(least.where("n > 1")), "own").where("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b")))
        near = links(least.select(F.col("own").alias("fp")), radius, block_rows).distinct()
        for name in ("a", "b"):
            near = near.join(merging(least.select(F.col("own").alias(name), F.col("rep").alias(f"{name}_rep"))), name)
        found.append(near.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    return reduce(DataFrame.unionAll, found)


def _members(docs: DataFrame, id_col: str, text_col: str, radius: int, block_rows: int, n_prints: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, fp) per row, and (fp, root, component_id) per distinct fingerprint, or distinct row of ``n_prints`` word fingerprints."""
    prints = stash(fingerprints(docs, id_col, text_col, n_prints), "prints")
    distinct = stash(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    names = distinct.select("fp")
    roots = components(word_links(names, n_prints, radius, block_rows) if n_prints else links(names, radius, block_rows))
    joined = distinct.join(merging(roots), distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints, stash(joined.join(merging(least), "root").select("fp", "root", "component_id"), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block_rows: int = 4096) -> DataFrame:
    """(id, fp, component_id) per input row; component_id is the smallest id reachable over links, the row's own included.

    Null text or text without words has fingerprint 0 and is linked like any other. Rows with a null id take part and
    get the component's smallest id (null if none has one). Repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored.
    """
    prints, members = _members(docs, id_col, text_col, radius, block_rows)
    return prints.join(merging(members), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block_rows: int = 4096, n_prints: int = 0) -> DataFrame:
    """The input's rows and columns, whatever they are named, one row of each component: that with the smallest id, of repeated rows any one.

    Links are those of near_duplicates, or with ``n_prints`` those of texts near in any of so many fingerprints of their distinct words.

    A component in which no row has an id keeps one of its rows too. An id whose rows fall in several components stands
    for each of those of which it is the smallest, by a row of that very component.
    """
    prints, members = _members(docs, id_col, text_col, radius, block_rows, n_prints)
    kept_id, n, print_col, root, component = unused(docs.columns, "__kept", "__n", "__fp", "__root", "__component")
    ids = prints.where("id is not null").join(merging(members), "fp").groupBy(F.col("id").alias(kept_id))
    ids = stash(ids.agg(F.max(F.col("id") == F.col("component_id")).alias("least"), (F.min("root") != F.max("root")).alias("spread")).where("least"), "kept")
    named = docs.join(merging(ids.where("not spread").select(kept_id)), F.col(id_col) == F.col(kept_id), "left_semi")  # dealt by id, as the window below needs it
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    named = named.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    spread = few_or_merging(stash(ids.where("spread").select(kept_id), "spread"))
    others = docs.join(spread, F.col(id_col) == F.col(kept_id), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    of = members.select(F.col("fp").alias(print_col), F.col("root").alias(root), F.col("component_id").alias(component))
    others = _with_print(others, text_col, print_col, n_prints).join(merging(of), print_col).where(F.col(id_col).eqNullSafe(F.col(component)))
    least = Window.partitionBy(root).orderBy(print_col)
    others = others.withColumn(n, F.row_number().over(least)).where(F.col(n) == 1).select(*quoted(docs.columns))
    return named.unionByName(others)


def weighted(docs: DataFrame, weight_col: str, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block_rows: int = 4096) -> DataFrame:
    """The rows of a bounded table, one broadcast row a fingerprint, with 1 / the rows of their component as ``weight_col``."""
    prints, members = _members(docs, id_col, text_col, radius, block_rows)
    sizes = prints.join(members, "fp").groupBy("root").agg((1 / F.count(F.lit(1))).alias(weight_col))
    (name,) = unused(docs.columns, "__fp")
    of = members.join(sizes, "root").select(F.col("fp").alias(name), weight_col)
    return _with_print(docs, text_col, name).join(F.broadcast(of), name).drop(name)


def _with_print(docs: DataFrame, text_col: str, name: str, n_prints: int = 0) -> DataFrame:
    """The rows with their fingerprint as the column ``name``, which is none of theirs."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _print_array(b.column(at).to_pylist(), n_prints)], names=[*b.schema.names, name])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType() if n_prints else T.LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
