"""Ranked lexical search: exact sparse inner products of items with all documents over ball trees.

An item is a sparse vector of its terms' weights, a document one of whole-number term strengths, so that a score is their
inner product. Only the terms of the items of a block matter, and documents are tokenised once for a block where their texts
lie. Documents are dealt into shards by a hash. A task builds its shard's ball tree (each node the centroid of its documents
and a radius around it) and sends the items down: no document of a node scores above <item, centroid> + |item| * radius,
both item and radius taken within the terms that the item shares with the node.
Leaves are visited best bound first, and left out once the bound, widened by what rounding may add, is below the item's kth
score so far. Scores at the leaves are 64-bit whole numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import ship, stash, table

#: ASCII letters and digits, and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text that are split into terms at once, and bytes of items' text of a block.
PIECE, BLOCK_BYTES = 1 << 20, 16 << 20
#: (document, term) pairs and documents of a shard, documents of a leaf and of the seed shard, items that descend together.
SHARD_PAIRS, SHARD_ROWS, LEAF_ROWS, SEED_ROWS, BATCH = 1_000_000, 65_536, 64, 4096, 512
#: The share by which a bound is widened; sums of doubles here err by less than a millionth of it.
SLACK = 1e-6


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, A to Z lower-cased, in lists of bounded size; texts are cut only beside a term."""
    at = 0
    while at < len(text):
        end = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        stop = end.start() if end else len(text)
        yield TERM.findall(text[at:stop].lower())  # bytes lower-case ASCII alone
        at = stop


def _counter(number: dict[bytes, int]):
    """(doc_id, text) to (doc_id, n terms, the known terms' numbers, their occurrences); texts without a term go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                n, seen = 0, Counter()
                for some in terms(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    n += len(some)
                    seen.update(filter(None, map(number.get, some)))
                if n:
                    known = sorted(seen.items())
                    out.append((doc_id, n, [t - 1 for t, _ in known], [c for _, c in known]))
            if out:
                ids, n, t, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema[0].type), pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


class Rows:
    """Sparse rows: row i has ``cols`` and ``vals`` from start[i] to start[i + 1]."""

    def __init__(self, start: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.start, self.cols, self.vals = start, cols, vals

    def taken(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.cols[at], self.vals[at])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners(), self.vals * dense[self.cols], len(self.start) - 1)


class BallTree:
    """Nodes with a sparse centroid, a radius that holds their documents, two children or a leaf's documents by term."""

    def __init__(self, docs: Rows, width: int, leaf_rows: int = LEAF_ROWS):
        self.centre, self.radius, self.kids, self.leaves = [], [], [], {}
        todo = [(np.arange(len(docs.start) - 1), -1, 0)]
        while todo:
            which, parent, side = todo.pop()
            node, own = len(self.radius), docs.taken(which)
            if parent >= 0:
                self.kids[parent][side] = node
            vals = own.vals.astype(float)
            own_f = Rows(own.start, own.cols, vals)
            mean = (np.bincount(own.cols, vals, width) / len(which)).astype(np.float32)  # the radius is measured from the centre as it is kept
            cols = np.flatnonzero(mean)
            centre, square = mean.astype(float), float((mean.astype(float) ** 2).sum())
            norms = np.bincount(own_f.owners(), vals * vals, len(which))
            # How far documents lie from the centre in each term; one that lacks it, by the centre's own value.
            off = np.where(np.bincount(own.cols, minlength=width) < len(which), centre, 0.0)
            np.maximum.at(off, own.cols, np.abs(vals - centre[own.cols]))
            far = norms - 2 * own_f.dot(centre) + square
            self.centre.append((cols, centre[cols], off[cols]))
            self.radius.append(math.sqrt(max(0.0, float(far.max())) + 1e-9 * (float(norms.max()) + square)))
            self.kids.append([-1, -1])
            if len(which) <= leaf_rows:
                by_term = np.argsort(own.cols, kind="stable")
                distinct, first = np.unique(own.cols[by_term], return_index=True)
                self.leaves[node] = (which, distinct, np.append(first, len(by_term)), own.owners()[by_term], own.vals[by_term])
                continue
            # Two documents far apart; each goes to the half of those nearer to one of them.
            to = lambda one: norms - 2 * own_f.dot(dense(own_f, one, width))
            one = int(far.argmax())
            from_one = to(one)
            other = int(from_one.argmax())
            half = np.argpartition(from_one - to(other), len(which) // 2)
            todo += [(which[half[len(which) // 2 :]], node, 1), (which[half[: len(which) // 2]], node, 0)]

    def bounds(self, node: int, items: Rows) -> np.ndarray:
        """No document of the node has a larger inner product with the item: the centroid's, and the radius within the item's terms at most."""
        cols, centre, off = self.centre[node]
        n = len(items.start) - 1
        if not len(cols):
            return np.ones(n)
        at = np.minimum(np.searchsorted(cols, items.cols), len(cols) - 1)
        hit = np.flatnonzero(cols[at] == items.cols)
        owner, at, vals = items.owners()[hit], at[hit], items.vals[hit].astype(float)
        total = lambda x: np.bincount(owner, x, n)
        reach = np.sqrt(total(vals * vals)) * np.minimum(self.radius[node], np.sqrt(total(off[at] ** 2)))
        return (total(vals * centre[at]) + reach) * (1 + SLACK) + 1


def dense(rows: Rows, i: int, width: int) -> np.ndarray:
    out = np.zeros(width)
    out[rows.cols[rows.start[i] : rows.start[i + 1]]] = rows.vals[rows.start[i] : rows.start[i + 1]]
    return out


def scores(leaf: tuple, items: Rows) -> np.ndarray:
    """(item, document): exact whole-number scores of a leaf's documents."""
    which, distinct, start, doc, vals = leaf
    out = np.zeros((len(items.start) - 1, len(which)), np.int64)
    if not len(distinct):
        return out
    at = np.minimum(np.searchsorted(distinct, items.cols), len(distinct) - 1)
    hit = np.flatnonzero(distinct[at] == items.cols)
    size = start[at[hit] + 1] - start[at[hit]]
    ends = np.cumsum(size)
    where = np.repeat(start[at[hit]] - (ends - size), size) + np.arange(size.sum())
    np.add.at(out, (np.repeat(items.owners()[hit], size), doc[where]), np.repeat(items.vals[hit], size) * vals[where])
    return out


def search(tree: BallTree, items: Rows, floor: np.ndarray, k: int, order: np.ndarray) -> tuple[list[list[tuple]], int]:
    """The k best (-score, order of the document, document) of each item that reach its floor, and how many (item, leaf) visits that took."""
    every = np.arange(len(items.start) - 1)
    floor, rows, visits = floor.copy(), [[] for _ in every], 0
    found, level = [], [(0, every)]
    while level:
        node, some = level.pop()
        bound = tree.bounds(node, items.taken(some))
        some, bound = some[bound >= floor[some]], bound[bound >= floor[some]]
        if len(some) and node in tree.leaves:
            found.append((some, np.full(len(some), node), bound))
        elif len(some):
            level += [(kid, some) for kid in tree.kids[node]]
    if not found:
        return rows, 0
    owner, leaf, bound = (np.concatenate(x) for x in zip(*found))
    best_first = np.lexsort((-bound, owner))
    owner, leaf, bound = owner[best_first], leaf[best_first], bound[best_first]
    start, end = np.searchsorted(owner, every), np.searchsorted(owner, every, "right")
    active, turn = np.flatnonzero(end > start), 0
    while len(active):
        at = start[active] + turn
        open_ = bound[at] >= floor[active]
        active, here = active[open_], leaf[at[open_]]
        visits += len(active)
        by_leaf = np.argsort(here, kind="stable")
        for some in np.split(by_leaf, np.flatnonzero(np.diff(here[by_leaf])) + 1) if len(active) else ():
            own, asked = tree.leaves[int(here[some[0]])], active[some]
            score = scores(own, items.taken(asked))
            good = score >= floor[asked][:, None]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                q, docs = int(asked[i]), np.flatnonzero(good[i])
                mine = rows[q]
                mine += zip((-score[i, docs]).tolist(), order[own[0][docs]].tolist(), own[0][docs].tolist())
                mine.sort()
                del mine[k:]
                if len(mine) == k:
                    floor[q] = max(floor[q], -mine[-1][0])
        turn += 1
        active = active[start[active] + turn < end[active]]
    return rows, visits


FOUND = "item int, doc_id long, uid long, score long"


def _searcher(items: Rows, floors: np.ndarray, k: int, width: int):
    """For documents (shard, doc_id, uid, terms, strengths) sorted by shard: the k best of each shard for each item."""

    def found(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, uids = pa.concat_arrays([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        sizes, cols, vals = (np.concatenate([d[i] for d in docs]) for i in (2, 3, 4))
        tree = BallTree(Rows(np.concatenate(([0], np.cumsum(sizes))), cols, vals), width)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.empty(len(uids), np.int64)  # by id, a null one last, then by row
        order[np.lexsort((uids, ids.fill_null(0).to_numpy(zero_copy_only=False), null))] = np.arange(len(uids))
        for at in range(0, len(items.start) - 1, BATCH):
            some = np.arange(at, min(at + BATCH, len(items.start) - 1))
            best, _ = search(tree, items.taken(some), floors[some], k, order)
            rows = [(at + i, doc, -score) for i, own in enumerate(best) for score, _, doc in own]
            if rows:
                item, doc, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(doc)), pa.array(uids[list(doc)]), pa.array(score, pa.int64())], names=["item", "doc_id", "uid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if held and code[s] != shard:
                    yield from found(held)
                    held = []
                shard, own = code[s], b.slice(s, e - s)
                lists = own.column(3)
                held.append((own.column(1), own.column(2).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), own.column(4).flatten().to_numpy(zero_copy_only=False)))
        if held:
            yield from found(held)

    return run


def _ranked(docs: DataFrame, items: list[tuple], k: int, doc_id: str, text: str, shard_rows: int) -> DataFrame | None:
    """(item number, doc_id, uid, score, r) of one block of items (key, term counts), whose terms and weights go to every task."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in items for t in own})
    number = {t: i + 1 for i, t in enumerate(vocabulary)}
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    counted = raw.mapInArrow(_counter(number), "doc_id long, n long, terms array<int>, tfs array<long>")
    counted = stash(counted.withColumn("uid", F.monotonically_increasing_id()), "counted")
    total = counted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms").cast("long")).alias("pairs"), F.count_if(F.size("terms") > 0).alias("docs")).first()
    if not total["docs"]:
        return None
    df = {r["t"]: r["df"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the block
    weight = [math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
    rows = [sorted((number[t] - 1, weight[number[t] - 1] * c) for t, c in own.items()) for _, own in items]
    flat = [x for own in rows for x in own]
    asked = Rows(np.concatenate(([0], np.cumsum([len(own) for own in rows]))).astype(int), np.array([t for t, _ in flat], np.int32), np.array([w for _, w in flat], np.int64))
    strength = f"transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {total['N']}L) div {total['L']}L)))"
    held = counted.where(F.size("terms") > 0).select("doc_id", "uid", "terms", F.expr(strength).alias("strengths"))
    shards = max(-(-total["pairs"] // SHARD_PAIRS), -(-total["docs"] // shard_rows), min(spark.sparkContext.defaultParallelism, -(-total["docs"] // SEED_ROWS)))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")

    def searched(rows: DataFrame, shards: int, floors: np.ndarray) -> DataFrame:
        dealt = rows.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "doc_id", "uid", "terms", "strengths").repartition(shards, "shard").sortWithinPartitions("shard")
        return dealt.mapInArrow(_searcher(asked, floors, k, len(vocabulary)), FOUND).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)

    floors = np.ones(len(items), np.int64)  # a score of 0 is none
    if shards > 1:  # about SEED_ROWS documents give floors to begin with
        few = held.where(F.pmod(F.hash("uid"), F.lit(1 << 20)) < (SEED_ROWS << 20) // max(total["docs"], SEED_ROWS))
        for r in searched(few, 1, floors).where(F.col("r") == k).collect():  # a row an item of the block
            floors[r["item"]] = r["score"]
    return searched(held, shards, floors)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending doc_id.

    Null and term-less texts have no terms: such an item has no row, such a document counts nowhere. A null doc_id ranks
    after all others of its score, and of equal ids any row is first. Repeated documents and repeated items are rows of their
    own. Empty tables give no rows. Texts of any length are taken whole. Items come to the driver in blocks of ``block_bytes``
    of text, and each block reads the documents once.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item_id].dataType
    none = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    out, block, size = None, [], 0

    def answered(block: list[tuple]) -> DataFrame:
        found = _ranked(docs, block, k, doc_id, text, shard_rows)
        if found is None:
            return none
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        return found.join(F.broadcast(names), "item").select("item_id", F.col("r").cast("int").alias("rank"), "doc_id", "score")  # a row an item of the block

    for r in rows.toLocalIterator(prefetchPartitions=True):
        own = Counter()
        for some in terms(bytes(r["text"])):
            own.update(some)
        if not own:
            continue
        block.append((r["item_id"], own))
        size += len(r["text"])
        if size >= block_bytes:
            part, block, size = answered(block), [], 0
            out = part if out is None else out.unionAll(part)
    if block:
        part = answered(block)
        out = part if out is None else out.unionAll(part)
    return none if out is None else out


def query(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents where text is not null),
b as (select row_number() over () i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from benchmark where text is not null),
s as (select count(*) n_all, cast(sum(len(ts)) as bigint) l_all from d where len(ts) > 0),
tf as (select r, doc_id, n, t, count(*) tf from (select r, doc_id, len(ts) n, unnest(ts) t from d) group by all),
w as (select t, cast(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) as bigint) w from tf, s group by t, n_all),
q as (select i, item_id, t, count(*) c from (select i, item_id, unnest(ts) t from b) group by all),
p as (select q.i, q.item_id, tf.r, tf.doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)))) as bigint) score
 from q join tf on q.t = tf.t join w on w.t = q.t, s group by all)
select item_id, cast(rank as integer) rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id nulls last, r) rank from p where score > 0) where rank <= 20
"""
