"""Exact top-k inner product search over KD-trees.

Rows are dealt into shards of bounded size by a hash, one more job deals the queries to every shard, and a task builds a
shard's KD-tree once (median splits of the widest dimension down to small leaves, each node with a tight bounding box) and
then streams all queries past it. Batches of queries descend the tree together: a query leaves a node whose box allows no
score above its kth best so far. The leaves that it reaches are visited best first, by the largest inner product that the
leaf's box allows, until that bound falls below the kth score. The kth score starts from the query's best in one small
seed shard. A shard gives its k best rows a query, and a window keeps the k best of all. What moves between machines is
each row once, and the queries, a fixed fraction of the rows, once a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import ship, stash, table

#: Rows of a shard at most, of a leaf, of the seed shard, and queries that descend a tree together.
SHARD_ROWS, LEAF_ROWS, SEED_ROWS, QUERY_BATCH = 65_536, 128, 2048, 2048


class Tree:
    """A KD-tree over integer vectors: nodes with bounding boxes and two children, and leaves with rows."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.low, self.high, self.children, self.leaves = [], [], [], {}
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node, own = len(self.low), points[rows]
            if parent >= 0:
                self.children[parent][side] = node
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.children.append([-1, -1])
            if len(rows) <= leaf_rows:
                self.leaves[node] = (uids[rows], ids[rows], np.ascontiguousarray(own))
                continue
            widest = int((self.high[-1] - self.low[-1]).argmax())
            half = np.argpartition(own[:, widest], len(rows) // 2)
            todo += [(rows[half[len(rows) // 2 :]], node, 1), (rows[half[: len(rows) // 2]], node, 0)]
        self.low, self.high, self.children = np.array(self.low), np.array(self.high), np.array(self.children)

    def reached(self, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, bound): leaves whose box, and the boxes above it, allow a score of the query's floor or more.

        The bound is the largest inner product of the query with any point of the box.
        """
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        found, level = [], [(0, np.arange(len(queries)))]
        while level:
            node, some = level.pop()
            bound = plus[some] @ self.high[node] + minus[some] @ self.low[node]
            open_ = bound >= floor[some]
            some, bound = some[open_], bound[open_]
            if not len(some):
                continue
            if node in self.leaves:
                found.append((some, np.full(len(some), node), bound))
            else:
                level += [(int(child), some) for child in self.children[node]]
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, queries.dtype)
        return tuple(np.concatenate(x) for x in zip(*found))


class Best:
    """The k best (score, id, uid) of each query, and the score that a row must reach to matter."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        rows = self.rows[q]
        rows += zip((-scores).tolist(), ids.tolist(), uids.tolist())
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k:
            self.floor[q] = max(self.floor[q], -rows[-1][0])


def search(tree: Tree, uids: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Visit leaves best first; each round every query still open visits its next leaf, and queries at one leaf go together.

    The result is the number of (query, leaf) visits.
    """
    owner, leaf, bound = tree.reached(queries, best.floor)
    order = np.lexsort((-bound, owner))
    owner, leaf, bound = owner[order], leaf[order], bound[order]
    starts = np.searchsorted(owner, np.arange(len(queries)))
    ends = np.searchsorted(owner, np.arange(len(queries)), "right")
    active, turn, visits = np.flatnonzero(ends > starts), 0, 0
    while len(active):
        at = starts[active] + turn
        open_ = bound[at] >= best.floor[active]
        active, at = active[open_], at[open_]
        visits += len(active)
        here = leaf[at]
        by_leaf = np.argsort(here, kind="stable")
        for some in np.split(by_leaf, np.flatnonzero(np.diff(here[by_leaf])) + 1) if len(active) else ():
            own_uids, own_ids, points = tree.leaves[int(here[some[0]])]
            qs = active[some]
            scores = queries[qs] @ points.T
            good = (scores >= best.floor[qs, None]) & (own_uids[None, :] != uids[qs, None])
            for row in np.flatnonzero(good.any(axis=1)).tolist():
                cols = np.flatnonzero(good[row])
                best.add(int(qs[row]), scores[row, cols], own_ids[cols], own_uids[cols])
        turn += 1
        active = active[starts[active] + turn < ends[active]]
    return visits


def _kind(bound: int) -> type:
    """The cheapest number type in which inner products up to ``bound`` are exact."""
    if bound >= 1 << 63:
        raise OverflowError(f"inner products of these vectors may reach {bound}, beyond 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


FOUND = "query_uid long, vec_id long, uid long, score long"
_FOUND = ("query_uid", "vec_id", "uid", "score")


def _searcher(k: int, kind: type):
    """For rows sorted by (shard, side): a shard's own rows, side 0, then the queries, side 1, with the score to reach (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        shard, held, tree = None, [], None
        for whole in batches:
            for b in _runs(whole):
                key, side = b.column(0)[0].as_py(), b.column(1)[0].as_py()
                if key != shard:
                    shard, held, tree = key, [], None
                uids, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                points = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(kind)
                if side == 0:
                    held.append((uids, ids, points))
                    continue
                if tree is None and held:
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held))), []
                if tree is None:
                    continue
                least = b.column(5)
                floor = np.where(least.is_valid().to_numpy(zero_copy_only=False), least.fill_null(0).to_numpy(zero_copy_only=False), lowest).astype(kind)
                best = Best(len(uids), k, floor)
                search(tree, uids, points, best)
                rows = [(int(uids[q]), i, u, int(-s)) for q, own in enumerate(best.rows) for s, i, u in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list(_FOUND))

    return run


def _runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one shard and side; those of queries hold QUERY_BATCH rows at most."""
    if not b.num_rows:
        return
    code = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
    cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
    for s, e in zip(cuts, cuts[1:]):
        for at in range(s, e, QUERY_BATCH):
            yield b.slice(at, min(QUERY_BATCH, e - at))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(uid, vec_id, dims, v): integer vectors of the rows that take part.

    Rows with a null id, a null or empty vector, or a null, NaN or infinite component take no part.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dims"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def _searched(data: DataFrame, queries: DataFrame, shards: int, k: int, kind: type) -> DataFrame:
    """The k best rows of each shard for each query dealt to it. Both sides are dealt by shard, and a task sees one shard at a time."""
    both = data.withColumn("least", F.lit(None).cast("long")).withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)))
    dealt = both.select("shard", "side", "uid", "vec_id", "v", "least").repartition(shards, "shard").sortWithinPartitions("shard", "side")
    return dealt.mapInArrow(_searcher(k, kind), FOUND)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the same length but the query's
    own. Repeated rows are rows of their own, both as queries and as candidates, and of equal scores and ids any comes
    first. Fewer candidates give fewer rows; an empty table gives none. Vectors whose inner products may not fit 64 bits
    raise OverflowError. ``shard_rows`` bounds what a task holds; small tables are cut finer, so that all cores have work.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stash(quantised(vectors, id_col, vector_col).repartition("uid"), "vectors")
    asked = F.col("vec_id") % every == 0
    shape = rows.groupBy("dims").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))).alias("most"), F.sum(asked.cast("long")).alias("queries"), F.count(F.lit(1)).alias("n"))
    found = None
    for r in shape.orderBy("dims").collect():  # a row a length of vectors, nearly always one
        if not r["queries"]:
            continue
        own = rows.where(F.col("dims") == r["dims"]).select("uid", "vec_id", "v")
        kind = _kind(int(r["dims"]) * int(r["most"]) ** 2)
        shards = max(-(-r["n"] // shard_rows), min(spark.sparkContext.defaultParallelism, -(-r["n"] // (2 * SEED_ROWS))))
        data = own.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
        # The seed: about SEED_ROWS rows, a fixed number, met by the queries in as many tasks as they fill batches.
        groups = -(-r["queries"] // QUERY_BATCH)
        every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        few = own.where(F.pmod(F.hash("uid"), F.lit(1 << 20)) < (SEED_ROWS << 20) // max(r["n"], SEED_ROWS)).withColumn("shard", every_group)
        queries = own.where(asked)
        seeds = _searched(few, queries.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(groups))).withColumn("least", F.lit(None).cast("long")), groups, k, kind)
        floors = seeds.groupBy("query_uid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_uid").alias("uid"), "least")
        floors = stash(floors, "floors")
        every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
        part = _searched(data, queries.join(floors, "uid", "left").withColumn("shard", every_shard), shards, k, kind)
        part = part.join(queries.select(F.col("uid").alias("query_uid"), F.col("vec_id").alias("query_id")), "query_uid")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.r, q.vec_id query_id, c.vec_id, c.r cr, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) rank, vec_id, score from
 (select *, row_number() over (partition by r order by score desc, vec_id, cr) rank from p) where rank <= 5
"""
