"""Approximate nearest neighbours by cosine: low-dimensional stable projections in kd-trees, and a chi-square stopping test.

Vectors of unit length are projected by a few Gaussian (2-stable) directions. The squared projected distance of two vectors,
divided by their squared distance, is chi-square distributed with as many degrees of freedom as there are directions.
Neighbours in the projected space come in increasing distance from a kd-tree and are verified on the original vectors, until
a vector as near as the kth best found so far would have shown up already with probability CONFIDENCE.

Equal vectors are one row with their k + 1 smallest ids, more than any answer can name, so a vector that a third of all rows
hold is one point, and one question. Distinct vectors are dealt into shards of bounded bytes by a hash; each distinct asked
vector visits each shard with the kth distance that it reached in a small seed shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import hot_keys, join_salted, ship, stash, table
from recordmill.operators.ranks import chi2_tail

#: Directions (an even number), the stopping test's probability, and the seed of the directions.
DIRECTIONS, CONFIDENCE, SEED = 12, 0.985, 7
#: Bytes of a shard's vectors as doubles, rows of a leaf and of the seed shard, questions that descend a tree together.
SHARD_BYTES, LEAF_ROWS, SEED_ROWS, BATCH = 32 << 20, 64, 2048, 256
#: Squared distances of unit vectors below this count as rounding.
ROUNDING = 1e-9


def stopping_ratio(directions: int, confidence: float) -> float:
    """The squared projected distance, over the squared distance, that a share ``confidence`` of all pairs stays within."""
    low, high = 0.0, 1.0
    while chi2_tail(high, directions) > 1 - confidence:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, directions) > 1 - confidence else (low, mid)
    return high


def directions(dims: int, m: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, m))


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows scaled by powers of two into [0.5, 1), their lengths, rows of length 1): nothing overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    length = np.sqrt((v * v).sum(axis=1))
    return v, length, v / length[:, None]


class Tree:
    """A kd-tree over projected points: median splits of the widest dimension, a tight box for each node."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.low, self.high, self.kids, self.leaves = points, [], [], [], {}
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node, own = len(self.low), points[rows]
            if parent >= 0:
                self.kids[parent][side] = node
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.kids.append([-1, -1])
            if len(rows) <= leaf_rows:
                self.leaves[node] = rows
                continue
            half = np.argpartition(own[:, int((self.high[-1] - self.low[-1]).argmax())], len(rows) // 2)
            todo += [(rows[half[len(rows) // 2 :]], node, 1), (rows[half[: len(rows) // 2]], node, 0)]

    def reached(self, asked: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, leaf, squared distance of its box) of the leaves within a squared distance of each question."""
        found, level = [], [(0, np.arange(len(asked)))]
        while level:
            node, some = level.pop()
            gap = np.maximum(0, np.maximum(self.low[node] - asked[some], asked[some] - self.high[node]))
            far = (gap * gap).sum(axis=1)
            some, far = some[far <= within[some]], far[far <= within[some]]
            if len(some) and node in self.leaves:
                found.append((some, np.full(len(some), node), far))
            elif len(some):
                level += [(kid, some) for kid in self.kids[node]]
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


class Shard:
    def __init__(self, v: np.ndarray, ids: list[list[tuple]], ratio: float, k: int, turn: np.ndarray):
        tree = Tree(unit(v)[2] @ turn)
        # A leaf's rows lie side by side.
        order = np.concatenate(list(tree.leaves.values()))
        sizes = [len(rows) for rows in tree.leaves.values()]
        self.place = dict(zip(tree.leaves, zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))))
        self.v, self.length, _ = unit(v[order])
        self.points = tree.points[order]
        self.square = (self.points**2).sum(axis=1)
        self.tree, self.ids, self.ratio, self.k, self.turn = tree, [ids[i] for i in order.tolist()], ratio, k, turn
        self.verified = 0

    def within(self, kth: np.ndarray | float) -> np.ndarray | float:
        """The stopping test: whatever lies further in the projection is further away than the kth best, but for the doubt left."""
        return self.ratio * np.maximum(0, 2 - 2 * kth) + ROUNDING

    def search(self, v: np.ndarray, least: np.ndarray) -> list[list[tuple]]:
        """The ``k`` best rows (-score, vec_id, uid) found for each question; ``least`` is the score that its kth row reaches elsewhere."""
        v, length, u = unit(v)
        asked = u @ self.turn
        owner, leaf, far = self.tree.reached(asked, self.within(least))
        order = np.lexsort((far, owner))
        owner, leaf, far = owner[order], leaf[order], far[order]
        cuts = np.searchsorted(owner, np.arange(len(v) + 1))
        return [self._one(v[i], length[i], asked[i], least[i], leaf[s:e], far[s:e]) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]

    def _one(self, v: np.ndarray, length: float, asked: np.ndarray, kth: float, leaf: np.ndarray, far: np.ndarray) -> list[tuple]:
        """Leaves by increasing distance, a few at first and then twice as many each time."""
        best, at, step = [], 0, 4
        while at < len(leaf) and far[at] <= self.within(kth):
            some = leaf[at : at + step][far[at : at + step] <= self.within(kth)]
            own = np.concatenate([np.arange(*self.place[x]) for x in some.tolist()])
            near = own[self.square[own] - 2 * (self.points[own] @ asked) + asked @ asked <= self.within(kth)]
            self.verified += len(near)
            score = (self.v[near] * v).sum(axis=1) / (length * self.length[near])
            good = score >= kth
            if good.sum() > self.k:  # so many, but for ties, reach the best
                good &= score >= np.partition(score[good], -self.k)[-self.k]
            for j in np.flatnonzero(good).tolist():
                best += [(-float(score[j]), *who) for who in self.ids[near[j]]]
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                kth = max(kth, -best[-1][0])
            at, step = at + step, 2 * step
        return best


FOUND = "a long, b long, vec_id long, uid long, score double"


def _searcher(k: int, ratio: float, turn: np.ndarray):
    """For rows sorted by (shard, side): a shard's distinct vectors, side 0, then the questions, side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, shard = None, [], [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            code = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), whole.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if code[s, 0] != key:
                    key, held, ids, shard = code[s, 0], [], [], None
                for at in range(s, e, BATCH):
                    b = whole.slice(at, min(BATCH, e - at))
                    v = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                    if code[s, 1] == 0:
                        held.append(v)
                        ids += [[(x["vec_id"], x["uid"]) for x in row] for row in b.column(5).to_pylist()]
                        continue
                    if shard is None and held:
                        shard, held = Shard(np.concatenate(held), ids, ratio, k, turn), []
                    if shard is None:
                        continue
                    least = b.column(6).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    found = shard.search(v, least)
                    codes = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
                    rows = [(*codes[i], vec_id, uid, -score) for i, own in enumerate(found) for score, vec_id, uid in own]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["a", "b", "vec_id", "uid", "score"])

    return run


def _searched(data: DataFrame, asked: DataFrame, shards: int, k: int, ratio: float, turn: np.ndarray) -> DataFrame:
    both = data.select("shard", F.lit(0).alias("side"), "a", "b", "v", "ids", F.lit(None).cast("double").alias("least"))
    both = both.unionByName(asked.select("shard", F.lit(1).alias("side"), "a", "b", "v", F.lit(None).cast(data.schema["ids"].dataType).alias("ids"), "least"))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(_searcher(k, ratio, turn), FOUND)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, m: int = DIRECTIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the same length but the query's own.
    Each of a query's true neighbours is found with a probability of at least ``confidence``, whatever the data; the scores
    are exact. Rows with a null id, and vectors that are null, empty, zero or hold a null, NaN or infinite component, take no part. Repeated rows are
    rows of their own. Fewer candidates give fewer rows, and an empty table none.
    """
    spark = vectors.sparkSession
    ship(spark)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    # Two 64-bit hashes with different beginnings tell distinct vectors apart.
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = stash(rows.select("uid", "vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(SEED), F.size("v"), "v").alias("b"), "v"), "vectors")
    first = Window.partitionBy("a", "b").orderBy("vec_id", "uid")
    few = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k + 1)
    distinct = stash(few.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("ids")), "distinct")
    wanted = rows.where(F.col("vec_id") % every == 0).groupBy("a", "b").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    wanted = stash(wanted, "asked")
    shape = distinct.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).join(wanted.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("asked")), "dims")
    found = None
    for r in shape.orderBy("dims").collect():  # a row a length of vectors, nearly always one
        n, ratio, turn = r["n"], stopping_ratio(m, confidence), directions(r["dims"], m)
        own, ask = distinct.where(F.size("v") == r["dims"]), wanted.where(F.size("v") == r["dims"])
        shards = max(-(-n * r["dims"] * 8 // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // (2 * SEED_ROWS))))
        groups = -(-r["asked"] // (8 * BATCH))
        deal = lambda shards: F.pmod(F.xxhash64("b", "a"), F.lit(shards))
        all_of = lambda shards: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
        seed = own.where(F.pmod(F.xxhash64("a"), F.lit(1 << 20)) < (SEED_ROWS << 20) // max(n, SEED_ROWS)).withColumn("shard", all_of(groups))
        first_ones = stash(_searched(seed, ask.withColumn("shard", deal(groups)).withColumn("least", F.lit(None).cast("double")), groups, k + 1, ratio, turn), "seeds")
        least = first_ones.groupBy("a", "b").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > k).drop("__n")
        ask = ask.join(least, ["a", "b"], "left").withColumn("shard", all_of(shards))
        part = _searched(own.withColumn("shard", deal(shards)), ask, shards, k + 1, ratio, turn).unionAll(first_ones)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return none
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id", "uid")
    found = found.groupBy("a", "b", "vec_id", "uid").agg(F.max("score").alias("score"))  # the seed shard's rows lie in another one too
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "uid", "score"))).alias("top"))
    asked = rows.where(F.col("vec_id") % every == 0).select("a", "b", F.col("vec_id").alias("query_id"), F.col("uid").alias("query_uid"))
    told = join_salted(asked, top, ["a", "b"], hot_keys(wanted, "n"), ["query_uid"])
    told = told.select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["uid"] != F.col("query_uid")), 1, k)).alias("rank", "x"))
    return told.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
