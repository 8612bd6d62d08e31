"""Nearest-neighbour counts of classes along one axis, range by range.

Values are cut into ranges by bounds read off a sample; only the bounds rest on it, every value is counted. Tasks send
their values to the ranges as packed arrays. A range is one row, sorted; it borrows the nearest values of each class from the ranges beside it,
so radii are found without another move. The few intervals that reach into another range ask there for its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.operators.selection import numbered
from recordmill.operators.shared import range_bounds, stash

EULER = 0.5772156649015329  # fixed value
#: Points of a range, and values that a task sorts at a time.
RANGE_POINTS, HELD_VALUES = 500_000, 4_000_000


def digamma(n: Column) -> Column:
    """psi of a positive integer: exact sums of reciprocals to 8, beyond that the asymptotic series, exact to a double."""
    small = F.lit(-EULER)
    for i in range(1, 8):
        small = small + F.when(n > i, 1.0 / i).otherwise(0.0)
    x = n.cast("double")
    y = 1 / (x * x)
    large = F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return F.when(n <= 8, small).otherwise(large)


def _psi(n: np.ndarray) -> np.ndarray:
    """digamma on arrays."""
    small = np.cumsum([-EULER, *[1.0 / i for i in range(1, 8)]])
    x = np.maximum(n, 1).astype(float)
    y = 1 / (x * x)
    large = np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return np.where(n <= 8, small[np.clip(n, 1, 8) - 1], large)


def _summed(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points sorted by value and class, equal ones added up."""
    order = np.lexsort((c, x))
    x, c, w = x[order], c[order], w[order]
    start = np.flatnonzero(np.concatenate(([True], ((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))) | (c[1:] != c[:-1])))) if len(x) else np.zeros(0, int)
    return x[start], c[start], np.add.reduceat(w, start) if len(x) else w


def _packed(sizes: np.ndarray, bounds: list[np.ndarray]):
    """(class, columns) to (part, x, c, w): a range's values of each class with their weights, as they are met. ``sizes`` is (class, column)."""
    first = np.cumsum([0, *[len(b) + 1 for b in bounds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            held.clear()
            group = whole.column(0).to_numpy()
            members = {g: group == g for g in np.unique(group).tolist()}
            for j, cuts in enumerate(bounds):
                column = whole.column(j + 1)
                v = column.to_numpy() + 0.0
                valid = column.is_valid().to_numpy() if column.null_count else None
                some = []
                for g, own in members.items():
                    if sizes[g, j] > 1:
                        x, w = np.unique(v[own if valid is None else own & valid], return_counts=True)
                        some.append((x, np.full(len(x), g, np.int32), w.astype(np.int64)))
                if not some:
                    continue
                x, c, w = (np.concatenate(s) for s in zip(*some))
                part = np.searchsorted(cuts, x, "right")
                order = np.argsort(part, kind="stable")
                x, c, w, part = x[order], c[order], w[order], part[order]
                ends = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(x)]
                spans = [(s, e) for s, e in zip(ends, ends[1:]) if e > s]
                columns = [pa.array([first[j] + part[s] for s, _ in spans], pa.int32())]
                columns += [pa.array([a[s:e].tobytes() for s, e in spans], pa.binary()) for a in (x, c, w)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "x", "c", "w"])

        values = 0
        for b in batches:
            held.append(b)
            values += b.num_rows * len(bounds)
            if values >= HELD_VALUES:
                yield from told()
                values = 0
        if held:
            yield from told()

    return run


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b.column(name)[i].as_buffer(), kind) for name, kind in (("x", np.float64), ("c", np.int32), ("w", np.int64)))


def _ranges(k: int):
    """Packed pieces sorted by part to a row a range: sorted points, their number, the first value, and each class's first and last k values."""

    def told(part: int, pieces: list[tuple]) -> pa.RecordBatch:
        x, c, w = _summed(*(np.concatenate(p) for p in zip(*pieces)))
        ends = []
        for g in np.unique(c).tolist():
            own = np.flatnonzero(c == g)
            head, tail = own[:k], own[-k:]
            ends.append({"c": g, "head": np.repeat(x[head], np.minimum(w[head], k))[:k].tolist(), "tail": np.repeat(x[tail], np.minimum(w[tail], k))[-k:].tolist()})
        columns = [pa.array([part], pa.int32()), pa.array([int(w.sum())]), pa.array([float(x[0])]), *[pa.array([a.tobytes()], pa.binary()) for a in (x, c, w)]]
        columns.append(pa.array([ends], pa.list_(pa.struct([("c", pa.int32()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))]))))
        return pa.RecordBatch.from_arrays(columns, names=["part", "n", "first", "x", "c", "w", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, points = None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                if (part := b.column(0)[i].as_py()) != at:
                    if pieces:
                        yield told(at, pieces)
                    at, pieces, points = part, [], 0
                pieces.append(_unpacked(b, i))
                points += len(pieces[-1][0])
                if points > 4 * RANGE_POINTS:  # a value that many rows share comes in many pieces
                    pieces = [_summed(*(np.concatenate(p) for p in zip(*pieces)))]
                    points = 0
        if pieces:
            yield told(at, pieces)

    return run


RANGES = "part int, n long, first double, x binary, c binary, w binary, ends array<struct<c:int,head:array<double>,tail:array<double>>>"
COUNTS = "f int, n long, a double, b double, d double, point long, weight long, known long, part int, at double, upper boolean"


class _Places:
    """What a task knows of all ranges: of each feature the parts, their first values and the points before them; each class's k values beside each part."""

    def __init__(self, summary: list, feature: list[int], k: int):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.feature, self.total = {}, {}
        self.beside: dict[int, dict[int, tuple[list[float], list[float]]]] = {}
        of: dict[int, list] = {}
        for s in summary:
            self.feature[s["part"]] = feature[s["part"]]
            of.setdefault(feature[s["part"]], []).append(s)
        for f, own in of.items():
            n = np.array([s["n"] for s in own])
            self.parts[f] = np.array([s["part"] for s in own]), np.array([s["first"] for s in own]), np.cumsum(n) - n
            self.total[f] = int(n.sum())
            for side, walk in ((0, own), (1, own[::-1])):
                near: dict[int, list[float]] = {}
                for s in walk:
                    for e in s["ends"]:
                        g = e["c"]
                        self.beside.setdefault(s["part"], {}).setdefault(g, ([], []))[side].extend(near.get(g, ()))
                        near[g] = (near.get(g, []) + e["tail"])[-k:] if side == 0 else (e["head"] + near.get(g, []))[:k]


def _counted(places: _Places, sizes: np.ndarray, k: int):
    """A range to its sums of psi, and the points of which an interval's end lies in another range, with what is to be asked there."""

    def radii(part: int, f: int, x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        radius, size = np.empty(len(x)), np.empty(len(x), np.int64)
        for g, (before, after) in places.beside[part].items():
            own = np.flatnonzero(c == g)
            copies = np.minimum(w[own], k + 1)
            line = np.concatenate([np.full(k, np.nan), before, np.repeat(x[own], copies), after, np.full(k, np.nan)])
            at = k + len(before) + np.cumsum(copies) - copies
            gaps = np.sort(np.abs(np.column_stack([line[at + i] - x[own] for i in range(-k, k + 1) if i])), axis=1)  # NaN, beyond the last value, comes last
            size[own] = sizes[g, f]
            radius[own] = gaps[:, min(k, int(sizes[g, f]) - 1) - 1]
        return radius, np.minimum(k, size - 1), size

    def told(part: int, x: np.ndarray, c: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        f = places.feature[part]
        parts, firsts, starts = places.parts[f]
        mine = int(np.searchsorted(parts, part))
        with np.errstate(invalid="ignore"):
            radius, few, size = radii(part, f, x, c, w)
            low, high = x - radius, x + radius
        upto = np.concatenate(([0], np.cumsum(w)))
        # Points below the upper end less those up to the lower end. Each end lies in the last range that begins before it.
        top, bottom = np.searchsorted(firsts, high, "left") - 1, np.searchsorted(firsts, low, "right") - 1
        endless = np.isnan(high)
        above = np.where(endless, places.total[f], starts[mine] + upto[np.searchsorted(x, high, "left")])
        below = np.where(bottom < 0, 0, starts[mine] + upto[np.searchsorted(x, low, "right")])
        ask_top, ask_bottom = (top != mine) & ~endless & (top >= 0), (bottom != mine) & (bottom >= 0) & ~np.isnan(low)
        above = np.where(ask_top | ((top < 0) & ~endless), 0, above)
        below = np.where(ask_bottom, 0, np.where(np.isnan(low), places.total[f], below))
        asks = ask_top | ask_bottom
        m = np.maximum(above - below, 1)
        sums = [int(w.sum()), float(_psi(few) @ w), float(_psi(size) @ w), float(_psi(m[~asks]) @ w[~asks])]
        point = (part << 32) + np.flatnonzero(asks)
        rows = {name: [None] for name in ("point", "weight", "known", "part", "at", "upper")}
        rows["point"] += point.tolist()
        rows["weight"] += w[asks].tolist()
        rows["known"] += (above - below)[asks].tolist()
        for name in ("part", "at", "upper"):
            rows[name] += [None] * len(point)
        for asked, ends, where, upper in ((ask_top, high, top, True), (ask_bottom, low, bottom, False)):
            rows["point"] += ((part << 32) + np.flatnonzero(asked)).tolist()
            rows["part"] += parts[where[asked]].tolist()
            rows["at"] += ends[asked].tolist()
            rows["upper"] += [upper] * int(asked.sum())
            for name in ("weight", "known"):
                rows[name] += [None] * int(asked.sum())
        n = len(rows["point"])
        kinds = dict(point=pa.int64(), weight=pa.int64(), known=pa.int64(), part=pa.int32(), at=pa.float64(), upper=pa.bool_())
        columns = [pa.array([f] * n, pa.int32()), *[pa.array([s] + [None] * (n - 1), t) for s, t in zip(sums, (pa.int64(), *[pa.float64()] * 3))], *[pa.array(rows[r], t) for r, t in kinds.items()]]
        return pa.RecordBatch.from_arrays(columns, names=["f", "n", "a", "b", "d", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield told(b.column(0)[i].as_py(), *_unpacked(b, i))

    return run


def _asked(places: _Places):
    """(part, x, w, asked) to (point, known): how many points lie below an upper end, or, as a negative number, up to a lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.column(0)[i].as_py()
                x, w = np.frombuffer(b.column(1)[i].as_buffer(), np.float64), np.frombuffer(b.column(2)[i].as_buffer(), np.int64)
                parts, _, starts = places.parts[places.feature[part]]
                upto = int(starts[np.searchsorted(parts, part)]) + np.concatenate(([0], np.cumsum(w)))
                asked = b.column(3)[i].values
                at, upper = asked.field("at").to_numpy(), asked.field("upper").to_numpy(zero_copy_only=False)
                known = np.where(upper, upto[np.searchsorted(x, at, "left")], -upto[np.searchsorted(x, at, "right")])
                yield pa.RecordBatch.from_arrays([asked.field("point"), pa.array(known)], names=["point", "known"])

    return run


def estimates(df: DataFrame, target: str, columns: list[str], k: int, sizes: list) -> DataFrame:
    """(f, mutual_info) of the columns, by position, against the class; ``df`` has no row without one, and null values are left out.

    ``sizes`` has a row for each class, few: the class, then how many values each column has. A class with one value of a column is passed over.
    """
    spark, p = df.sparkSession, len(columns)
    codes = spark.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], T.StructType([T.StructField("__k0", df.schema[target].dataType), T.StructField("__c", T.IntegerType())]))
    count = np.array([[x or 0 for x in r[1:]] for r in sizes], np.int64).reshape(-1, p)
    bounds = range_bounds(df, columns, np.where(count > 1, count, 0).sum(axis=0).tolist(), RANGE_POINTS)
    feature = [f for f, b in enumerate(bounds) for _ in range(len(b) + 1)]
    rows = numbered(df, codes, [target], "__c").select("__c", *columns)
    pieces = rows.mapInArrow(_packed(count, bounds), "part int, x binary, c binary, w binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, as little data is much work here
    held = stash(pieces.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_ranges(k), RANGES), "ranges")
    # A row for each range: 2k values a class.
    places = _Places(held.select("part", "n", "first", "ends").orderBy("part").collect(), feature, k)
    told = stash(held.select("part", "x", "c", "w").mapInArrow(_counted(places, count, k), COUNTS), "counts")
    # At most about 2k points a range, class and side reach into another range.
    asks = told.where("part is not null").groupBy("part").agg(F.collect_list(F.struct("at", "upper", "point")).alias("asked"))
    known = held.select("part", "x", "w").join(F.broadcast(asks), "part").select("part", "x", "w", "asked").mapInArrow(_asked(places), "point long, known long")
    points = told.where("weight is not null").select("f", "point", "weight", "known")
    met = points.select("point", "known").unionAll(known).groupBy("point").agg(F.greatest(F.sum("known"), F.lit(1)).alias("m"))
    rest = points.drop("known").join(met, "point").groupBy("f").agg(F.sum(digamma(F.col("m")) * F.col("weight")).alias("d"))
    every = told.where("n is not null").select("f", "n", "a", "b", "d").unionByName(rest, allowMissingColumns=True)
    out = every.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "d")])
    mean = lambda c: F.col(c) / F.col("n")
    return out.select("f", F.greatest(F.lit(0.0), digamma(F.col("n")) + mean("a") - mean("b") - mean("d")).alias("mutual_info"))
