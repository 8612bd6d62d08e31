"""Average ranks of many columns, row by row, without joining ranks back to rows.

Columns of few distinct values take their ranks from a dictionary of checked size that goes to every task. For the others a
piece of rows sends its distinct values with their counts to ranges, packed, and gets their ranks back in the same order.
A value that many rows share is one entry of a piece, so that none is bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.operators.shared import range_bounds, stash

#: Distinct values of a column, and of all columns, that a dictionary holds; the power of two of a piece's rows, at most; rows of a range.
FEW, ENTRIES, TILE_BITS, RANGE_ROWS = 65_536, 2_000_000, 18, 1_000_000
#: Rows that are tallied, or given out, at a time.
HELD_ROWS, OUT_ROWS = 65_536, 16_384


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(values, return_inverse=True)
    return values, np.bincount(at, counts, len(values)).astype(np.int64)


class _Tally:
    """How often each value of a column occurs, given up once there are more than ``few``."""

    def __init__(self, few: int):
        self.few, self.values, self.counts = few, np.zeros(0), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        if self.values is not None:
            self.values, self.counts = _summed(np.concatenate([self.values, values]), np.concatenate([self.counts, counts]))
            if len(self.values) > self.few:
                self.values = self.counts = None


def _tallied(tallies: dict[int, _Tally]) -> pa.RecordBatch:
    columns = [pa.array(list(tallies), pa.int32())]
    for name, kind in (("values", pa.float64()), ("counts", pa.int64())):
        columns.append(pa.array([None if t.values is None else getattr(t, name) for t in tallies.values()], pa.list_(kind)))
    return pa.RecordBatch.from_arrays(columns, names=["f", "values", "counts"])


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _tally(few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Tally] = {}
        for b in _gathered(batches, HELD_ROWS):
            for f, c in enumerate(b.columns):
                own = held.setdefault(f, _Tally(few))
                if own.values is not None:
                    v = c.to_numpy()
                    own.add(*np.unique(v[~np.isnan(v)] + 0.0, return_counts=True))
        if held:
            yield _tallied(held)

    return run


def _merged_tally(few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, own = None, None
        for b in batches:
            for i in range(b.num_rows):
                if (mine := b.column(0)[i].as_py()) != f:
                    if f is not None:
                        yield _tallied({f: own})
                    f, own = mine, _Tally(few)
                values, counts = b.column(1)[i], b.column(2)[i]
                if not values.is_valid:
                    own.values = own.counts = None
                else:
                    own.add(values.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False))
        if f is not None:
            yield _tallied({f: own})

    return run


def dictionaries(rows: DataFrame, features: list[str], few: int = FEW, entries: int = ENTRIES) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(values, average ranks) of the features, by position, that have at most ``few`` distinct values; the smallest first while all hold ``entries`` at most."""
    schema = "f int, values array<double>, counts array<long>"
    parts = rows.select(*features).mapInArrow(_tally(few), schema)
    found = parts.repartition("f").sortWithinPartitions("f").mapInArrow(_merged_tally(few), schema).where("values is not null").withColumn("size", F.size("values"))
    found, out, total = stash(found, "tallies"), {}, 0
    chosen = []
    for r in found.select("f", "size").orderBy("size").collect():  # a row a feature
        total += r["size"]
        if total <= entries:
            chosen.append(r["f"])
    for r in found.where(F.col("f").isin(chosen)).collect() if chosen else ():
        counts = np.array(r["counts"])
        out[r["f"]] = (np.array(r["values"]), np.cumsum(counts) - (counts - 1) / 2)
    return out


def _looked_up(known: dict[int, tuple[np.ndarray, np.ndarray]]):
    """A batch (row, the features of ``known`` in order) to (row, their ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = [np.append(r, np.nan)[np.searchsorted(v, c.to_numpy(zero_copy_only=False))] for c, (v, r) in zip(b.columns[1:], known.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(r, from_pandas=True) for r in ranks]], names=["__row", *[f"r{f}" for f in known]])

    return run


def _pieces(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(the first row's number, columns) of consecutive rows whose numbers share all but the last ``bits``."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        tile = columns[0] >> bits
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if held and held[0][0][0] >> bits != tile[s]:
                yield int(held[0][0][0]), [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append([c[s:e] for c in columns])
    if held:
        yield int(held[0][0][0]), [np.concatenate(c) for c in zip(*held)]


def _distinct(v: np.ndarray) -> np.ndarray:
    return np.unique(v[~np.isnan(v)] + 0.0)


def _sent(bounds: list[np.ndarray], bits: int):
    """(row, columns) to (part, piece, v, n): a piece's distinct values that lie in a range, ascending, and how often each occurs."""
    first = np.cumsum([0, *[len(b) + 1 for b in bounds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, columns in _pieces(batches, bits):
            for j, (cuts, c) in enumerate(zip(bounds, columns[1:])):
                v, n = np.unique(c[~np.isnan(c)] + 0.0, return_counts=True)
                ends = [0, *np.searchsorted(v, cuts, "left").tolist(), len(v)]
                spans = [(i, s, e) for i, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
                if spans:
                    told = [pa.array([first[j] + i for i, _, _ in spans], pa.int32()), pa.array([piece] * len(spans), pa.int64())]
                    told += [pa.array([a[s:e].tobytes() for _, s, e in spans], pa.binary()) for a in (v, n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(told, names=["part", "piece", "v", "n"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's values, sorted by part, to (part, piece, n, ranks): average ranks within the range, piece by piece in the order that it sent; n is the range's rows."""

    def told(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        v, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([h[2] for h in held]), len(v)).astype(np.int64)
        rank = (np.cumsum(n) - (n - 1) / 2)[at]
        ends, total = np.cumsum([0, *[len(h[1]) for h in held]]), int(n.sum())
        for i in range(0, len(held), 64):
            some = range(i, min(i + 64, len(held)))
            columns = [pa.array([part] * len(some), pa.int32()), pa.array([held[x][0] for x in some], pa.int64()), pa.array([total] * len(some)), pa.array([rank[ends[x] : ends[x + 1]].tobytes() for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "piece", "n", "ranks"])

    at, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            if (part := b.column(0)[i].as_py()) != at:
                if held:
                    yield from told(at, held)
                at, held = part, []
            held.append((b.column(1)[i].as_py(), np.frombuffer(b.column(2)[i].as_buffer(), np.float64), np.frombuffer(b.column(3)[i].as_buffer(), np.int32)))
    if held:
        yield from told(at, held)


def _coded(known: list[np.ndarray], bits: int):
    """(row, columns of dictionaries, the others) to (piece, rows, codes): each column's places among the values, four bytes each; a missing value's is the one beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, columns in _pieces(batches, bits):
            codes = [np.searchsorted(v, c) for v, c in zip(known, columns[1:])]
            for c in columns[1 + len(known) :]:
                v = _distinct(c)
                codes.append(np.searchsorted(v, c))
            column = pa.array([np.array(codes, np.int32).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([columns[0].tobytes()], pa.binary()), column], names=["piece", "rows", "codes"])

    return run


def _given(known: dict[int, np.ndarray], rest: list[int], feature: list[int], offsets: dict[int, int]):
    """(piece, part, rows, codes, ranks), sorted by piece and part, a piece's rows before its ranks, to (row, all features' ranks in order)."""
    order = [*known, *rest]

    def told(row: np.ndarray, codes: np.ndarray, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ranks = dict(known)
        for j, f in enumerate(rest):
            own = [r + offsets[p] for p, r in parts if feature[p] == j]
            ranks[f] = np.concatenate([*own, [np.nan]])
        codes = codes.reshape(len(order), -1)
        for f, c in zip(order, codes):
            if f in rest and c.max() > len(ranks[f]) - 1:
                raise RuntimeError("a piece of rows was read differently the second time")
        out = [ranks[f][codes[order.index(f)]] for f in sorted(order)]
        for i in range(0, len(row), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(row[i : i + OUT_ROWS]), *[pa.array(c[i : i + OUT_ROWS], from_pandas=True) for c in out]], names=["__row", *[f"r{f}" for f in sorted(order)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, parts = None, None, []
        for b in batches:
            for i in range(b.num_rows):
                if (piece := b.column(0)[i].as_py()) != at:
                    if rows:
                        yield from told(*rows, parts)
                    at, rows, parts = piece, None, []
                part = b.column(1)[i].as_py()
                if part < 0:
                    rows = np.frombuffer(b.column(2)[i].as_buffer(), np.int64), np.frombuffer(b.column(3)[i].as_buffer(), np.int32)
                elif rows is None:
                    raise RuntimeError("a piece of rows was read differently the second time")
                else:
                    parts.append((part, np.frombuffer(b.column(4)[i].as_buffer(), np.float64)))
        if rows:
            yield from told(*rows, parts)

    return run


def rank_columns(rows: DataFrame, features: list[str], few: int = FEW, entries: int = ENTRIES) -> DataFrame:
    """(__row, features): each feature's average ranks among its values, null where it has none. ``rows`` has the features as doubles and unique ``__row``, and is read the same each time.

    A feature in a dictionary costs no shuffle. Of any other a piece's distinct values move to their ranges, and their ranks
    back to the piece.
    """
    known = dictionaries(rows, features, few, entries)
    rest = [i for i in range(len(features)) if i not in known]
    schema = lambda fs: "__row long, " + ", ".join(f"r{f} double" for f in fs)
    if not rest:
        looked = rows.select("__row", *[F.col(features[f]) for f in known])
        return looked.mapInArrow(_looked_up(known), schema(known)).select("__row", *[F.col(f"r{i}").alias(f) for i, f in enumerate(features)])
    spark = rows.sparkSession
    others = rows.select("__row", *[F.col(features[i]).alias(f"v{i}") for i in rest])
    bounds = range_bounds(others, [f"v{i}" for i in rest], [rows.count()] * len(rest), RANGE_ROWS)
    feature = [j for j, b in enumerate(bounds) for _ in range(len(b) + 1)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, as little data is much work here
    sent = others.mapInArrow(_sent(bounds, TILE_BITS), "part int, piece long, v binary, n binary")
    ranked = stash(sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_ranked, "part int, piece long, n long, ranks binary"), "ranked")
    offsets, before = {}, [0] * len(rest)
    for r in ranked.groupBy("part").agg(F.max("n").alias("n")).orderBy("part").collect():  # a row a range
        offsets[r["part"]] = before[feature[r["part"]]]
        before[feature[r["part"]]] += r["n"]
    coded = rows.select("__row", *[F.col(features[f]) for f in known], *[F.col(features[i]) for i in rest]).mapInArrow(_coded([v for v, _ in known.values()], TILE_BITS), "piece long, rows binary, codes binary")
    nothing = F.lit(None).cast("binary")
    both = coded.select("piece", F.lit(-1).alias("part"), "rows", "codes", nothing.alias("ranks")).unionAll(ranked.select("piece", "part", nothing.alias("rows"), nothing.alias("codes"), "ranks"))
    dealt = both.repartition(tasks, "piece").sortWithinPartitions("piece", "part")
    given = dealt.mapInArrow(_given({f: np.append(r, np.nan) for f, (_, r) in known.items()}, rest, feature, offsets), schema(range(len(features))))
    return given.select("__row", *[F.col(f"r{i}").alias(f) for i, f in enumerate(features)])
