"""Exact quantiles of large groups by digits, in constant memory.

A double has a 64-bit code in the order of its values. A pass counts the values that share the digits found so far by their
next 16 bits, for each group, column and place that is asked for; four passes find a value bit by bit. A task keeps 65,536 counters
for each of these, whatever the number of rows, and no row moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a digit, and rows that are counted at a time.
BITS, HELD_ROWS = 16, 262_144


def codes(v: np.ndarray) -> np.ndarray:
    """Unsigned codes in the order of the values; -0 equals 0, and NaN is the largest."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of(code: int) -> float:
    bits = code ^ (1 << 63) if code >> 63 else code ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counted(groups: dict[tuple[int, int], list[int]], columns: int, shift: int):
    """(group, columns) to (group, column, prefix, digit, n): values whose code begins with one of the group's and column's prefixes, by the digit after it."""
    base = np.uint64(shift + BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int, int], np.ndarray] = {}
        held: list[pa.RecordBatch] = []

        def count() -> None:
            whole = pa.Table.from_batches(held)
            group = whole.column(0).to_numpy()
            rows = {g: group == g for g in np.unique(group).tolist()}
            for j in range(columns):
                column = whole.column(j + 1)
                code = codes(column.to_numpy())
                valid = column.is_valid().to_numpy() if column.null_count else None
                for g, own in rows.items():
                    if (g, j) not in groups:
                        continue
                    own = code[own if valid is None else own & valid]
                    for prefix in groups[g, j]:
                        some = own if shift + BITS == 64 else own[(own >> base) == np.uint64(prefix)]
                        if len(some):
                            digit = ((some >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                            counter = counters.setdefault((g, j, prefix), np.zeros(1 << BITS, np.int64))
                            counter += np.bincount(digit, minlength=1 << BITS)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                count()
        if held:
            count()
        for (g, j, prefix), counter in counters.items():
            digits = np.flatnonzero(counter)
            like = lambda x, kind: pa.array([x] * len(digits), kind)
            yield pa.RecordBatch.from_arrays([like(g, pa.int32()), like(j, pa.int32()), like(str(prefix), pa.string()), pa.array(digits.astype(np.int32)), pa.array(counter[digits])], names=["g", "j", "prefix", "digit", "n"])

    return run


def numbered(df: DataFrame, groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the number that ``groups`` (``__k0``, .. and ``name``; few rows, broadcast) gives its keys; null keys are a group like any other."""
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(groups), same).drop(*[f"__k{i}" for i in range(len(keys))])


def selected(df: DataFrame, keys: list[str], columns: list[str], counted: list[Row], probabilities: list[float]) -> DataFrame:
    """(keys, __j, n, q) of the columns by position. ``counted`` has a row for each group: its keys, then how many values each column has.

    Groups are few: their places and digits are driver state. All columns are read side by side in each pass.
    """
    spark = df.sparkSession
    n = {(g, j): m for g, r in enumerate(counted) for j, m in enumerate(r[len(keys) :]) if m}
    fields = [T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    at = lambda g: tuple(counted[g][: len(keys)])
    if keys:
        ids = spark.createDataFrame([(*at(g), g) for g in range(len(counted))], T.StructType([*fields, T.StructField("__g", T.IntegerType())]))
        coded = numbered(df, ids, keys, "__g").select("__g", *columns)
    else:
        coded = df.select(F.lit(0).alias("__g"), *columns)
    # The digits found so far and the place among the values that share them, for each group, column and place.
    places = {x: sorted({f((m - 1) * p) for p in probabilities for f in (math.floor, math.ceil)}) for x, m in n.items()}
    state = {(*x, i): (0, i) for x, own in places.items() for i in own}
    for shift in range(64 - BITS, -1, -BITS) if n else ():
        groups = {x: sorted({state[*x, i][0] for i in own}) for x, own in places.items()}
        found = coded.mapInArrow(_counted(groups, len(columns), shift), "g int, j int, prefix string, digit int, n long").groupBy("g", "j", "prefix", "digit").agg(F.sum("n").alias("n"))
        # At most 65,536 digits a group, column and prefix.
        found = found.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "j", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
        asked = spark.createDataFrame([(g, j, str(prefix), i, at) for (g, j, i), (prefix, at) in state.items()], "g int, j int, prefix string, i long, at long")
        hit = found.join(F.broadcast(asked), ["g", "j", "prefix"]).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
        state = {(r["g"], r["j"], r["i"]): (int(r["prefix"]) << BITS | r["digit"], r["at"] - r["upto"] + r["n"]) for r in hit.collect()}
    rows = []
    for (g, j), m in n.items():
        q = []
        for p in probabilities:
            place = (m - 1) * p
            low, high = (value_of(state[g, j, f(place)][0]) for f in (math.floor, math.ceil))
            w = place - math.floor(place)
            q.append(low if low == high else (1 - w) * low + w * high)
        rows.append((*at(g), j, m, q))
    schema = T.StructType([*fields, *[T.StructField(c, t) for c, t in (("__j", T.IntegerType()), ("n", T.LongType()), ("q", T.ArrayType(T.DoubleType())))]])
    return spark.createDataFrame(rows, schema).withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys)})
