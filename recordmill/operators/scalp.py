"""Class medians on electrode pairs, and their interpolation over the scalp."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions.labels import clean_number
from recordmill.operators.features import columns_by_suffix
from recordmill.operators.shared import stash, wide_quantiles

# Positions of the 19 sites of the 10-20 layout on the unit disc.
POSITIONS = {
    "Fp1": (-0.3, 0.9), "Fp2": (0.3, 0.9), "F7": (-0.8, 0.4), "F3": (-0.4, 0.5), "Fz": (0.0, 0.5), "F4": (0.4, 0.5), "F8": (0.8, 0.4),
    "T3": (-1.0, 0.0), "C3": (-0.5, 0.0), "Cz": (0.0, 0.0), "C4": (0.5, 0.0), "T4": (1.0, 0.0),
    "T5": (-0.8, -0.4), "P3": (-0.4, -0.5), "Pz": (0.0, -0.5), "P4": (0.4, -0.5), "T6": (0.8, -0.4), "O1": (-0.3, -0.9), "O2": (0.3, -0.9),
}
GRID, EXTENT, SMOOTH = 200, 1.1, 0.1  # fixed values
CLASSES = ("background", "focal", "generalized")


def electrodes(spark) -> DataFrame:
    return spark.createDataFrame([(k, x, y) for k, (x, y) in POSITIONS.items()], "electrode string, x double, y double")


def class_medians(df: DataFrame, features: list[str], target: str = "macro_class", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(feature, class, median) with exact medians."""
    rows = df.select(F.lower(F.col(target)).alias("class"), *[clean_number(F.col(f).cast("double")).alias(f) for f in features]).where(F.col("class").isin(*classes))
    found = wide_quantiles(rows, ["class"], features, [0.5])
    frame = rows.sparkSession.createDataFrame([(f, c) for f in features for c in classes], "feature string, class string")
    present = rows.select("class").distinct()  # a class without a value of a feature has a null median
    return frame.join(F.broadcast(present), "class", "left_semi").join(found, ["feature", "class"], "left").select("feature", "class", F.col("q")[0].alias("median"))


def pair_midpoints(features: DataFrame, column: str = "feature") -> DataFrame:
    """The rows whose text before the first "_" names two known electrodes, with the pair's midpoint x, y."""
    spark = features.sparkSession
    pair = F.split(F.split_part(F.col(column), F.lit("_"), F.lit(1)), "-")
    one = lambda n: F.broadcast(electrodes(spark).select(F.lower("electrode").alias(f"e{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")))  # noqa: E731  19 rows
    named = features.where(F.size(pair) == 2).withColumn("e1", F.lower(pair[0])).withColumn("e2", F.lower(pair[1]))
    both = named.join(one(1), "e1").join(one(2), "e2")
    return both.withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2).drop("e1", "e2", "x1", "x2", "y1", "y2")


def montage_points(df: DataFrame, metric_suffix: str, target: str = "macro_class", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(feature, class, median, x, y, low, high): medians at pair midpoints, and the range over all of them."""
    medians = stash(class_medians(df, columns_by_suffix(df, metric_suffix), target, classes), "medians")  # a row a feature and class
    wide = pair_midpoints(medians)
    complete = wide.where("median is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(classes)).select("feature")
    points = wide.join(complete, "feature")
    ends = points.agg(F.min("median").alias("low"), F.max("median").alias("high"))
    return points.join(F.broadcast(ends)).select("feature", "class", "median", "x", "y", "low", "high")  # one row


def multiquadric(d: np.ndarray, eps: float) -> np.ndarray:
    return np.sqrt((d / eps) ** 2 + 1)


def _scale(p: np.ndarray) -> float:
    """The mean spacing of the nodes in their bounding box."""
    span = p.max(axis=0) - p.min(axis=0)
    span = span[span > 0]
    return float((span.prod() / len(p)) ** (1 / len(span))) if len(span) else 1.0


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, xs, ys, zs) to (keys, xs, ys, weights, eps): solves (A - smooth I) w = z, once a layout for all surfaces of a batch that have it."""
    for b in batches:
        if not b.num_rows:
            continue
        xs, ys, zs = (c.to_pylist() for c in b.columns[-3:])
        layouts: dict[tuple, list[int]] = {}
        for i, place in enumerate(zip(map(tuple, xs), map(tuple, ys))):
            layouts.setdefault(place, []).append(i)
        weights, scales = [None] * b.num_rows, [0.0] * b.num_rows
        for (x, y), rows in layouts.items():
            p = np.column_stack([x, y])
            eps = _scale(p)
            a = multiquadric(np.linalg.norm(p[:, None] - p[None], axis=2), eps) - SMOOTH * np.eye(len(p))
            solved = np.linalg.lstsq(a, np.array([zs[i] for i in rows]).T, rcond=None)[0]
            for i, w in zip(rows, solved.T.tolist()):
                weights[i], scales[i] = w, eps
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(weights, pa.list_(pa.float64())), pa.array(scales)], names=[*b.schema.names[:-1], "ws", "eps"])


def scalp_grid(points: DataFrame, size: int = GRID, keys: list[str] | tuple[str, ...] = ("class",)) -> DataFrame:
    """(keys, i, j, x, y, z): the surface through the points (x, y, median) of each combination of keys on a square grid, null outside the unit disc.

    A surface has a point for each electrode pair at most, so the solve is small, and surfaces over the same pairs share
    it. Points without a median are left out. The grid is filled in Spark.
    """
    held = points.where("median is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "median")]))).alias("n"))
    held = held.select(*keys, *[F.col("n")[c].alias(name) for c, name in (("x", "xs"), ("y", "ys"), ("median", "zs"))])  # at most a few hundred nodes
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("ws", T.ArrayType(T.DoubleType())), T.StructField("eps", T.DoubleType())])
    nodes = held.mapInArrow(_weighted, schema).select(*keys, "eps", F.arrays_zip("xs", "ys", "ws").alias("nodes"))
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    place = lambda c: F.lit(-EXTENT) + F.col(c) * (2 * EXTENT / (size - 1))
    cells = nodes.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).withColumn("x", place("j")).withColumn("y", place("i"))
    phi = lambda n: F.sqrt(((F.col("x") - n["xs"]) * (F.col("x") - n["xs"]) + (F.col("y") - n["ys"]) * (F.col("y") - n["ys"])) / (F.col("eps") * F.col("eps")) + 1)
    z = F.aggregate("nodes", F.lit(0.0), lambda a, n: a + n["ws"] * phi(n))
    return cells.select(*keys, "i", "j", "x", "y", F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1, z).alias("z"))
