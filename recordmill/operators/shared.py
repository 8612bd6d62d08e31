"""Tables written once, running sums and exact quantiles that no single task has to hold, joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from recordmill.operators.selection import selected

#: Values of a group that a task takes to sort them; beyond that they are selected by digits.
SMALL = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="recordmill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing will read again."""
    for path in paths:
        place, fs = _file_system(spark, path)
        fs.delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder below the shared one, which is deleted when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/recordmill-{spark.sparkContext.applicationId}"
    place, fs = _file_system(spark, folder)
    if not fs.exists(place):
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written once to the shared folder and read again, and the path: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def _ranged(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows dealt by ranges of ``cols`` and sorted, written once with the number of their range as ``__part``."""
    return stash(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id()), "ranged")


def running_sums(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """``df`` with, for each amount, a column of the given name: its sum over the rows of the same keys up to and with this one.

    Rows are range-partitioned by keys and order, so that one key may spread over many tasks; each task sums its own rows,
    and the totals of (task, key), a few rows a task, give what has to be added.
    """
    dealt = _ranged(df, [*keys, *order])
    local = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__part").agg(*[F.sum(a).alias(f"__t_{n}") for a, n in amounts.items()])
    totals = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in amounts.values()])
    sums = dealt.withColumns({f"__l_{n}": F.sum(a).over(local) for a, n in amounts.items()}).join(totals, [*keys, "__part"])
    return sums.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in amounts.values()])


def running_max_before(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the largest amount of the rows of the same keys before this one, null for the first; dealt like running_sums.

    Null keys are a group like any other.
    """
    dealt = _ranged(df, [*keys, *order])
    local = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*keys, "__part").agg(F.max(amount).alias("__t"))
    tops = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.max("__t").over(before).alias("__before"))
    same = (F.col("__part") == F.col("__p")) & reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.lit(True))
    both = dealt.withColumn("__local", F.max(amount).over(local)).join(tops, same)
    return both.select(*df.columns, F.greatest("__local", "__before").alias(name))


def running_sum(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    return running_sums(df, keys, order, {amount: name})


def mixed(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation between two neighbouring values."""
    return F.when(low == high, low).otherwise((1 - weight) * low + weight * high)


def quantiles(long: DataFrame, keys: list[str], probabilities: list[float], value: str = "value", small: int = SMALL) -> DataFrame:
    """(keys, n, q): exact quantiles, linearly interpolated, of each group's non-null values; q is an array in the order asked.

    Groups are counted first. Where none has more than ``small`` values, a task takes a group's distinct ones with their
    counts. Beyond that values are selected by digits (see selection), in constant memory and without a window over a group. Groups must be few (features, classes). NaN
    is larger than any number.
    """
    v = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    return _quantiles(v, keys, probabilities, v.groupBy(*keys).agg(F.count("__v")).collect(), small)


def _quantiles(v: DataFrame, keys: list[str], probabilities: list[float], counted: list[Row], small: int) -> DataFrame:
    """quantiles of ``v`` (keys, __v), whose few groups' keys and sizes are ``counted``."""
    if max((r[-1] for r in counted), default=0) <= small:
        group = Window.partitionBy(*keys)
        held = v.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__m"))
        held = held.withColumn("__upto", F.sum("__m").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("__m").over(group))
        at = [(F.col("n") - 1) * F.lit(float(p)) for p in probabilities]
        value = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
        found = held.groupBy(*keys, "n").agg(*[x for i, a in enumerate(at) for x in (value(F.floor(a)).alias(f"__a{i}"), value(F.ceil(a)).alias(f"__b{i}"))])
        return found.select(*keys, "n", F.array(*[mixed(F.col(f"__a{i}"), F.col(f"__b{i}"), a - F.floor(a)) for i, a in enumerate(at)]).alias("q"))
    return selected(v, keys, ["__v"], counted, probabilities).drop("__j")


def wide_quantiles(df: DataFrame, keys: list[str], features: list[str], probabilities: list[float], small: int = SMALL) -> DataFrame:
    """(keys, feature, n, q): quantiles of each column within keys, as from the long form; large groups are read as they stand, all columns in a pass."""
    names = [f"__v{i}" for i in range(len(features))]
    wide = df.select(*keys, *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    counted = wide.groupBy(*keys).agg(*[F.count(n) for n in names]).collect() if features else []
    if max((x for r in counted for x in r[len(keys) :]), default=0) <= small:
        long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")
        return quantiles(long, [*keys, "feature"], probabilities, small=small)
    found = selected(wide, keys, names, counted, probabilities)
    return found.select(*keys, F.element_at(F.lit(features), F.col("__j") + 1).alias("feature"), "n", "q")


def column_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float], small: int = SMALL) -> DataFrame:
    """One row with an array column for each named expression: its exact quantiles, null where it has no value."""
    wide = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    found = wide_quantiles(wide, [], list(columns), probabilities, small)
    return found.agg(*[F.max(F.when(F.col("feature") == n, F.col("q"))).alias(n) for n in columns])


def range_bounds(df: DataFrame, columns: list[str], sizes: list[int], points: int, sampled: int = 200) -> list[np.ndarray]:
    """For each column ascending bounds that cut its ``sizes`` values into ranges of about ``points``, read off about ``sampled`` values a range. Only the cuts rest on the sample."""
    ranges = [-(-int(n) // points) for n in sizes]
    asked = {i: F.percentile_approx(c, [j / n for j in range(1, n)], 10_000) for i, (c, n) in enumerate(zip(columns, ranges)) if n > 1}
    if not asked:
        return [np.zeros(0)] * len(columns)
    cuts = df.sample(min(1.0, sampled * max(ranges) / max(sizes)), seed=7).agg(*[a.alias(f"b{i}") for i, a in asked.items()]).first()
    return [np.unique(np.array(cuts[f"b{i}"] or [], float)) if i in asked else np.zeros(0) for i in range(len(columns))]


def hot_keys(counts: DataFrame, amount: str, share: int = 2000, least: int = 1000) -> DataFrame:
    """The rows of ``counts`` (one a key) whose amount is above 1/``share`` of all and above ``least``: at most ``share`` rows."""
    total = counts.agg(F.sum(amount).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).where((F.col(amount) > F.col("__all") / share) & (F.col(amount) > least)).drop("__all")  # one row


def join_salted(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, salt: list[str], salts: int = 64) -> DataFrame:
    """Inner join of ``left`` with ``right``, which is unique on ``on``; rows of the keys in ``hot`` are spread over ``salts`` tasks.

    ``hot`` has the columns ``on``, at most a few thousand rows (see hot_keys) and is broadcast. The salt is a hash of the
    left columns ``salt``, so a task that runs again deals its rows alike.
    """
    marked = F.broadcast(hot.select(*on).distinct().withColumn("__hot", F.lit(True)))
    at = F.when(F.col("__hot"), F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(marked, on, "left").withColumn("__salt", at).drop("__hot")
    spread = right.join(marked, on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return dealt.join(spread, [*on, "__salt"]).drop("__salt")


def share(part: Column, whole: Column, factor: float = 100.0) -> Column:
    return F.try_divide(part * F.lit(factor), whole)


def with_share(df: DataFrame, measure: str, target: str = "prop_pct", keys: list[str] | None = None) -> DataFrame:
    """``df`` with the measure's percentage of its total (of its keys). ``df`` is an aggregate of few rows."""
    total = df.groupBy(*(keys or [])).agg(F.sum(measure).alias("__total"))
    joined = df.join(F.broadcast(total), keys) if keys else df.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn(target, share(F.col(measure), F.col("__total"))).drop("__total")
