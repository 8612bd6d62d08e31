"""Class histograms on shared bins, and kernel density curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.functions.labels import clean_number
from recordmill.operators.shared import quantiles, stash


def _values(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.select(F.lower(F.col(target)).alias("class"), clean_number(F.col(column).cast("double")).alias("v")).where("v is not null and class is not null")


def bin_frame(df: DataFrame, column: str, target: str = "macro_class") -> DataFrame:
    """One row (low, width, bins): the narrower of the Freedman-Diaconis and Sturges widths over all rows."""
    v = _values(df, column, target)
    s = quantiles(v, [], [0.0, 0.25, 0.75, 1.0], "v").select(F.col("n").cast("double").alias("n"), F.col("q")[0].alias("low"), F.col("q")[3].alias("high"), "q")
    span = F.col("high") - F.col("low")
    fd, sturges = 2 * (F.col("q")[2] - F.col("q")[1]) / F.pow("n", F.lit(1 / 3)), span / (F.log2("n") + 1)
    width = F.when(span == 0, 1.0).when(fd == 0, sturges).otherwise(F.least(fd, sturges))
    return s.select("low", width.alias("w"), F.greatest(F.lit(1), F.ceil(span / width)).cast("int").alias("bins"), span.alias("span")).select("low", F.when(F.col("span") == 0, 1.0).otherwise(F.col("span") / F.col("bins")).alias("width"), "bins")


def class_histogram(df: DataFrame, column: str, target: str = "macro_class") -> DataFrame:
    """(class, bin, low, high, proportion): share of each class's values in the shared bins; empty bins have 0."""
    v, frame = _values(df, column, target), stash(bin_frame(df, column, target), "bins")
    at = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")) + 1, F.col("bins")).cast("int")
    counts = v.join(F.broadcast(frame)).groupBy("class", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # frame is one row
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    cells = totals.join(F.broadcast(frame)).withColumn("bin", F.explode(F.sequence(F.lit(1), "bins")))
    return cells.join(counts, ["class", "bin"], "left").select(
        "class", "bin", (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("low") + F.col("bin") * F.col("width")).alias("high"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("proportion")
    )


#: Cells of a bandwidth into which values are gathered for a density, and beyond how many bandwidths a kernel counts as 0.
CELLS, REACH = 2000, 9


def kde_grid(df: DataFrame, column: str, target: str = "macro_class", points: int = 200, cells: int = CELLS) -> DataFrame:
    """(class, i, x, density): Gaussian kernel density with Scott's bandwidth on a shared grid from minimum to maximum,
    times the bin width.

    Equal values are counted first. Where a class has more distinct values than cells of a ``cells``th of its bandwidth,
    they are gathered in cells at their mean, which changes a density by less than 1 / (8 cells^2) of the kernel's peak
    (0.00000004); cells=0 asks for the exact sum. The work is cells times grid points, whatever the number of rows. Each
    cell meets the grid as a generated array, and sums are partially aggregated.
    """
    v = _values(df, column, target)
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    per = v.groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low")).where("sd > 0")
    per = per.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).join(F.broadcast(ends)).join(F.broadcast(bin_frame(df, column, target).select("width")))
    per = stash(per, "bandwidths")  # a row a class
    counts = v.groupBy("class", "v").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(per), "class")
    if cells:
        cell = F.floor((F.col("v") - F.col("low")) / (F.col("h") / cells))
        counts = counts.groupBy("class", cell.alias("cell")).agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("v"), F.sum("m").alias("m"), *[F.first(c).alias(c) for c in ("n", "h", "a", "b", "width")])
    step = (F.col("b") - F.col("a")) / (points - 1)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("v") - REACH * F.col("h") - F.col("a")) / step).cast("int")), F.least(F.lit(points - 1), F.ceil((F.col("v") + REACH * F.col("h") - F.col("a")) / step).cast("int")))
    grid = counts.withColumn("i", F.explode(near))
    z = (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1) - F.col("v")) / F.col("h")
    sums = grid.groupBy("class", "i").agg(F.sum(F.col("m") * F.exp(-0.5 * z * z)).alias("s"))
    frame = per.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)
    return frame.join(sums, ["class", "i"], "left").select("class", "i", x.alias("x"), (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * 2.5066282746310002) * F.col("width")).alias("density"))
