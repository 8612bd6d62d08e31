"""Profiles of patients and sessions: cohorts, quartiles, histograms, frequencies, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.functions.labels import clean_number, literal_map
from recordmill.operators.shared import quantiles, with_share

# Fixed values.
AGE_SENTINEL, LEAST_CHANNELS, INVALID_SPLIT, TRAINING_SPLIT = 99, 19, -1, 0
GENDERS = {1: "male", 2: "female"}


def known_ages(patients: DataFrame, age: str = "age") -> DataFrame:
    return patients.where(clean_number(F.col(age)) < AGE_SENTINEL)


def cohort(patients: DataFrame, split: int | None = None, exclude: int | None = INVALID_SPLIT, column: str = "split_final", id_col: str = "patient_num_id") -> DataFrame:
    """Distinct patient ids of one split, or of all but one (a missing split stays in)."""
    kept = patients.where(F.col(column) == split) if split is not None else patients.where(~F.col(column).eqNullSafe(F.lit(exclude)))
    return kept.select(F.col(id_col).cast("long").alias("patient_id")).distinct()


def of_cohort(rows: DataFrame, patients: DataFrame) -> DataFrame:
    """Rows whose patient_id, compared as a number, is in the cohort. Spark broadcasts the cohort where it is small."""
    return rows.join(patients, rows["patient_id"].try_cast("long") == patients["patient_id"], "left_semi")


def median_iqr(df: DataFrame, column: str) -> DataFrame:
    """One row (n, q25, median, q75, iqr) of the values that are no NaN; no row where there are none."""
    q = quantiles(df.select(clean_number(F.col(column).cast("double")).alias("value")), [], [0.25, 0.5, 0.75])
    return q.select("n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """(bin, low, high, count): equal bins from minimum to maximum, the last closed; empty bins have count 0.

    Equal values only give bins over half a unit to each side; no values give no rows.
    """
    v = df.select(clean_number(F.col(column).cast("double")).alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    counts = v.join(F.broadcast(ends)).groupBy(F.least(F.width_bucket("v", "a", "b", F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("b") - F.col("a")) / bins
    frame = ends.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", (F.col("a") + (F.col("bin") - 1) * step).alias("low"), (F.col("a") + F.col("bin") * step).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def distinct_sorted(df: DataFrame, column: str, target: str = "value") -> DataFrame:
    """The distinct non-null values in ascending order."""
    return df.select(F.col(column).alias(target)).where(F.col(target).isNotNull()).distinct().orderBy(target)


def frequency_share(df: DataFrame, column: str, target: str = "value") -> DataFrame:
    """(value, count, prop_pct) over non-null values, in ascending order of the value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(target)).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count").orderBy(target)


def gender_share(patients: DataFrame, column: str = "gender") -> DataFrame:
    return frequency_share(patients.select(F.try_element_at(literal_map(GENDERS), F.col(column).cast("int")).alias("g")), "g", "gender")


def channel_share(sessions: DataFrame, column: str = "n_channels", least: int = LEAST_CHANNELS) -> DataFrame:
    """Frequencies of channel counts, those under ``least`` flagged; ``boundary`` marks the last of them where it occurs."""
    return frequency_share(sessions, column, column).withColumn("below_min", F.col(column) < least).withColumn("boundary", F.col(column) == least - 1)


def validity_share(sessions: DataFrame, column: str = "n_channels", least: int = LEAST_CHANNELS) -> DataFrame:
    """(position, category, count, prop_pct, text): valid and excluded sessions, both always present; null counts as excluded."""
    spark = sessions.sparkSession
    frame = spark.createDataFrame([(1, "valid"), (2, "excluded")], "position int, category string")
    flag = F.when(F.coalesce(F.col(column) >= least, F.lit(False)), "valid").otherwise("excluded")
    counts = sessions.groupBy(flag.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    both = with_share(frame.join(counts, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).cast("long").alias("count")), "count")
    pct = F.coalesce("prop_pct", F.lit(0.0))
    return both.withColumn("prop_pct", pct).withColumn("text", F.when((pct > 0) & (pct < 0.1), "< 0.1%").otherwise(F.format_string("%.1f%%", pct)))
