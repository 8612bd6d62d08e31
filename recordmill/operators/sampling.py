"""Class-balanced quota sampling by patient, and exact uniform samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42, order: Column | None = None) -> DataFrame:
    """Exactly n rows (all, if fewer), the same ones each time: those with the smallest ``order``, a hash of seed and key by default."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key) if order is None else order, *key).limit(n)


def balanced_sample(
    windows: DataFrame, n_per_class: int = 1500, seed: int = 42, patient: str = "patient_id", cls: str = "macro_class", order: list[Column] | None = None, patient_order: Column | None = None, row_id: list[str] | None = None
) -> DataFrame:
    """At most n rows of each class, spread over patients.

    Every patient may first give ceil(n / patients) rows of a class; classes still short are filled from the same
    patients' other rows in patient order. Rows are taken in ``order`` (default: a hash of seed, file and row), patients in
    ``patient_order`` (default: a hash of seed and patient). Only counts of (patient, class, pass) are cumulated over all
    patients; a row is compared with its patient's limit.
    """
    order = order or [F.xxhash64(F.lit(seed), *[F.col(c) for c in row_id or ["file_path"]]), *[F.col(c) for c in row_id or ["row_index"]]]
    by_patient = patient_order if patient_order is not None else F.xxhash64(F.lit(seed), F.col(patient))
    patients = windows.agg(F.count_distinct(patient).alias("patients"))
    quota = F.ceil(F.lit(n_per_class) / F.col("patients"))
    # No patient gives more than n rows of a class, so the window keeps that many at most.
    ranked = windows.withColumn("__rn", F.row_number().over(Window.partitionBy(patient, cls).orderBy(*order))).where(F.col("__rn") <= n_per_class)
    passed = ranked.crossJoin(F.broadcast(patients)).withColumn("__pass", F.when(F.col("__rn") <= quota, 1).otherwise(2)).withColumn("__first", quota).drop("patients")  # one row
    passed = passed.withColumn("__turn", F.when(F.col("__pass") == 1, F.col("__rn")).otherwise(F.col("__rn") - F.col("__first")))
    counts = passed.groupBy(patient, cls, "__pass").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(cls).orderBy("__pass", by_patient, patient).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = counts.withColumn("__take", F.lit(n_per_class) - before).where("__take > 0").drop("__n")
    taken = passed.join(limits, [patient, cls, "__pass"]).where("__turn <= __take")
    return taken.drop("__rn", "__pass", "__first", "__turn", "__take")
