"""Feature ranking: ANOVA F, minimum-redundancy selection, mutual information, interquartile range."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.functions.labels import clean_number, sanitised
from recordmill.operators.gram import class_moments, correlations
from recordmill.operators.mutual import EULER, digamma, estimates  # noqa: F401  both names are also this module's
from recordmill.operators.shared import wide_quantiles

REDUNDANCY_FLOOR = 0.001  # fixed value


def numeric_columns(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema if f.name != target and isinstance(f.dataType, T.NumericType)]


def sanitise_numeric(df: DataFrame, target: str, ids: list[str] | None = None) -> DataFrame:
    """ids, target and all other numeric columns, with null, NaN and infinite values as 0."""
    ids = ids or []
    return df.select(*ids, target, *[sanitised(F.col(c)).alias(c) for c in numeric_columns(df, target) if c not in ids])


def columns_by_suffix(df: DataFrame, suffix: str) -> list[str]:
    found = [c for c in df.columns if c.endswith(suffix)]
    if not found:
        raise ValueError(f"no column ends with {suffix!r}")
    return found


def anova_f(df: DataFrame, features: list[str], target: str = "macro_class") -> DataFrame:
    """(feature, f): one-way F over the classes, from one pass over the rows; null where it is undefined. Squares are taken about class means."""
    per = class_moments(df, features, target).where("n > 0")
    total = per.groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("square").alias("within"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean")).alias("classes"))
    between = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * (c["mean"] - F.col("mean")) * (c["mean"] - F.col("mean")))  # a class each
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k")))
    return total.select(F.element_at(F.lit(features), F.col("i") + 1).alias("feature"), f.alias("f"))


def mrmr_select(df: DataFrame, features: list[str], target: str = "macro_class", k: int = 10) -> list[str]:
    """The k features chosen greedily by F over mean absolute correlation with those chosen; ties go to the earlier column.

    Two distributed passes give F and correlations; the loop runs over that p by p summary, eight bytes a cell.
    """
    f = {r["feature"]: r["f"] for r in anova_f(df, features, target).collect()}
    names = [x for x in features if (f.get(x) or 0) > 0]
    red = np.full((len(names), len(names)), REDUNDANCY_FLOOR)
    found = correlations(df.select(*names)).toArrow()
    i, j = (found.column(c).to_numpy() for c in ("i", "j"))
    red[i, j] = red[j, i] = np.maximum(np.abs(np.nan_to_num(found.column("r").to_numpy().astype(float))), REDUNDANCY_FLOOR)
    chosen: list[int] = []
    while len(chosen) < min(k, len(names)):
        rest = [i for i in range(len(names)) if i not in chosen]
        mean = red[:, chosen].mean(axis=1) if chosen else np.ones(len(names))
        chosen.append(max(rest, key=lambda i: (f[names[i]] / (float("inf") if chosen and mean[i] == 1.0 else mean[i]), -i)))
    return [names[i] for i in chosen]


def mutual_info(df: DataFrame, features: list[str], ids: list[str], target: str = "macro_class", k: int = 3, noise: float = 1e-10) -> DataFrame:
    """(feature, mutual_info): nearest-neighbour estimate between a continuous feature and a class, at least 0.

    Values are scaled to unit deviation and get seeded noise of relative size ``noise`` from the row's ids, which breaks
    ties; without noise they stay as they are, as the estimate does not depend on the scale. Classes with one member are
    passed over, and k is at most a class's size less one. The ids are not read without noise.
    """
    values = [f"__v{i}" for i in range(len(features))]
    rows = df.where(F.col(target).isNotNull()).select(*[F.col(c).alias(f"__i{i}") for i, c in enumerate(ids)], F.col(target).alias("__t"), *[clean_number(F.col(f).cast("double")).alias(v) for f, v in zip(features, values)])
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, mutual_info double")
    sizes = rows.groupBy("__t").agg(*[F.count(v) for v in values]).collect()  # a row a class
    if noise:
        stats = rows.agg(*[x for i, v in enumerate(values) for x in (F.stddev_pop(v).alias(f"sd{i}"), F.avg(F.abs(v)).alias(f"size{i}"))]).first()
        scaled = {}
        for i, (f, v) in enumerate(zip(features, values)):
            sd, size = stats[f"sd{i}"], F.lit(stats[f"size{i}"])
            seeded = (F.pmod(F.xxhash64(F.lit(f), *[f"__i{j}" for j in range(len(ids))]), F.lit(1 << 30)) / float(1 << 30) - 0.5) * noise
            scaled[v] = F.col(v) / F.lit(1.0 if sd is None or sd == 0 else sd) + seeded * F.greatest(F.lit(1.0), size)
        rows = rows.withColumns(scaled)
    found = estimates(rows.select("__t", *values), "__t", values, k, sizes)
    return found.select(F.element_at(F.lit(features), F.col("f") + 1).alias("feature"), "mutual_info")


def rank_features(df: DataFrame, ids: list[str], target: str = "macro_class", top_k: int = 10, noise: float = 1e-10) -> DataFrame:
    """(mrmr_rank, feature, mutual_info, iqr) of the selected features, in order of selection."""
    clean = sanitise_numeric(df, target, ids)
    features = [c for c in clean.columns if c not in (target, *ids)]
    chosen = mrmr_select(clean, features, target, top_k)
    names = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "mrmr_rank int, feature string")
    q = wide_quantiles(clean, [], chosen, [0.25, 0.75])
    spread = q.select("feature", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return names.join(mutual_info(clean, chosen, ids, target, noise=noise), "feature", "left").join(spread, "feature", "left").select("mrmr_rank", "feature", "mutual_info", "iqr").orderBy("mrmr_rank")
