"""Rank statistics on the long form (feature, value, class): ranks, Spearman, rank-PCA, Kruskal-Wallis, Mann-Whitney, Holm."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recordmill.functions.labels import clean_number
from recordmill.operators.gram import correlations
from recordmill.operators.ranktiles import rank_columns
from recordmill.operators.shared import column_quantiles, hot_keys, join_salted, mixed, running_sums, stash


#: Pairs with missing values that are ranked at a time.
PAIRS = 16


def long_form(df: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """(ids, feature, value) with NaN as null."""
    return df.select(*ids, *[clean_number(F.col(f).cast("double")).alias(f) for f in features]).unpivot(ids, features, "feature", "value")


def value_ranks(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, value, ties, average_rank) for each distinct value; nulls are left out.

    Equal values are counted first; the counts are summed over range partitions, so no feature is bound to one task.
    """
    ties = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    return running_sums(ties, keys, [value], {"ties": "__upto"}).withColumn("average_rank", F.col("__upto") - (F.col("ties") - 1) / 2.0).drop("__upto")


def average_rank(long: DataFrame, keys: list[str], value: str = "value", salt: list[str] | None = None) -> DataFrame:
    """The rows with a value, and their average rank within keys. Values that many rows share are spread by a hash of ``salt``."""
    ranks = value_ranks(long, keys, value)
    on = [*keys, value]
    hot = stash(hot_keys(ranks.select(*on, "ties"), "ties"), "hot")
    rest = [c for c in long.columns if c not in on]
    return join_salted(long.where(F.col(value).isNotNull()), ranks.drop("ties"), on, hot, salt or rest or on)


def _numbered(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The features as doubles, NaN as null, with a row number ``__row``; written once, so that the numbers are the same for all readers."""
    return stash(df.select(*(keep or []), *[clean_number(F.col(f).cast("double")).alias(f) for f in features]).withColumn("__row", F.monotonically_increasing_id()), "rows")


def _pairs(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(f1, f2, target): pairwise correlations of columns, f1 before f2 in the list; one pass over the rows."""
    names = F.lit(features) if features else F.array().cast("array<string>")
    found = correlations(df.select(*features))
    return found.select(F.element_at(names, F.col("i") + 1).alias("f1"), F.element_at(names, F.col("j") + 1).alias("f2"), F.col("r").alias(target))


def pearson_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(f1, f2, r) for each pair once, over rows where both have values; any number of features takes one plan."""
    return _pairs(df, features, "r")


def spearman_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(f1, f2, rho) for each pair once, each ranked over the rows where both have values; repeated rows count as often as they stand.

    Features without a missing value are ranked once for all their pairs. Pairs with a missing value anywhere are ranked as
    columns of their own, ``PAIRS`` of them at a time; a pair without common rows has a null rho.
    """
    spark, rows = df.sparkSession, _numbered(df, features)
    if len(features) < 2:
        return _pairs(rows, features, "rho")
    missing = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f"m{i}") for i, f in enumerate(features)]).first()
    whole = [f for f, m in zip(features, missing) if not m]
    out = _pairs(rank_columns(rows.select("__row", *whole), whole), whole, "rho")
    others = [(a, b) for a, b in combinations(features, 2) if a not in whole or b not in whole]
    if not others:
        return out
    for i in range(0, len(others), PAIRS):
        some = others[i : i + PAIRS]
        sides = {f"{side}{j}": F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for j, (a, b) in enumerate(some) for side, c in (("x", a), ("y", b))}
        named = spark.createDataFrame([(f"x{j}", f"y{j}", a, b) for j, (a, b) in enumerate(some)], "f1 string, f2 string, a string, b string")
        found = _pairs(rank_columns(rows.select("__row", *[c.alias(n) for n, c in sides.items()]), list(sides)), list(sides), "rho")
        held = found.join(F.broadcast(named), ["f1", "f2"]).select(F.col("a").alias("f1"), F.col("b").alias("f2"), "rho")  # a row a pair
        out = out.unionByName(held)
    return out


def rank_pca(df: DataFrame, features: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(variance table, scores) of the principal components of average ranks, for rows without a missing value.

    Scores carry the columns ``ids``; repeated rows have a score each. The p by p matrix is made in Spark and solved on the
    driver. A component's largest loading is positive. Eigenvalues come in descending order.
    """
    if len(features) < 2:
        raise ValueError("rank_pca needs two features or more")
    spark = df.sparkSession
    rows = _numbered(df, features, ids).na.drop(subset=features)
    ranks = stash(rank_columns(rows.select("__row", *features), features), "ranks")
    m = np.eye(len(features))
    for r in _pairs(ranks, features, "rho").collect():
        i, j = features.index(r["f1"]), features.index(r["f2"])
        m[i, j] = m[j, i] = r["rho"] if r["rho"] is not None else 0.0
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(features))])
    explained = values / values.sum()
    table = [(i + 1, float(v), float(e), float(c), bool(c >= 0.9)) for i, (v, e, c) in enumerate(zip(values, explained, explained.cumsum()))]
    variance = spark.createDataFrame(table, "component int, eigenvalue double, explained double, cumulative double, reaches_90 boolean")
    scaled = robust_scale(ranks, features)
    scores = scaled.select("__row", *[sum((F.col(f) * float(vectors[i, k]) for i, f in enumerate(features)), F.lit(0.0)).alias(f"pc{k + 1}") for k in range(len(features))])
    return variance, rows.select("__row", *ids).join(scores, "__row").drop("__row")


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / (q75 - q25) for each column, a zero range dividing by 1; quartiles are exact and null-free."""
    x = lambda c: clean_number(F.col(c).cast("double"))
    q = column_quantiles(df, {f"__q{i}": x(c) for i, c in enumerate(columns)}, [0.25, 0.5, 0.75])
    wide = df.crossJoin(F.broadcast(q))  # one row
    spread = lambda i: F.col(f"__q{i}")[2] - F.col(f"__q{i}")[0]
    scaled = {c: (x(c) - F.col(f"__q{i}")[1]) / F.when(spread(i) == 0, 1.0).otherwise(spread(i)) for i, c in enumerate(columns)}
    return wide.withColumns(scaled).drop(*[f"__q{i}" for i in range(len(columns))])


def chi2_tail(h: float | None, df: int) -> float | None:
    """Upper tail of the chi-squared distribution, by the finite sums for even and odd degrees."""
    if h is None or df < 1:
        return None
    x = h / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / i
            total += term
        return math.exp(-x) * total
    total = math.erfc(math.sqrt(x))
    term = math.sqrt(x) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += math.exp(-x) * term
        term *= x / (i + 0.5)
    return total


@F.pandas_udf(DoubleType())
def _chi2_tails(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(float(a), int(b)) for a, b in zip(h, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")


def class_tally(df: DataFrame, features: list[str], target: str, classes: list[str]) -> DataFrame:
    """(feature, value, n0, n1, .., u0, u1, ..): how many rows of each class have a value, and have it or a lower one.

    One pass over the rows; all rank statistics of classes follow from this table of distinct values, written once.
    """
    rows = df.withColumn(target, F.lower(F.col(target))).where(F.col(target).isin(*classes))
    long = long_form(rows, features, [target]).where("value is not null")
    counts = long.groupBy("feature", "value").agg(*[F.count_if(F.col(target) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    return running_sums(counts, ["feature"], ["value"], {f"n{i}": f"u{i}" for i in range(len(classes))})


def _tally_quantile(n: Column, count: str, upto: str, probability: float) -> Column:
    """The exact quantile of a class with n rows, as an aggregate over a feature's rows of a class tally."""
    at = (n - 1) * F.lit(probability)
    value = lambda place: F.min(F.when((F.col(count) > 0) & (F.col(upto) >= place), F.col("value")))
    return F.struct(value(F.floor(at) + 1).alias("a"), value(F.ceil(at) + 1).alias("b"), F.max(at - F.floor(at)).alias("w"))


def kruskal(df: DataFrame, features: list[str], target: str = "macro_class", classes: tuple[str, ...] = ("background", "focal", "generalized")) -> DataFrame:
    """Kruskal-Wallis for each feature over the classes present, with medians, Holm adjustment and effect size.

    A class that has no value of a feature is left out of its test, of which k says the number of classes; both h and p
    are null where fewer than two are present or all values are equal. Texts round to six
    places and then halves up, so that the last bit of a number doesn't show.
    """
    of = range(len(classes))
    tally = stash(class_tally(df, features, target, list(classes)), "tally")
    ties, upto = sum((F.col(f"n{i}") for i in of), F.lit(0)), sum((F.col(f"u{i}") for i in of), F.lit(0))
    rank, t = upto - (ties - 1) / 2.0, ties.cast("double")
    sums = tally.groupBy("feature").agg(*[F.sum(F.col(f"n{i}") * rank).alias(f"r{i}") for i in of], *[F.sum(f"n{i}").cast("double").alias(f"c{i}") for i in of], F.sum(t * t * t - t).alias("tied"))
    n = sum((F.col(f"c{i}") for i in of), F.lit(0.0))
    s = sum((F.coalesce(F.try_divide(F.col(f"r{i}") * F.col(f"r{i}"), F.col(f"c{i}")), F.lit(0.0)) for i in of), F.lit(0.0))
    k = sum(((F.col(f"c{i}") > 0).cast("long") for i in of), F.lit(0).cast("long"))
    tests = sums.select("feature", n.alias("n"), k.alias("k"), s.alias("s"), "tied", *[f"c{i}" for i in of])
    n = F.col("n")
    h = F.try_divide(F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("tied"), n * n * n - n))
    tests = tests.withColumn("h", F.when(F.col("k") > 1, h))
    tests = tests.withColumn("p", F.when(F.col("k") == 3, F.exp(-F.col("h") / 2)).otherwise(_chi2_tails("h", F.col("k") - 1)))
    tests = holm(tests, "p").withColumn("epsilon_sq", epsilon_squared(F.col("h"), n))
    e, p = F.col("epsilon_sq"), F.col("p_holm")
    magnitude = F.when(e < 0.01, "negligible").when(e < 0.08, "small").when(e < 0.26, "medium").when(e.isNotNull(), "large")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    sized = tally.join(F.broadcast(sums.select("feature", *[f"c{i}" for i in of])), "feature")  # a row a feature
    q = sized.groupBy("feature").agg(*[_tally_quantile(F.col(f"c{i}"), f"n{i}", f"u{i}", w).alias(f"q{i}_{j}") for i in of for j, w in enumerate((0.25, 0.5, 0.75))])
    cut = lambda i, j: mixed(F.col(f"q{i}_{j}.a"), F.col(f"q{i}_{j}.b"), F.col(f"q{i}_{j}.w"))
    mid, spread = {i: cut(i, 1) for i in of}, {i: cut(i, 2) - cut(i, 0) for i in of}
    told = [x for i, c in enumerate(classes) for x in (mid[i].alias(f"median_{c}"), spread[i].alias(f"iqr_{c}"), F.when(mid[i].isNotNull(), F.format_string("%.2f (%.2f)", F.round(mid[i], 6), F.round(spread[i], 6))).alias(f"text_{c}"))]
    tests = tests.withColumn("magnitude", magnitude).withColumn("h_text", F.concat(F.format_string("%.2f", F.round("h", 6)), stars))
    return tests.join(q.select("feature", *told), "feature").drop("s", "tied", *[f"c{i}" for i in of])


def epsilon_squared(h: Column, n: Column) -> Column:
    return F.try_divide(h * (n + 1), n * n - 1)


def holm(df: DataFrame, p: str = "p", families: list[str] | None = None, target: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within families. ``df`` has a row for each test; a null p stays null."""
    keys = families or []
    tested = df.withColumn("__in", F.col(p).isNotNull())
    order = Window.partitionBy("__in", *keys).orderBy(p)
    m, j = F.count(F.lit(1)).over(Window.partitionBy("__in", *keys)), F.row_number().over(order)
    raised = tested.withColumn("__a", (m - j + 1) * F.col(p)).withColumn("__j", j)
    top = F.max("__a").over(Window.partitionBy("__in", *keys).orderBy("__j").rowsBetween(Window.unboundedPreceding, 0))
    return raised.withColumn(target, F.when(F.col("__in"), F.least(F.lit(1.0), top))).drop("__in", "__a", "__j")


def mann_whitney(df: DataFrame, features: list[str], target: str = "macro_class", pairs: tuple[tuple[str, str], ...] = (("background", "focal"), ("background", "generalized"), ("focal", "generalized"))) -> DataFrame:
    """(feature, class1, class2, n1, n2, u, z, r, p, p_holm) for each feature and pair of classes that both have values.

    u is the first class's. z and the effect r = |z| / sqrt(n1 + n2) leave ties uncorrected; p has tie and continuity
    correction, and is exact where the smaller group has at most 8 values and there are no ties. Holm runs over a
    feature's pairs. All pairs are read off one tally of distinct values.
    """
    classes = sorted({c for pair in pairs for c in pair})
    tally = class_tally(df, features, target, classes)
    per = []
    for i, (one, two) in enumerate(pairs):
        a, b = classes.index(one), classes.index(two)
        ties, upto = F.col(f"n{a}") + F.col(f"n{b}"), F.col(f"u{a}") + F.col(f"u{b}")
        t = ties.cast("double")
        per += [F.sum(F.col(f"n{a}") * (upto - (ties - 1) / 2.0)).alias(f"r{i}"), F.sum(f"n{a}").cast("double").alias(f"a{i}"), F.sum(f"n{b}").cast("double").alias(f"b{i}"), F.sum(t * t * t - t).alias(f"t{i}")]
    sums = tally.groupBy("feature").agg(*per)
    told = F.array(*[F.struct(F.lit(one).alias("class1"), F.lit(two).alias("class2"), F.col(f"a{i}").alias("n1"), F.col(f"b{i}").alias("n2"), F.col(f"r{i}").alias("r1"), F.col(f"t{i}").alias("tied")) for i, (one, two) in enumerate(pairs)])
    s = sums.select("feature", F.explode(told).alias("s")).select("feature", "s.*")
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    s = s.where((n1 > 0) & (n2 > 0)).withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    s = s.withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n + 1) / 12))).withColumn("r", F.abs("z") / F.sqrt(n))
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    corrected = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    exact = (F.least(n1, n2) <= 8) & (F.col("tied") == 0)
    s = s.withColumn("p", F.when(exact, _exact_tails(F.when(exact, F.col("u")), n1, n2)).otherwise(_normal_tails(corrected)))
    return holm(s, "p", ["feature"]).drop("r1", "tied")


def u_counts(n1: int, n2: int) -> np.ndarray:
    """How many of the orders of n1 and n2 distinct values give each u."""
    ways = np.ones(1)
    for i in range(1, n1 + 1):  # Gaussian binomial coefficient, factor by factor
        up = np.zeros(len(ways) + n2 + i)
        up[: len(ways)] += ways
        up[n2 + i :] -= ways
        for j in range(i):
            up[j::i] = np.cumsum(up[j::i])
        ways = up[: i * n2 + 1]
    return ways


@lru_cache
def _cyclic(m: int) -> tuple[int, list[int]]:
    """(L, a): 1 / ((1 - q)(1 - q)(1 - q^2)..(1 - q^m)) is the polynomial a over (1 - q^L)^(m + 1), L the least common multiple of 1 to m."""
    period, a = math.lcm(*range(1, m + 1)), [1]
    for i in (1, *range(1, m + 1)):
        a += [0] * (period - i)
        long = list(a)
        for j in range(i, len(a)):
            long[j] += long[j - i]
        a = [x - (long[j - period] if j >= period else 0) for j, x in enumerate(long)]
    return period, a


def lower_tail(u: int, m: int, n: int) -> int:
    """How many orders of m and n distinct values have a u up to this one, exactly.

    Their generating function is the Gaussian binomial; its numerator has 2^m terms at most, and what it is divided by
    has coefficients in closed form, so the cost depends on the small m alone.
    """
    period, a = _cyclic(m)
    terms = {0: 1}
    for i in range(1, m + 1):
        for e, c in list(terms.items()):
            if e + n + i <= u:
                terms[e + n + i] = terms.get(e + n + i, 0) - c
    held = lambda k: sum(a[j] * math.comb((k - j) // period + m, m) for j in range(k % period, min(len(a), k + 1), period))
    return sum(c * held(u - e) for e, c in terms.items())


@F.pandas_udf(DoubleType())
def _exact_tails(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = []
    for a, b, c in zip(u, n1, n2):
        if pd.isna(a):  # not an exact case
            out.append(float("nan"))
            continue
        m, n = int(min(b, c)), int(max(b, c))
        u = int(round(min(a, b * c - a)))
        out.append(min(1.0, 2 * lower_tail(u, m, n) / math.comb(m + n, m)))
    return pd.Series(out)
