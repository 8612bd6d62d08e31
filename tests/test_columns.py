"""Correlations, moments and ranks of many columns against numpy, and plans that don't grow with the columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordmill.operators import features, gram, ranks, ranktiles


def table(rng, n=400, p=7):
    x = rng.normal(size=(n, p)) + 1e6 * np.arange(p)
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=n)
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 3] = 5.0  # no variance
    x[:, 4] = np.nan
    x[: n // 2, 5] = np.nan
    x[n // 2 :, 6] = np.nan  # never together with 5
    return x


def brute(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i] - x[both, i].mean() if both.any() else x[:0, i], x[both, j] - x[both, j].mean() if both.any() else x[:0, j]
            d = np.sqrt((a * a).sum() * (b * b).sum())
            out[i, j] = (int(both.sum()), float((a * b).sum() / d) if d > 0 else None)
    return out


@pytest.mark.parametrize("cells,tile,parts", [(gram.CELLS, gram.TILE, 1), (gram.CELLS, gram.TILE, 5), (14, 3, 3)])
def test_correlations_equal_numpy(spark, monkeypatch, cells, tile, parts):
    monkeypatch.setattr(gram, "TILE", tile)
    x = table(np.random.default_rng(0))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"a.{i}" for i in range(7)])).repartition(parts)
    got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in gram.correlations(df, cells).collect()}
    want = brute(x)
    assert set(got) == set(want)
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else abs(got[k][1] - r) < 1e-9), k


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf"))], "a double, b double, c double")
    assert [r["r"] for r in gram.correlations(df).collect()] == [None] * 3
    assert gram.correlations(df.limit(0)).count() == 0 and gram.correlations(df.select("a")).count() == 0
    two = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 4.0, 1.0)], "a double, b double, c double")
    assert {(r["i"], r["j"]): r["r"] for r in gram.correlations(two).collect()} == {(0, 1): pytest.approx(1), (0, 2): None, (1, 2): None}


def test_shifts_far_from_the_mean_cost_no_digits(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([np.full(50, 1e9), rng.normal(size=3000), [np.nan] * 5])
    b = np.concatenate([np.full(50, -1e9), rng.normal(size=3000) + 0.3 * a[50:3050], [1.0] * 5])
    parts = [gram.Sums.of(np.column_stack([a, b])[s], slice(0, 2)) for s in (slice(0, 50), slice(50, 700), slice(700, 3000), slice(3000, None))]
    for p in parts[1:]:
        parts[0].add(p)
    assert abs(parts[0].correlations()[0, 1] - brute(np.column_stack([a, b]))[0, 1][1]) < 1e-9


def test_plans_do_not_grow_with_columns(spark):
    def lines(p):
        df = spark.range(10).select(*[(F.col("id") * (i + 1) % 7).cast("double").alias(f"c{i}") for i in range(p)])
        return len(ranks.pearson_matrix(df, df.columns)._jdf.queryExecution().executedPlan().toString().splitlines())

    assert lines(5) == lines(300)


def test_wide_ranking_selects_as_numpy(spark):
    rng = np.random.default_rng(3)
    n, p = 300, 60
    c = rng.integers(0, 3, n)
    x = rng.normal(size=(n, p)) + c[:, None] * rng.random(p)
    x[:, 10:20] = x[:, :10] + 0.1 * rng.normal(size=(n, 10))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(p)]).assign(macro_class=[f"k{i}" for i in c]))
    names = [f"c{i}" for i in range(p)]
    f = {r["feature"]: r["f"] for r in features.anova_f(df, names).collect()}
    want = []
    for j in range(p):
        groups = [x[c == k, j] for k in range(3)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups) / 2
        want.append(between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - 3)))
    assert all(abs(f[f"c{j}"] - want[j]) < 1e-9 * want[j] for j in range(p))
    red, chosen = np.maximum(np.abs(np.corrcoef(x.T)), 0.001), []
    while len(chosen) < 8:
        rest = [j for j in range(p) if j not in chosen]
        chosen.append(max(rest, key=lambda j: want[j] / (red[j, chosen].mean() if chosen else 1)))
    assert features.mrmr_select(df, names, k=8) == [f"c{j}" for j in chosen]


def average(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("few,entries", [(ranktiles.FEW, ranktiles.ENTRIES), (20, 1000), (20, 10), (0, 0)])
def test_ranks_by_row_equal_numpy(spark, monkeypatch, few, entries):
    monkeypatch.setattr(ranktiles, "TILE_BITS", 5)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, 500), rng.normal(size=500), np.where(rng.random(500) < 0.6, 0.0, rng.normal(size=500)), np.full(500, -0.0), rng.integers(0, 12, 500)]).astype(float)
    x[::2, 3] = 0.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde"))).repartition(6).withColumn("__row", F.monotonically_increasing_id())
    from recordmill.operators.shared import stash

    rows = stash(df, "rows")
    got = {r["__row"]: r for r in ranktiles.rank_columns(rows, list("abcde"), few, entries).collect()}
    held = rows.collect()
    assert len(got) == 500
    for i, name in enumerate("abcde"):
        want = average(np.array([r[name] for r in held]))
        assert [got[r["__row"]][name] for r in held] == want.tolist(), name
    assert ranktiles.rank_columns(rows.limit(0), list("ab"), few, entries).count() == 0


def test_ranks_over_many_ranges_with_missing_values(spark, monkeypatch):
    monkeypatch.setattr(ranktiles, "TILE_BITS", 5)
    monkeypatch.setattr(ranktiles, "RANGE_ROWS", 60)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), np.where(rng.random(600) < 0.5, 1.0, rng.normal(size=600)), rng.integers(0, 5, 600), rng.normal(size=600)]).astype(float)
    x[rng.random(x.shape) < [0.2, 0.1, 0.3, 0]] = np.nan
    from recordmill.operators.shared import stash

    rows = stash(spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(5).withColumn("__row", F.monotonically_increasing_id()), "rows")
    for few in (20, 0):
        got, held = {r["__row"]: r for r in ranktiles.rank_columns(rows, list("abcd"), few).collect()}, rows.collect()
        for name in "abcd":
            own = [r for r in held if r[name] is not None]
            assert [got[r["__row"]][name] for r in own] == average(np.array([r[name] for r in own])).tolist(), name
            assert all(got[r["__row"]][name] is None for r in held if r[name] is None)
