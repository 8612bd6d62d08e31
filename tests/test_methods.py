"""Exact small-sample tails, many surfaces from one layout, folders of a cohort, and neighbour descent."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.operators import neighbours, ranks, scalp
from recordmill.sources import readers


@pytest.mark.parametrize("m,n", [(1, 1), (1, 7), (3, 2), (3, 3), (5, 20), (8, 8), (8, 31)])
def test_tail_counts_equal_the_whole_distribution(m, n):
    ways = ranks.u_counts(m, n)
    assert [ranks.lower_tail(u, m, n) for u in range(m * n + 1)] == np.cumsum(ways).astype(int).tolist()
    assert ranks.lower_tail(m * n, m, n) == math.comb(m + n, m)


def test_tails_of_very_unequal_groups_need_no_memory(spark):
    assert ranks.lower_tail(8 * 10**9, 8, 10**9) == math.comb(10**9 + 8, 8)
    n = 10**7
    half = ranks.lower_tail(4 * n - 1, 8, n) / math.comb(n + 8, 8)
    assert abs(half - 0.5) < 1e-6
    df = spark.createDataFrame([(3.0, 8.0, float(10**7))], "u double, a double, b double")
    p = df.select(ranks._exact_tails("u", "a", "b")).first()[0]
    assert math.isclose(p, 2 * 7 / math.comb(n + 8, 8))  # 1 + 1 + 2 + 3 orders have u up to 3


def test_surfaces_of_many_keys_equal_single_ones(spark):
    rng = np.random.default_rng(0)
    nodes = [(0.0, 0.5), (0.5, 0.1), (-0.5, 0.0), (0.1, -0.5), (0.0, 0.0)]
    rows = [(p, m, x, y, float(rng.normal())) for p in range(3) for m in ("power", "entropy") for x, y in (nodes if p else nodes[:4])]
    df = spark.createDataFrame(rows, "patient int, metric string, x double, y double, median double")
    many = {(r["patient"], r["metric"], r["i"], r["j"]): r["z"] for r in scalp.scalp_grid(df, 9, keys=["patient", "metric"]).collect()}
    assert len(many) == 6 * 81
    for p in range(3):
        for m in ("power", "entropy"):
            one = scalp.scalp_grid(df.where((F.col("patient") == p) & (F.col("metric") == m)).withColumn("class", F.lit("a")), 9).collect()
            for r in one:
                z = many[p, m, r["i"], r["j"]]
                assert (r["z"] is None and z is None) or math.isclose(r["z"], z, abs_tol=1e-12)


def test_only_the_cohorts_folders_are_opened(spark, tmp_path):
    root = tmp_path / "version=v2_augmented_labels"
    for patient in ("7", "008", "12"):
        spark.createDataFrame([(f"l{patient}",)], "label string").write.parquet(f"{root}/{patient}")
    for name in ("9", "x1"):
        (root / name).mkdir()
        (root / name / "broken.parquet").write_bytes(b"no parquet")
    cohort = spark.createDataFrame([(7,), (8,), (99,)], "patient_id long")
    got = readers.read_feature_windows(spark, f"file://{tmp_path}", patients=cohort)
    assert sorted((r["patient_id"], r["label"]) for r in got.collect()) == [(7, "l7"), (8, "l008")]
    assert not any("/9/" in f or "/12/" in f for f in got.inputFiles())
    assert readers.read_feature_windows(spark, f"file://{tmp_path}", patients=cohort.where("patient_id = 99")).count() == 0


@pytest.mark.parametrize("metric,k", [("euclidean", 80), ("cosine", 50)])
def test_neighbour_descent_reaches_the_recall(spark, metric, k):
    x = np.random.default_rng(9).normal(size=(2000, 64))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "id long, v array<double>")
    graph, report = neighbours.neighbour_descent(df, "id", "v", k, metric)
    got = {}
    for r in graph.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    hit = 0
    for i in range(2000):
        d = neighbours.distances(np.broadcast_to(x[i], x.shape), x, metric)
        d[i] = np.inf
        own = sorted(got[i])
        assert [o[0] for o in own] == list(range(1, k + 1)) and len({o[1] for o in own}) == k
        assert all(abs(o[2] - d[o[1]]) < 1e-9 for o in own[:3])
        hit += len({o[1] for o in own} & set(np.argsort(d, kind="stable")[:k].tolist()))
    assert hit / (2000 * k) >= 0.9
    rounds = report.orderBy("round").collect()
    assert all(r["evaluations"] > 0 for r in rounds) and rounds[-1]["changes"] < 0.002 * 2000 * k


def test_neighbour_descent_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, v array<double>")
    graph, _ = neighbours.neighbour_descent(df, "id", "v", 2)
    want = {(r["id"], r["rank"], r["neighbour"]) for r in neighbours.knn_graph(df, "id", "v", 2).collect()}
    assert {(r["id"], r["rank"], r["neighbour"]) for r in graph.collect()} == want
    assert neighbours.neighbour_descent(df.limit(0), "id", "v", 2)[0].count() == 0


@pytest.mark.parametrize("noise", [0.0, 1e-10])
def test_mutual_information_over_many_ranges(spark, monkeypatch, noise):
    from recordmill.operators import features, mutual

    rng = np.random.default_rng(6)
    n = 1500
    c = np.where(rng.random(n) < 0.01, 3, rng.integers(0, 3, n))  # class 3 is sparse, so its intervals reach over ranges
    x = np.column_stack([rng.normal(size=n) + c, rng.integers(0, 9, n), rng.normal(size=n)])
    x[rng.random(n) < 0.1, 2] = np.nan
    rows = [(i, f"k{c[i]}", *map(float, x[i])) for i in range(n)] + [(n, "one", 0.5, 0.5, 0.5), (n + 1, None, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "id long, macro_class string, a double, b double, d double").repartition(3)
    whole = {r["feature"]: r["mutual_info"] for r in features.mutual_info(df, ["a", "b", "d"], ["id"], noise=noise).collect()}
    monkeypatch.setattr(mutual, "RANGE_POINTS", 40)
    cut = {r["feature"]: r["mutual_info"] for r in features.mutual_info(df, ["a", "b", "d"], ["id"], noise=noise).collect()}
    psi = np.concatenate(([0], -features.EULER + np.concatenate(([0], np.cumsum(1 / np.arange(1, n + 1))))))
    for j, f in enumerate("abd"):
        assert abs(whole[f] - cut[f]) < 1e-12
        if f == "b" and noise:
            continue
        own = ~np.isnan(x[:, j])
        v, g = x[own, j], c[own]
        far = [np.sort(np.abs(v[g == g[i]] - v[i]))[3] for i in range(len(v))]
        m = [max(1, (np.abs(v - v[i]) < far[i]).sum()) for i in range(len(v))]
        want = np.mean([psi[len(v)] + psi[3] - psi[(g == g[i]).sum()] - psi[m[i]] for i in range(len(v))])
        assert abs(cut[f] - max(0, want)) < (1e-3 if noise else 5e-3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbour_descent_from_small_blocks(spark, kind):
    x = np.random.default_rng(10).normal(size=(1500, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id long, v array<{kind}>")
    graph, report = neighbours.neighbour_descent(df, "id", "v", 20, first_rows=200)
    want = {(r["id"], r["neighbour"]): r["distance"] for r in neighbours.knn_graph(df, "id", "v", 20, block_rows=400).collect()}
    got = {(r["id"], r["neighbour"]): r["distance"] for r in graph.collect()}
    assert len(want) == len(got) == 30000 and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got.keys() & want.keys())
    assert report.count() > 1
    assert len(neighbours.neighbour_descent(df, "id", "v", 20)[0].collect()) == len(want)  # one block: as exact
