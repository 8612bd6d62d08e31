"""Quantiles by digits, intervals merged before they move, and the order of sorted results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.operators import intervals, profile, selection, shared


def test_codes_keep_the_order():
    v = np.array([-np.inf, -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 2.5, 1e300, np.inf, np.nan])
    c = selection.codes(v)
    assert (np.diff(c.astype(object)) > 0).all() and selection.codes(np.array([-0.0])) == selection.codes(np.array([0.0]))
    assert all(selection.value_of(int(x)) == y or np.isnan(y) for x, y in zip(c, v))


def test_quantiles_by_digits_equal_numpy(spark):
    rng = np.random.default_rng(3)
    n = 3000
    g, v = rng.integers(0, 3, n), np.where(rng.random(n) < 0.4, -0.0, rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n))
    rows = [(f"k{a}" if a else None, float(b)) for a, b in zip(g, v)] + [("one", 1e-300), ("two", -1.0), ("two", 4.0), ("none", None), ("inf", float("inf")), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    at = [0.0, 0.1, 0.25, 0.5, 0.9999, 1.0]
    for small in (0, shared.SMALL):
        got = {r["g"]: (r["n"], r["q"]) for r in shared.quantiles(df, ["g"], at, small=small).collect()}
        assert set(got) == {None, "k1", "k2", "one", "two", "inf"}
        for k, name in enumerate((None, "k1", "k2")):
            assert got[name][0] == (g == k).sum() and np.allclose(got[name][1], np.quantile(v[g == k], at), rtol=1e-12, atol=0)
        assert got["one"] == (1, [1e-300] * 6) and got["two"][1][3] == 1.5 and got["inf"][1][:1] == [1.0] and got["inf"][1][5] == float("inf")
        whole = shared.quantiles(df.where("g like 'k%'"), [], at, small=small).first()
        assert np.allclose(whole["q"], np.quantile(v[g > 0], at), rtol=1e-12, atol=0)
        assert shared.quantiles(df.limit(0), ["g"], at, small=small).count() == 0


def test_no_window_takes_a_large_group(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("value"))
    plan = shared.quantiles(df, ["g"], [0.5], small=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_events_are_sorted_by_median(spark):
    rows = [("f", "short", 0.0, 1.0, 1), ("f", "short", 5.0, 6.0, 2), ("f", "long", 0.0, 50.0, 3), ("f", "alike", 7.0, 8.0, 4), ("f", "bckg", 0.0, 99.0, 5)]
    df = spark.createDataFrame(rows, "file_path string, label string, start_time double, stop_time double, line_no long")
    assert [r["label"] for r in intervals.event_duration_stats(df).collect()] == ["long", "alike", "short"]
    audit = intervals.annotation_audit(df)
    assert [r["label"] for r in audit.collect()] == ["bckg", "long", "short", "alike"]
    assert [r["label"] for r in intervals.top_labels(audit, 2).collect()] == ["bckg", "long"]
    assert [r["value"] for r in profile.distinct_sorted(df, "line_no").collect()] == [1, 2, 3, 4, 5]
    assert [r["label"] for r in profile.frequency_share(df, "label", "label").collect()] == ["alike", "bckg", "long", "short"]
    assert [(r["label"], r["windows"]) for r in intervals.windowed_distribution(df.select("label"), collapse=False).collect()][0] == ("short", 2)


@pytest.mark.parametrize("parts", [1, 6])
def test_channels_of_a_recording_move_as_one_interval(spark, parts):
    rows = [(f"f{f}", "fnsz", float(10 * e + c % 3), float(10 * e + 5)) for f in range(4) for e in range(6) for c in range(22)] + [("f0", "fnsz", 9.5, 9.0)]
    df = spark.createDataFrame(rows, "file string, label string, a double, b double").repartition(parts)
    assert {r["file"]: r["seconds"] for r in intervals.interval_union_duration(df, ["file", "label"], "a", "b").collect()} == {"f0": 29.5, "f1": 30.0, "f2": 30.0, "f3": 30.0}
    merged = df.select("file", "label", "a", "b").mapInArrow(intervals._coalesced, df.schema)
    assert merged.count() <= 25 * parts


def test_columns_are_selected_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(4)
    g, x = rng.integers(0, 3, 2000), rng.normal(size=(2000, 3))
    rows = [(f"k{a}" if a else None, float(v[0]), None if v[1] > 1 else float(v[1]), None if a == 2 else float(v[2])) for a, v in zip(g, x)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(3)
    read = []
    monkeypatch.setattr(shared, "selected", lambda v, *a: read.append(v.count()) or selection.selected(v, *a))
    for small in (0, shared.SMALL):
        got = {(r["g"], r["feature"]): (r["n"], r["q"]) for r in shared.wide_quantiles(df, ["g"], ["a", "b", "c"], [0.1, 0.5], small).collect()}
        assert len(got) == 8 and ("k2", "c") not in got
        for (k, f), (n, q) in got.items():
            own = x[g == (int(k[1]) if k else 0), "abc".index(f)]
            own = own[own <= 1] if f == "b" else own
            assert n == len(own) and np.allclose(q, np.quantile(own, [0.1, 0.5]), rtol=1e-12, atol=0)
    assert read == [2000]  # a row a window, not one for each of its columns
