"""Recording operators: worked examples, small numpy versions, readers on files, and all registered SQL."""

import math
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordmill.functions import labels
from recordmill.operators import features, intervals, neighbours, profile, ranks, sampling, scalp, shared, signals
from recordmill.plans import queries
from recordmill.sources import edf, readers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        want = sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
        assert sorted(str([r[c] for c in cols]) for r in rows) == want


CSV = """# comment line

channel,start_time,stop_time,label,confidence
CH1, 0.0, 10.0,bckg,1.0
CH1,10.0,25.0,FNSZ,1.0
CH2,10.0,25.0,fnsz,1.0
CH2,20.0,30.0,fnsz,1.0
CH2,30.0,31.0,fnsz,1.0
bad,row
CH3,x,40.0,gnsz,1.0
"""


@pytest.fixture(scope="module")
def annotation_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("ann")
    for patient, text in (("7", CSV), ("8", "label,stop_time,start_time,x\r\nCombined,5,1,0\r\nodd,1,2,0\r\n"), ("9", ""), ("10", "no header,a,b,c\n1,2,3,4\n")):
        (root / patient / "s1").mkdir(parents=True)
        (root / patient / "s1" / "r.csv").write_bytes(text.encode())
    return f"file://{root}"


def test_annotation_reader(spark, annotation_root):
    rows = readers.read_annotations(spark, annotation_root)
    assert rows.groupBy("patient_id").count().rdd.collectAsMap() == {"7": 5, "8": 2}
    assert readers.rejected_annotations(spark, annotation_root).count() == 2
    one = rows.where("patient_id = '7'")
    assert {r["label"]: r["seconds"] for r in intervals.annotation_audit(one).collect()} == {"bckg": 10, "fnsz": 21}
    assert {r["label"]: r["seconds"] for r in intervals.natural_distribution(one).collect()} == {"background": 10, "focal": 26}
    stats = {r["label"]: r for r in intervals.event_duration_stats(one).collect()}
    assert list(stats) == ["fnsz"] and [stats["fnsz"][c] for c in ("n_events", "median_s", "min_s", "max_s", "total_s")] == [3, 10, 1, 15, 26]
    two = {r["label"]: r["seconds"] for r in intervals.natural_distribution(rows.where("patient_id = '8'")).collect()}
    assert two == {"generalized": 4, "odd": -1}
    onset = intervals.event_onset(one).first()
    assert (onset["onset_s"], onset["label"]) == (10, "FNSZ")


def test_feature_windows_and_signals(spark, tmp_path):
    spark.createDataFrame([(" FNSZ ", 1.0), ("combined", 2.0)], "label string, `C3-Cz_power` double").write.parquet(f"{tmp_path}/version=v2_augmented_labels/12")
    spark.createDataFrame([("bckg", 3.0)], "label string, other double").write.parquet(f"{tmp_path}/version=v2_augmented_labels/x1")
    rows = readers.read_feature_windows(spark, f"file://{tmp_path}")
    assert {r["patient_id"] for r in rows.collect()} == {12} and {"C3-Cz_power", "other"} <= set(rows.columns)
    assert [r["macro_class"] for r in labels.map_classes(rows, labels.SAMPLING_CLASSES).collect()] == ["focal"]
    spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], "a double, b double").coalesce(1).write.parquet(f"{tmp_path}/sig")
    got = sorted((r["channel"], r["channel_no"], r["sample_index"], r["t"], r["value"]) for r in readers.read_signal(spark, f"{tmp_path}/sig").collect())
    assert got == [("a", 0, 0, 0.0, 1.0), ("a", 0, 1, 0.004, 2.0), ("b", 1, 0, 0.0, 5.0), ("b", 1, 1, 0.004, 6.0)]


def edf_bytes():
    signals = [("EEG CZ-REF", "uV", -100, 100, -1000, 1000, 4), ("EEG O1", "mV", -1, 1, -10, 10, 2)]
    field = lambda v, n: str(v).ljust(n).encode()
    head = field("0", 8) + field("", 160) + field("01.01.20", 8) + field("00.00.00", 8) + field(256 * 3, 8) + field("", 44) + field(3, 8) + field(1, 8) + field(2, 4)
    for values, width in (([s[0] for s in signals], 16), ([""] * 2, 80), ([s[1] for s in signals], 8), *[([s[i] for s in signals], 8) for i in (2, 3, 4, 5)], ([""] * 2, 80), ([s[6] for s in signals], 8), ([""] * 2, 32)):
        head += b"".join(field(v, width) for v in values)
    body = b"".join(struct.pack("<6h", *[10 * r + i for i in range(4)], r, -r) for r in range(3))
    return head + body


def test_edf(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.edf").write_bytes(edf_bytes())
    rows = edf.read_edf(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 18
    cz = {r["sample_index"]: r for r in rows if r["channel_no"] == 0}
    assert math.isclose(cz[5]["value"], 1.1e-6) and cz[5]["t"] == 1.25 and cz[5]["channel"] == "EEG CZ-REF"
    assert sorted(r["sample_index"] for r in edf.read_edf(spark, f"file://{tmp_path}", 1.0, 1.5).collect() if r["channel_no"] == 0) == [4, 5, 6]


def test_edf_by_ranges(spark, tmp_path):
    """Blocks of one data record, read by ranges, give what the whole file gives; a file cut short gives its full records."""
    raw = edf_bytes()
    for name, content in (("x.edf", raw), ("100% b c.edf", raw), ("cut.edf", raw[:-5]), ("none.edf", raw[: 256 * 3])):
        (tmp_path / name).write_bytes(content)
    for span in ((0.0, math.inf), (1.0, 1.5), (2.5, 9.0), (7.0, 9.0)):
        whole = sorted(edf.read_edf(spark, f"file://{tmp_path}", *span).collect())
        parts = edf.read_edf(spark, f"file://{tmp_path}", *span, split_bytes=0, block_bytes=1, partitions=3)
        assert sorted(parts.collect()) == whole
        names = {r["file_path"].rsplit("/", 1)[1]: 0 for r in whole}
        if span == (0.0, math.inf):
            assert len(whole) == 18 + 18 + 12 and sorted(names) == ["100% b c.edf", "cut.edf", "x.edf"]
    assert parts.rdd.getNumPartitions() >= 3


def test_edf_source(spark, tmp_path, monkeypatch):
    """The format gives read_edf's rows however files are cut; options of channel and time read only the records they touch."""
    raw = edf_bytes()
    for name, content in (("a/x.edf", raw), ("100% b.edf", raw), ("cut.edf", raw[:-5]), ("none.edf", raw[: 256 * 3]), ("x.txt", b"1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    edf.register(spark)
    plain = lambda rows: sorted((r["file_path"].rsplit("/", 1)[1], *r[1:]) for r in rows)
    whole = plain(edf.read_edf(spark, f"file://{tmp_path}").collect())
    for split in (5, 100, 800, 1 << 20):
        found = spark.read.format("edf").option("splitBytes", split).option("blockBytes", 1).load(f"file://{tmp_path}/")
        assert plain(found.collect()) == whole
    load = lambda **options: spark.read.format("edf").options(**options).load(f"file://{tmp_path}")
    cut = load(channels="EEG O1, T3", start=1.0, stop=1.5)
    assert plain(cut.collect()) == [r for r in whole if r[1] == "EEG O1" and 1.0 <= r[4] <= 1.5] != []
    assert cut.where("t > 1.0").count() == 3 and cut.count() == 6  # a filter leaves the DataFrame as it was
    for none in ({"stop": -1.0}, {"start": "inf"}, {"channels": "T3"}, {"start": 2.0, "stop": 1.0}, {"start": "nan"}):
        assert load(**none).count() == 0
    assert plain(load(start="-inf").collect()) == whole

    (tmp_path / "long").mkdir()
    records = 10_000
    (tmp_path / "long" / "y.edf").write_bytes(raw[:236] + b"-1".ljust(8) + raw[244 : 256 * 3] + raw[256 * 3 :][:12] * records)
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    opened = edf.opened
    monkeypatch.setattr(edf, "opened", lambda path: Counted(opened(path)))
    reader = edf.EdfReader({"path": f"file://{tmp_path}/long", "splitBytes": "40000", "blockBytes": "60", "channels": "EEG O1", "start": "5000", "stop": "5010"})
    shares = reader.partitions()
    rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert {r["channel"] for r in rows} == {"EEG O1"} and [r["t"] for r in rows] == [5000 + i / 2 for i in range(21)]
    assert sum(read) == len(shares) * (8 + 256 * 3) + 11 * 12  # headers, and the records of seconds 5000 to 5010


def test_edf_and_signal_ranges(spark, tmp_path):
    """Stretches give what filters on whole recordings give, overlaps and repeats each by themselves; excerpts from them are equal."""
    raw = edf_bytes()
    for name in ("x.edf", "y.edf", "z.edf"):
        (tmp_path / name).write_bytes(raw)
    whole = edf.read_edf(spark, f"file://{tmp_path}").collect()
    path = {r["file_path"].rsplit("/", 1)[1]: r["file_path"] for r in whole}
    asked = [(path["x.edf"], 0.5, 1.25), (path["x.edf"], 1.0, 9.0), (path["x.edf"], 1.0, 9.0), (path["y.edf"], -math.inf, math.inf)]
    none = [(path["z.edf"], 2.0, 1.0), (path["z.edf"], math.inf, math.inf), (path["z.edf"], None, 1.0), (path["z.edf"], 7.0, 8.0), (None, 0.0, 1.0), (path["z.edf"], -2.0, -1.0), (path["z.edf"], math.nan, 1.0)]
    ranges = spark.createDataFrame(asked + none, "file_path string, start double, stop double")
    want = sorted((a, b, *r) for p, a, b in asked for r in whole if r["file_path"] == p and a <= r["t"] <= b)
    for block in (1, 1 << 20):
        assert sorted(tuple(r) for r in edf.read_edf_ranges(spark, ranges, block).collect()) == want
    assert edf.read_edf_ranges(spark, ranges.limit(0)).count() == 0
    onsets = spark.createDataFrame([(path["x.edf"], 1.5), (path["y.edf"], 0.0)], "file_path string, onset_s double")
    args = {"pre": 0.5, "zoom": 1.0, "rate": 4}
    parts = edf.read_edf_ranges(spark, signals.onset_ranges(onsets, **args))
    got, full = (signals.onset_excerpt(x.where("channel_no = 0"), onsets, **args).collect() for x in (parts, spark.createDataFrame(whole, edf.SCHEMA)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, full)) and len(got) == 8

    table = pa.table({"a": pa.array(range(100), pa.int32()), "note": ["n"] * 100, "b": [None, *map(float, range(99))]})
    pq.write_table(table, tmp_path / "s.parquet", row_group_size=7)
    long = readers.read_signal(spark, f"{tmp_path}/s.parquet", 10.0).collect()
    name = long[0]["file_path"]
    asked = [(name, 1.25, 4.0), (name, 3.0, 3.0), (name, 9.5, 99.0)]
    found = readers.read_signal_ranges(spark, spark.createDataFrame([*asked, (name, 20.0, 30.0)], "file_path string, start double, stop double"), 10.0)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((a, b, *r) for _, a, b in asked for r in long if a <= r["t"] <= b), key=key)


def test_profiles(spark):
    p = spark.createDataFrame([(1, 98.0, 1, -1), (2, 99.0, 2, 0), (3, None, 3, None), (4, float("nan"), 1, 1), (5, 10.0, None, 0)], readers.PATIENTS)
    assert sorted(r[0] for r in profile.cohort(p).collect()) == [2, 3, 4, 5]
    assert sorted(r[0] for r in profile.cohort(p, split=0).collect()) == [2, 5]
    assert profile.median_iqr(profile.known_ages(p), "age").first()["median"] == 54
    same = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 3).collect()
    assert [(r["low"], r["count"]) for r in sorted(same)] == [(1.5, 0), (pytest.approx(1.8333333), 2), (pytest.approx(2.1666667), 0)]
    assert profile.histogram(p.limit(0), "age").count() == 0
    all_valid = profile.validity_share(spark.createDataFrame([(19, 1.0, "a")], readers.SESSIONS)).orderBy("position").collect()
    assert [(r["count"], r["text"]) for r in all_valid] == [(1, "100.0%"), (0, "0.0%")]


def test_ranks_and_tests_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["background", "focal", "generalized"][i % 3], float(rng.integers(0, 9)) + (i % 3), float(rng.normal()) if i % 7 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, macro_class string, x double, y double")
    x, c = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    got = {r["id"]: r["average_rank"] for r in ranks.average_rank(ranks.long_form(df, ["x"], ["id"]), ["feature"]).collect()}
    assert all(got[i] == rank[i] for i in range(90)) and sum(got.values()) == 90 * 91 / 2
    n = len(x)
    _, t = np.unique(x, return_counts=True)
    h = (12 / (n * (n + 1)) * sum(rank[c == k].sum() ** 2 / (c == k).sum() for k in set(c)) - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    k = {r["feature"]: r for r in ranks.kruskal(df, ["x", "y"]).collect()}
    assert math.isclose(k["x"]["h"], h) and math.isclose(k["x"]["p"], math.exp(-h / 2)) and k["x"]["p_holm"] >= k["x"]["p"]
    mw = ranks.mann_whitney(df, ["x"]).where("class1='background' and class2='focal'").first()
    a, b = x[c == "background"], x[c == "focal"]
    assert mw["u"] == sum((i > j) + (i == j) / 2 for i in a for j in b)
    assert ranks.u_counts(3, 2).tolist() == [1, 1, 2, 2, 2, 1, 1]
    small = spark.createDataFrame([(i, "background" if i < 3 else "focal", float(i)) for i in range(6)], "id long, macro_class string, x double")
    assert math.isclose(ranks.mann_whitney(small, ["x"]).first()["p"], 0.1)
    assert math.isclose(ranks.chi2_tail(7.815, 3), 0.05, rel_tol=1e-3) and math.isclose(ranks.chi2_tail(5.991, 2), 0.05, rel_tol=1e-3)
    variance, scores = ranks.rank_pca(df, ["x", "y"], ["id"])
    assert math.isclose(sum(r["explained"] for r in variance.collect()), 1) and scores.count() == sum(r[3] is not None for r in rows)
    constant = spark.createDataFrame([(i, "focal" if i % 2 else "background", 1.0) for i in range(6)], "id long, macro_class string, x double")
    assert ranks.kruskal(constant, ["x"]).first()["h"] is None
    two = spark.createDataFrame([(i, "focal" if i % 2 else "background", float(i + 10 * (i % 2)), float(i)) for i in range(20)] + [(20, "generalized", None, 3.0)], "id long, macro_class string, x double, y double")
    got = {r["feature"]: r for r in ranks.kruskal(two, ["x", "y"]).collect()}
    assert got["x"]["k"] == 2 and abs(got["x"]["p"] - ranks.chi2_tail(got["x"]["h"], 1)) < 1e-12
    assert got["x"]["p_holm"] == min(1.0, 2 * got["x"]["p"]) and got["x"]["h_text"].endswith("*") and got["y"]["k"] == 3


def test_mutual_information_against_numpy(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(0, 3, 150)
    x = rng.normal(size=150) + c
    df = spark.createDataFrame([(i, f"k{c[i]}", float(x[i])) for i in range(150)], "id long, macro_class string, x double")
    z = x / x.std()
    psi = lambda n: sum(1 / i for i in range(1, int(n))) - features.EULER
    terms = []
    for i in range(150):
        d = np.sort(np.abs(z[c == c[i]] - z[i]))[3]
        terms.append(psi(150) + psi(3) - psi((c == c[i]).sum()) - psi((np.abs(z - z[i]) < d).sum()))
    assert math.isclose(features.mutual_info(df, ["x"], ["id"], noise=0.0).first()["mutual_info"], max(0, np.mean(terms)), abs_tol=0.02)
    got = spark.range(1, 40).select("id", features.digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r["p"], psi(r["id"]), abs_tol=1e-12) for r in got)


def test_sample_keeps_quotas(spark):
    df = spark.createDataFrame([(p, c, i) for p in range(4) for c in "ab" for i in range(3 + 5 * p)], "patient_id int, macro_class string, row_index int").withColumn("file_path", F.lit("f"))
    out = sampling.balanced_sample(df, 20).collect()
    assert {c: sum(r["macro_class"] == c for r in out) for c in "ab"} == {"a": 20, "b": 20}
    assert len({(r["patient_id"], r["macro_class"], r["row_index"]) for r in out}) == 40
    first = {p: sum(r["patient_id"] == p and r["macro_class"] == "a" for r in out) for p in range(4)}
    assert first[0] == 3 and all(first[p] >= 5 for p in (1, 2, 3))
    assert sampling.sample_n(df, 5, ["patient_id", "macro_class", "row_index"]).count() == 5


def test_scalp_surface_passes_near_its_points(spark):
    points = spark.createDataFrame([("a", x, y, x + 2 * y) for x, y in ((0.0, 0.5), (0.5, 0.0), (-0.5, 0.0), (0.0, -0.5), (0.0, 0.0))], "class string, x double, y double, median double")
    cells = scalp.scalp_grid(points, 23).collect()
    assert len(cells) == 529 and all((r["z"] is None) == (r["x"] ** 2 + r["y"] ** 2 > 1) for r in cells)
    middle = min(cells, key=lambda r: r["x"] ** 2 + r["y"] ** 2)
    assert abs(middle["z"]) < 0.2
    with pytest.raises(ValueError):
        features.columns_by_suffix(points, "_none")


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    n = 70_000
    g, v = rng.integers(0, 2, n), np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))
    rows = [(int(a), float(b)) for a, b in zip(g, v)] + [(7, 1.0), (7, 4.0), (8, None), (9, 2.0)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(5)
    at = [0.0, 0.25, 0.5, 0.9999, 1.0]
    got = {r["g"]: r["q"] for r in shared.quantiles(df, ["g"], at).collect()}
    assert sorted(got) == [0, 1, 7, 9] and got[7] == [1, 1.75, 2.5, pytest.approx(3.9997), 4] and got[9] == [2] * 5
    for k in (0, 1):
        assert np.allclose(got[k], np.quantile(v[g == k], at), rtol=0, atol=1e-12)
    assert shared.quantiles(df.limit(0), [], at).count() == 0
    plan = shared.quantiles(df, ["g"], at)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_rank_pca_and_ranking_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)), 1)
    rank = np.array([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in x.T]).T
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(rank.T)))[::-1]
    df = spark.createDataFrame([(i % 150, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double")
    variance, scores = ranks.rank_pca(df, ["a", "b", "c"], ["id"])
    table = variance.orderBy("component").collect()
    assert np.allclose([r["eigenvalue"] for r in table], values) and np.allclose([r["cumulative"] for r in table], np.cumsum(values) / 3)
    assert [r["reaches_90"] for r in table] == (np.cumsum(values) / 3 >= 0.9).tolist()
    q = np.quantile(rank, [0.25, 0.5, 0.75], axis=0)
    scaled = (rank - q[1]) / (q[2] - q[0])
    w, vectors = np.linalg.eigh(np.corrcoef(rank.T))
    for k in range(3):
        v = vectors[:, 2 - k] * np.sign(vectors[np.abs(vectors[:, 2 - k]).argmax(), 2 - k])
        assert np.allclose(np.sort([r[f"pc{k + 1}"] for r in scores.collect()]), np.sort(scaled @ v))
    rho = {(r["f1"], r["f2"]): r["rho"] for r in ranks.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isclose(rho["a", "c"], np.corrcoef(rank.T)[0, 2])


def test_mann_whitney_p_values(spark):
    rng = np.random.default_rng(8)
    rows = [("background" if i % 2 else "focal", float(rng.integers(0, 12)) + i % 2) for i in range(60)]
    got = ranks.mann_whitney(spark.createDataFrame(rows, "macro_class string, x double"), ["x"]).first()
    a, b = (np.array([v for c, v in rows if c == k]) for k in ("background", "focal"))
    u, n = sum((i > j) + (i == j) / 2 for i in a for j in b), 60
    _, t = np.unique([v for _, v in rows], return_counts=True)
    sd = math.sqrt(30 * 30 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    assert math.isclose(got["p"], math.erfc((abs(u - 450) - 0.5) / sd / math.sqrt(2)))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    x[5] = 0
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (None, [1.0] * 4), (203, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for metric in neighbours.METRICS:
        got = {}
        for r in neighbours.knn_graph(df, "id", "v", 6, metric, block_rows=50).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
        for i in range(120):
            d = neighbours.distances(x[i], x, metric)
            d[i] = np.inf
            assert sorted(got[i]) == [(k + 1, j) for k, j in enumerate(np.lexsort((np.arange(120), d))[:6])]
        whole = neighbours.approximate_knn_graph(df, "id", "v", 6, metric, cells=4, probes=4).collect()
        assert {(r["id"], r["rank"], r["neighbour"]) for r in whole} == {(i, k, j) for i, own in got.items() for k, j in own}
    with pytest.raises(ValueError):
        neighbours.knn_graph(df.unionByName(spark.createDataFrame([(300, [1.0])], df.schema)), "id", "v", 3)
    assert neighbours.knn_graph(df.limit(0), "id", "v", 3).count() == 0


def test_scalp_grid_against_numpy(spark):
    nodes = [(0.0, 0.5), (0.5, 0.1), (-0.5, 0.0), (0.1, -0.5), (0.0, 0.0)]
    points = spark.createDataFrame([("a", x, y, x * x + 2 * y) for x, y in nodes], "class string, x double, y double, median double")
    p, z = np.array(nodes), np.array([x * x + 2 * y for x, y in nodes])
    eps = math.sqrt(np.prod(p.max(axis=0) - p.min(axis=0)) / 5)
    phi = lambda d: np.sqrt((d / eps) ** 2 + 1)
    w = np.linalg.solve(phi(np.linalg.norm(p[:, None] - p[None], axis=2)) - 0.1 * np.eye(5), z)
    for r in scalp.scalp_grid(points, 21).collect():
        if r["x"] ** 2 + r["y"] ** 2 <= 1:
            assert math.isclose(r["z"], float(w @ phi(np.linalg.norm(p - [r["x"], r["y"]], axis=1))), abs_tol=1e-9)


def test_samples_are_the_same_each_time(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 3)
    one, two = (sorted(r["id"] for r in sampling.sample_n(df.repartition(n), 40, ["id"]).collect()) for n in (2, 7))
    assert one == two and len(set(one)) == 40
    assert one != sorted(r["id"] for r in sampling.sample_n(df, 40, ["id"], seed=43).collect())


def test_patients_and_sessions_files(spark, tmp_path):
    spark.createDataFrame([(1, 30.0, 1, 0)], readers.PATIENTS).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(19, 250.0, "a")], readers.SESSIONS).write.parquet(f"{tmp_path}/s")
    assert [tuple(r) for r in readers.read_patients(spark, f"{tmp_path}/p").collect()] == [(1, 30.0, 1, 0)]
    assert [tuple(r) for r in readers.read_sessions(spark, f"{tmp_path}/s").collect()] == [(19, 250.0, "a")]


def test_interval_union_alike_in_one_task_and_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{i % 3}" if i % 7 else None, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 400, 600), rng.integers(-2, 6, 600)))]
    rows += [("f0", None, 9.0), ("f0", 3.0, None), ("gone", None, None)]
    df = spark.createDataFrame(rows, "file string, start_time double, stop_time double")
    want = {}
    for f in {r[0] for r in rows}:
        reached, total = None, None
        for a, b in sorted((a, b) for g, a, b in rows if g == f and a is not None and b is not None):
            add = b - a if reached is None or a > reached else max(b - reached, 0.0)
            reached, total = max(b, b if reached is None else reached), (total or 0.0) + add
        want[f] = total
    for large in (intervals.LARGE_GROUP, 10):
        assert {r["file"]: r["seconds"] for r in intervals.interval_union_duration(df, ["file"], large=large).collect()} == want


def test_mutual_information_of_tied_values(spark):
    rng = np.random.default_rng(2)
    c, x = rng.integers(0, 3, 300), rng.integers(0, 12, 300).astype(float)
    x[c == 1] += 2
    df = spark.createDataFrame([(i, f"k{c[i]}", float(x[i])) for i in range(300)], "id long, macro_class string, x double")
    psi = lambda n: sum(1 / i for i in range(1, int(n))) - features.EULER
    terms = []
    for i in range(300):
        d = np.sort(np.abs(x[c == c[i]] - x[i]))[3]
        terms.append(psi(300) + psi(3) - psi((c == c[i]).sum()) - psi(max(1, (np.abs(x - x[i]) < d).sum())))
    assert math.isclose(features.mutual_info(df, ["x"], ["id"], noise=0.0).first()["mutual_info"], max(0, np.mean(terms)), abs_tol=1e-9)
