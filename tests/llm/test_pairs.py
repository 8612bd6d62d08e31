"""SimHash and vector search against brute force."""

import random

import numpy as np
import pytest
import xxhash

from recordmill.llm import simhash, vectors


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprint_follows_the_contract():
    for text in (None, "", " \n", "a", "One TWO three", "A b c d e f g", "ÀB éé x y z w", "w " * 70):
        assert simhash.fingerprint(text) == brute_print(text)


def test_fingerprint_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('a b c d') h").first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("n", [2, 3, 63, 64, 65, 200])
@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_links_equal_brute_force(n, radius):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n // 3 + 1, dtype=np.uint64)
    values = base[rng.integers(0, len(base), n)]
    for _ in range(6):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64)
    values = np.unique(values)
    planes, valid = simhash.planes_of(values)
    q, b = np.repeat(np.arange(len(values)), len(planes)), np.tile(np.arange(len(planes)), len(values))
    hit, lanes = simhash.near_lanes(values[q], planes[b], valid[b], radius)
    found = {(int(q[h]), int(b[h]) * 64 + j) for h, word in zip(hit.tolist(), lanes.tolist()) for j in range(64) if word >> j & 1}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
    assert found == want


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")


def near_texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out = [None, "", "a", "a", None]
    for _ in range(25):
        words = [word() for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_components_equal_brute_force(spark, block_rows):
    texts = near_texts()
    got = {r["id"]: r for r in simhash.near_duplicates(documents(spark, texts), block_rows=block_rows).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i]["fp"] & (2**64 - 1) == prints[i]
        assert got[i]["component_id"] == roots[i]


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(-40, 60)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got.values()) == {-40, 100} and len(got) == 104


@pytest.mark.parametrize("n_prints", [0, 4])
def test_keep_one_of_ids_in_several_components(spark, n_prints):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    rows = [(0, texts[0])] + [(1, t) for t in texts] + [(2, texts[1]), (3, texts[2]), (None, texts[3])]
    for swap in (1, -1):
        docs = spark.createDataFrame(rows[::swap], "doc_id long, text string")
        kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, n_prints=n_prints).collect())
        assert kept == [(0, texts[0])] + [(1, t) for t in texts[1:]]


@pytest.mark.parametrize("n_prints", [0, 4])
def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, n_prints):
    docs = spark.createDataFrame([(1, "a b c d e", "p"), (1, "a b c d e", "p"), (2, "a b c d e", "q"), (None, "x y z w v u", "r"), (None, "a b c d e", "s"), (7, None, "t"), (8, "", "u")], "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs, n_prints=n_prints)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["fp"]) for r in kept.collect()) == [(-1, "r"), (1, "p"), (7, "t")]
    assert simhash.keep_one(docs.limit(0), n_prints=n_prints).count() == 0


def mixed(h, k):
    h = (h + k * 0x9E3779B97F4A7C15) % 2**64
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
    return h ^ (h >> 31)


def test_word_prints_keep_what_brute_force_keeps(spark):
    """Near copies of which a fortieth of the words is changed: components by all pairs, nine in ten caught, the rest left alone."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 6)))
    originals = [[word() for _ in range(rng.randint(80, 400))] for _ in range(60)]
    texts = [" ".join(w) for w in originals]
    for w in originals[:40]:
        copy = list(w)
        for i in rng.sample(range(len(w)), len(w) // 45):  # five-word shingles stay similar by 0.8 or nearly so
            copy[i] = word()
        texts.append(" ".join(copy).upper())
    texts += [None, "", " \t", texts[50], "A.", "a. a. A.", "the \U0001f600", "\u00c4 b", "\u00e4 b"]
    prints = []
    for t in texts:
        words = {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()}
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
        prints.append([sum(1 << b for b in range(64) if sum(mixed(h, k) >> b & 1 for h in hashes) * 2 > len(hashes)) for k in (1, 2, 3, 4)])
        assert simhash.word_prints(t) == "".join(f"{p:016x}" for p in prints[-1])
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if any(bin(p ^ q).count("1") <= 4 for p, q in zip(prints[i], prints[j])):
                up[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs, n_prints=4, block_rows=16).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}
    assert set(range(60)) <= kept and sum(i not in kept for i in range(60, 100)) >= 36


def test_fixture_query(spark, small):
    from recordmill.llm import queries

    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    roots = brute_components([brute_print(r["text"]) for r in docs])
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_simhash"](spark, small).collect()}
    for i, r in enumerate(docs):
        assert got[r["doc_id"]]["fingerprint"] == f"{brute_print(r['text']):016x}"
        assert got[r["doc_id"]]["component_id"] == docs[roots[i]]["doc_id"]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 1) for i in range(400)]
    rows += [(i, rows[7][1], 1) for i in range(400, 440)]  # many ties
    rows += [(450, None, 1), (500, [], 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 1), (None, rows[0][1], 1), (50, rows[50][1], 2), (600, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(r, i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for r, (i, v, _) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for r, i, q in good:
        if i % 50 == 0:
            ranked = sorted((-int(q @ v), j) for s, j, v in good if s != r and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    got = [tuple(r) for r in vectors.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert vectors.top_k(df.limit(0)).count() == 0


def test_tree_prunes_but_misses_nothing():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(0, 100, (3000, 3)))
    ids = np.arange(3000)
    best = vectors.Best(20, 4, np.full(20, -np.inf))
    vectors.search(vectors.Tree(ids, ids, points, 32), ids[:20], points[:20], best)
    for q in range(20):
        want = sorted((-float(points[q] @ points[j]), j) for j in range(3000) if j != q)[:4]
        assert [(s, i) for s, i, _ in best.rows[q]] == want


def _hash_joined(spark, run):
    """Nodes of joins by a broadcast hash table in all plans that ``run`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.planGraph(store.executionsList().apply(i).executionId()) for i in range(before, store.executionsCount())]
    return [n for g in plans for n in (g.allNodes().apply(i).desc() for i in range(g.allNodes().size())) if n.startswith("BroadcastHashJoin")]


def test_tables_that_grow_are_never_broadcast(spark):
    """Spark leaves out of a table's size the rows that an explode adds, so small estimates stand for large hash tables."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.choices(words, k=60) for _ in range(120)]
    texts += [[*t[:30], "other", *t[31:]] for t in texts[:60]] + texts[:30]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert not _hash_joined(spark, lambda: simhash.near_duplicates(docs).collect())
    met = _hash_joined(spark, lambda: simhash.keep_one(docs, n_prints=4).collect())
    assert all("LeftSemi" in n for n in met)  # the counted ids whose rows fall in several components
