"""Prefix tries, approximate neighbours and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import ann, lexical, trie


def brute_trie(rows):
    """rows: (conv_id, turn, role, text) with distinct turns a conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            nodes.setdefault(tuple(built[:d]), []).append((c, len(built) == d))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        out.append((
            min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes) for q in below),
            sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed=0, n=260):
    rng = random.Random(seed)
    said = [f"t{i}\U0001d4d0" * (i % 3) for i in range(6)]
    rows = [(c, t, rng.choice(["user", None]), rng.choice([*said, None])) for c in range(-120, n) if c % 7 for t in [None, *range(rng.randint(0, 6))][rng.randint(0, 1) :]]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 400) if c % 6 for t in range(4)]  # copies, more than a range holds
    rows += [(c, t, "user", f"same {t}") for c in (401, 402) for t in range(90)]
    rows += [(None, 0, "user", "no conversation"), (500, 0, None, None)]
    rng.shuffle(rows)
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("range_rows", [trie.RANGE_ROWS, 40, 7])
def test_trie_equals_brute_force(spark, range_rows):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV + ", key string, DEPTH int")
    got = trie.prefix_trie(trie.spliced(trie.sequences(df)), range_rows=range_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie.prefix_trie(trie.spliced(trie.sequences(spark.createDataFrame([], CONV)))).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    bare = trie.prefix_trie(trie.spliced(trie.sequences(spark.createDataFrame([(c, 0, "user", "gone")], CONV)))).collect()
    assert [tuple(r) for r in bare] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # Repeated rows are turns of their own.
    twice = trie.sequences(spark.createDataFrame([(1, 0, "user", "a")] * 3, CONV))
    assert sorted(r["depth"] for r in trie.prefix_trie(twice).collect()) == [0, 1, 2, 3]


def test_radix_tree_keeps_keys_through_all_layouts():
    rng = random.Random(3)
    keys = {bytes(rng.randrange(256) for _ in range(rng.choice([0, 16, 32]))) for _ in range(3000)} | {bytes([i]) * 16 for i in range(256)} | {b"q" * 15 + bytes([i]) for i in range(40)}
    root = trie.Node(b"")
    for key in rng.sample(sorted(keys), len(keys)):
        trie.insert(root, key, key)
    found, todo, sizes = [], [(root, b"")], set()
    while todo:
        node, before = todo.pop()
        sizes.add(node.size)
        whole = before + node.path
        if node.end is not None:
            assert node.end == whole
            found.append(whole)
        children = node.children()
        assert [b for b, _ in children] == sorted(b for b, _ in children) and len(children) <= node.size
        todo += [(kid, whole + bytes([b])) for b, kid in children]
    assert sorted(found) == sorted(keys) and sizes == {4, 16, 48, 256}


def test_chi_square_stopping_ratio():
    z = np.random.default_rng(0).standard_normal((200_000, 12))
    assert abs(((z * z).sum(axis=1) <= ann.stopping_ratio(12, 0.95)).mean() - 0.95) < 0.002


def brute_nearest(rows, k, every=50):
    good = [(r, i, np.array(v, float)) for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for r, i, q in good:
        if i % every == 0:
            cos = lambda v: float(v @ q / np.sqrt((v @ v) * (q @ q)))
            out[r] = (i, sorted((-round(cos(v), 12), j) for s, j, v in good if s != r and len(v) == len(q))[:k])
    return out


def test_neighbours_of_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(400, 440)] + [(i, [2 * x for x in rows[50][1]]) for i in (451, 452)]
    rows += [(500, None), (501, []), (550, [0.0] * 6), (551, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (552, [float("nan")] * 6), (553, [float("inf")] * 6), (None, rows[0][1]), (600, [1.0, 2.0]), (100, rows[100][1])]
    rows += [(650, [1e300, 1e300, 0.0, 0.0, 0.0, 0.0]), (651, [1e-300, 1e-300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(df, confidence=0.999999).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 12), r["vec_id"]))
    want = {}
    for i, own in brute_nearest([(i, [x / 1e300 for x in v] if i == 650 else [x * 1e300 for x in v] if i == 651 else v) for i, v in rows], 5).values():
        want.setdefault(i, []).extend((n + 1, s, j) for n, (s, j) in enumerate(own))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_neighbours_reach_the_recall(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (6000, 64))
    if kind == "clustered":
        v = rng.normal(0, 1, (60, 64))[rng.integers(0, 60, 6000)] + 0.2 * v
    v[1000:3000] = v[1000]  # a third of all rows hold one vector
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 6000, 50)) and all([x[0] for x in sorted(own)] == [1, 2, 3, 4, 5] for own in found.values())
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    hit = 0
    for q, own in found.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hit += len({x[1] for x in own} & set(np.lexsort((np.arange(6000), -s))[:5].tolist()))
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in own)
        if 1000 <= q < 3000:
            assert [x[1] for x in sorted(own)] == [i for i in range(1000, 1006) if i != q][:5]
    assert hit / (5 * len(found)) >= 0.95


def brute_ranks(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, split(t)) for d, t in docs]
    held = [(d, len(ts), Counter(ts)) for d, ts in held if ts]
    n_all, l_all, df = len(held), sum(n for _, n, _ in held), Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, n, tf in held:
            m = 75 + 25 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in split(text))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def texts(seed, n, words=60):
    rng = random.Random(seed)
    known = [f"{rng.choice('abcdeÉé中')}{i}" for i in range(words)]
    return [" -_".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(known, k=rng.choice([0, 1, 3, 20, 80]))) for _ in range(n)]


@pytest.mark.parametrize("shard_rows,piece", [(lexical.SHARD_ROWS, lexical.PIECE), (60, 11)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, shard_rows, piece):
    monkeypatch.setattr(lexical, "PIECE", piece)
    docs = list(enumerate(texts(1, 300))) + [(400 + i, "a0 a0 b1 é1") for i in range(50)] + [(None, "a0 b1"), (500, None), (501, ""), (502, "..."), (3, "a0"), (3, "a0")]
    items = [*enumerate(texts(2, 25)), (30, None), (31, "--"), (32, "unseen"), (33, "a0 a0 A0 unseen"), (34, docs[7][1])]
    docs_df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, score int, SHARD int")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.rank_documents(docs_df, items_df, shard_rows=shard_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranks(docs, items)
    blocks = lexical.rank_documents(docs_df, items_df, shard_rows=shard_rows, block_bytes=900)
    assert sorted((tuple(r) for r in blocks.collect()), key=repr) == brute_ranks(docs, items)
    for a, b in ((docs_df.limit(0), items_df), (docs_df, items_df.limit(0)), (docs_df.where("doc_id = 500"), items_df)):
        assert lexical.rank_documents(a, b).count() == 0


def test_ball_tree_prunes_but_misses_nothing():
    rng = np.random.default_rng(6)
    group = rng.integers(0, 40, 4000)
    cols = np.sort(group[:, None] * 10 + np.array([rng.choice(10, 5, replace=False) for _ in range(4000)]), axis=1).ravel().astype(np.int32)
    docs = lexical.Rows(np.arange(0, 20_001, 5), cols, rng.integers(1, 900_000, 20_000))
    items = lexical.Rows(np.arange(0, 201, 10), np.concatenate([np.arange(g * 10, g * 10 + 10) for g in range(20)]).astype(np.int32), rng.integers(1, 9000, 200))
    tree = lexical.BallTree(docs, 400, 32)
    rows, visits = lexical.search(tree, items, np.ones(20, np.int64), 5, np.arange(4000))
    assert visits < 0.5 * 20 * len(tree.leaves)
    for i in range(20):
        q = lexical.dense(items, i, 400).astype(np.int64)
        every = [int((docs.vals[5 * d : 5 * d + 5] * q[docs.cols[5 * d : 5 * d + 5]]).sum()) for d in range(4000)]
        assert [(s, d) for s, _, d in rows[i]] == sorted((-s, d) for d, s in enumerate(every) if s)[:5]


def test_queries_on_the_fixture(spark, small):
    from recordmill.llm import queries

    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]
    got = queries.QUERIES["op11_prefix_trie"](spark, small)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(read("conversations", "conv_id", "turn", "role", "text"))
    got = queries.QUERIES["op13_lexical"](spark, small)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranks(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    rows = read("embeddings", "vec_id", "embedding")
    want = {(i, j) for i, own in brute_nearest(rows, 5).values() for _, j in own}
    got = queries.QUERIES["op12_neighbours"](spark, small)
    assert got.where(F.col("rank") == 1).count() == len({i for i, _ in want})
    assert len({(r["query_id"], r["vec_id"]) for r in got.collect()} & want) >= 0.9 * len(want)
