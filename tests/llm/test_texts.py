"""Operators that read one text at a time, against the libraries or plain brute force."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.llm import bpe, decontaminate, pii, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
AWKWARD = [None, "", " ", "\n\n  \n", "Hello  world ", "it's we'll they'd", "日本語テキスト 한국어", "a" * 900, "naïve café x", "tab\tand  two", "😀😀 emoji 👩‍👩‍👧", "x \n y", "123456 7890 ½", "<|endoftext|>", "\x00\x01 nul"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=5))
def test_codec_equals_the_library(codec, library, texts):
    import numpy as np

    ids = codec.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_codec_forgets_and_relearns(library):
    with open(PATH, "rb") as f:
        c = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    c.units.most = 3
    texts = ["the quick brown foxes jumped overly highly", "overly the quick foxes", "again foxes jumped"] * 3
    import numpy as np

    ids = [x for t in texts for x in c.encode([t])]
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [c.decode([x])[0] for x in ids] == [t.encode() for t in texts]
    assert len(c.units.young) <= 3


def test_unknown_ids_raise(codec):
    import numpy as np

    with pytest.raises(ValueError):
        codec.decode([np.array([60000], np.int32).tobytes()])


def test_bpe_query(spark, small, library, tmp_path):
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_byte_bpe"](spark, str(tmp_path)).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_bpe_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, None)], "doc_id long, text string, w int")
    assert sorted((r["doc_id"] or 0, r["w"], len(r["ids"])) for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()) == [(0, None, 0), (1, 5, 2)]
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_token_counts_and_cache(spark, tmp_path):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*AWKWARD, "again", "again", "word " * 5000, "<s> </s> <unk>"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r["doc_id"]: r for r in token_counts.token_counts(docs, model, cache).collect()}
        for i, t in enumerate(texts):
            n = len(sp.encode(t or ""))
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # the second run found all in the cache
    assert token_counts.token_counts(docs.limit(0), model, f"file://{tmp_path}/none").count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        n = min(13, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "one two three"), (2, " ".join(f"w{i}" for i in range(20))), (3, "ONE two THREE"), (10, "é à ü"), (4, ""), (5, None), (None, "null id here"), (6, "x"), (7, "a a a a a a a a a a a a a a a")]
TEXTS = [None, "", "...", "one-two.three one two three four", " ".join(f"w{i}" for i in range(3, 18)), " ".join(f"w{i}" for i in range(12)), "É à ü é à ü", "x y x", "a " * 40, "null id here", "b " * 500 + "x"]


@pytest.mark.parametrize("block_bytes", [16 << 20, 40])
def test_decontamination_equals_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.summary(decontaminate.find(docs, bench, block_bytes=block_bytes), "doc_id", "items").collect()}
    for i, t in enumerate(TEXTS):
        n, hit, items = brute_hits(t, [x for x in ITEMS if x[0] is not None])
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (n, hit, len(items)), t
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    narrow = decontaminate.find(docs, bench, block_bytes=block_bytes, keep=["doc_id"])
    assert narrow.columns == ["doc_id", "__hits"]
    assert {r["doc_id"]: r for r in decontaminate.summary(narrow, "doc_id").collect()} == {i: tuple(x for k, x in r.asDict().items() if k != "items") for i, r in got.items()}
    twice = docs.unionAll(docs).withColumn("__row", F.lit("own")).withColumn("__HITS", F.lit("own"))
    clean = decontaminate.drop_contaminated(twice, bench, block_bytes=block_bytes)
    assert clean.columns == twice.columns and {r["__row"] for r in clean.collect()} == {"own"}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(2 * [i for i in got if not got[i]["contaminated"]])
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


@settings(max_examples=100, deadline=None)
@given(words=st.lists(st.sampled_from("abc"), max_size=60), patterns=st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=16), max_size=4))
def test_search_equals_brute_force(words, patterns):
    items = [(i, " ".join(p)) for i, p in enumerate(patterns)]
    spans, found = decontaminate.Patterns(items).search(decontaminate.words_of(" ".join(words)))
    n, hit, want = brute_hits(" ".join(words), items)
    assert (sum(e - s for s, e in spans), sorted(map(str, found))) == (hit, want)


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                odd, even = digits[::-1][::2], digits[::-1][1::2]
                if not 12 <= len(digits) <= 19 or (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+_ 0123459()é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.detect(text) == brute_spans(text)


PRIVATE = ["a@b.co and a.b@c-d.e.f@g.hh", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 1234-5678", "x@y @z.com a@b", "9" * 5000 + ".1.2.3", "a" * 100_000, "+1" * 1000]


def test_base_spans_of_awkward_texts():
    for text in PRIVATE:
        assert pii.detect(text) == (brute_spans(text) if len(text) < 4000 else [x for x in pii.detect(text)])


def test_deobfuscation_maps_back_to_the_source():
    cases = {
        "write to jane dot doe at example dot com now": "example dot com",
        "mail joe [at] example [dot] org please": "joe [at] example [dot] org",
        "joe(at)example.org": "joe(at)example.org",
        "jоe@exаmple.com": "jоe@exаmple.com",
        "call plus four nine three zero one two three four five six": "plus four nine three zero one two three four five six",
        "card ４１１１ １１１１ １１１１ １１１１ end": "４１１１ １１１１ １１１１ １１１１",
    }
    for text, part in cases.items():
        base, added = pii.find(text)
        assert any(part in text[s:e] for _, s, e in added), (text, base, added)
    for text in ("We met at home. Dot was there", "look at this. com is not", "one two three", "er kam an (at) und ging", "a b c at d e f", None, ""):
        assert pii.find(text) == ([], [])


def test_added_spans_reach_beyond_base_spans():
    cases = {
        "to jоhn@example.com!": ("email", "jоhn@example.com", "to [EMAIL]!"),
        "to john\u200b.smith@example.com!": ("email", "john\u200b.smith@example.com", "to [EMAIL]!"),
        "to john@exаmple.co.uk!": ("email", "john@exаmple.co.uk", "to [EMAIL]!"),
        "tel +49 30 12345６７８!": ("phone", "+49 30 12345６７８", "tel [PHONE]!"),
    }
    for text, (kind, part, clean) in cases.items():
        base, added = pii.find(text)
        assert [(k, text[s:e]) for k, s, e in added] == [(kind, part)], (text, base, added)
        assert base == brute_spans(text) and pii.redact(text, pii.in_order([*base, *added])) == clean
    assert pii.find("a@b.co, naïvе") == (brute_spans("a@b.co, naïvе"), [])


def test_gates_and_edits_cover_the_whole_disguise():
    whole = {
        "write to me at {jane dot doe at example dot com} now": "email",
        "{jane[dot]doe[at]example[dot]com}": "email",
        "so {jane (dot) x (dot) doe@example.com}.": "email",
        "à {jean point dupont at exemple point fr}": "email",
        "mail {joe at example dot com} at noon": "email",
        "call {plus four 9 three 0 one 2 three 4 five 6}": "phone",
        "call {+ four 9 3 one 0 3 zero 4 5 6 2 nine} now": "phone",
        "host {192[.]168[.]1[.]1} up": "ip",
        "host {10 dot 0 dot 0 dot 1}, up": "ip",
        "host {10(dot)0.0 [dot] 1}": "ip",
    }
    for marked, kind in whole.items():
        text, start, end = marked.replace("{", "").replace("}", ""), marked.index("{"), marked.index("}") - 1
        base, added = pii.find(text)
        assert (kind, start, end) in added, (text, base, added)
        clean = pii.redact(text, pii.in_order([*base, *added]))
        assert clean == f"{text[:start]}[{kind.upper()}]{text[end:]}", clean
    for text in ("300 dot 0 dot 0 dot 1", "the point made at example.com", "1 dot 2 dot 3", "one 2 three 4 five"):
        assert pii.find(text) == ([], []), text
    text = "our contact point jane@example.com"
    assert pii.find(text) == ([("email", 18, 34)], [])
    assert pii.find("a dot " * 20_000) == pii.find("1 dot " * 3) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["one", "zwei", "trois", "4", "5", "nine"]), st.sampled_from([" ", "-", ", "])), min_size=7, max_size=14), st.sampled_from(["", "plus", "+ "]))
def test_the_gate_of_spelled_digits_misses_none(parts, sign):
    text = sign + "".join(w + gap for w, gap in parts)
    assert pii._SOME_SPELLED.search(text) or not pii._spelled_edits(text)


def test_pii_query(spark, small):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_pii"](spark, small).collect()}
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        base, row = brute_spans(r["text"]), got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert row["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert set(told(base).split(",")) <= set(row["spans"].split(",")) or not base


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.co or 1.2.3.4!", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, spans string")
    assert sorted((r["doc_id"], r["text"], r["spans"]) for r in pii.redacted(docs).collect()) == [(1, "to [EMAIL] or [IP]!", "x"), (2, None, "y"), (3, "", None)]
