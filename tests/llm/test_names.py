"""Stages keep extra columns, whatever they are named, and keep the rows that they keep without them."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from recordmill.llm import bpe, decontaminate, langid, pii
from recordmill.llm.common import quoted, unused

NAMES = ["id", "FP", "__n", "__hits", "__BASE", "__added", "__lang", "__sure", "ids", "__kept", "__fp", "__root", "root", "n_words", "contaminated", "a.b", "tick`s", "lang_pred", "score", "content", "own name"]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"{n}!").alias(n) for n in NAMES])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_extra_columns(spark, small, docs, wide, name, stage):
    out = stage(spark, wide, small)
    assert out.columns == wide.columns
    rows = out.select("doc_id", F.array(*quoted(NAMES)).alias("extra")).collect()
    assert all(r.extra == [f"{n}!" for n in NAMES] for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, small).select("doc_id").collect())


def test_last_stage_replaces_equal_names(spark, small, wide):
    out = corpus_pipeline.byte_bpe(spark, wide.limit(20), small)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert all(r.round_trip and len(r.ids) == r.n_tokens and r["a.b"] == "a.b!" for r in out.collect())


def test_results_replace_equal_names(spark, small, wide):
    few = wide.limit(5)
    assert pii.spans(few).columns == [*[c for c in few.columns if c not in ("__BASE", "__added")], "__base", "__added"]
    assert pii.spans(few).count() == 5
    found = decontaminate.find(few, spark.read.parquet(f"{small}/benchmark.parquet"), block_bytes=4000)
    assert found.columns == [*[c for c in few.columns if c != "__hits"], "__hits"]
    assert {r["own name"] for r in found.collect()} == {"own name!"}
    assert langid.predict(few, None).columns[-2:] == ["lang_pred", "score"]
    assert langid.predict(few, None).count() == 5
    ids = spark.createDataFrame([([104, 105], "x"), (None, "y")], "ids array<int>, DECODED string")
    raw = bpe.decode(ids, corpus_path(), pattern()).collect()
    assert [r.decoded is None for r in raw] == [False, True]


def corpus_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def test_unused_names_differ_from_columns_and_each_other():
    assert unused(["A", "_a"], "a", "b", "B") == ["__a", "b", "_B"]
