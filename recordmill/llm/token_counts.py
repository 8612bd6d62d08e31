"""Token counts with a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens) in storage that all executors share. A run
finds the distinct digests that the cache lacks (partially aggregated, then an anti-join), encodes each of those contents
once, appends the counts, and joins the digests of all documents with the cache. Digests that many documents share are
spread over several tasks in that join. Normalising a content here means only reading null as empty: any other change
could alter a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import exists, fresh_path, hot_keys, join_salted, shared_dir, ship, stash, table

CACHE = "content string, tokenizer string, n_tokens long"

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _counter(model, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _models:
            _models[tokenizer] = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        sp = _models[tokenizer]
        for b in batches:
            counts = np.zeros(b.num_rows, np.int64)
            for at in range(0, b.num_rows, 64):
                counts[at : at + 64] = [len(ids) for ids in sp.encode(b.column(1).slice(at, 64).to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokenizer] * b.num_rows), pa.array(counts)], names=["content", "tokenizer", "n_tokens"])

    return run


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; a content that several runs stored counts once."""
    if not exists(spark, path):
        return spark.createDataFrame([], "content string, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def tokenizer_digest(model: bytes) -> str:
    return hashlib.sha256(model + f"sentencepiece {sentencepiece.__version__}".encode()).hexdigest()


def token_counts(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per input row, and the cache at ``cache_path`` grows by what was missing.

    Without a path the cache lies in the shared folder under the tokenizer's digest, where later runs find it. Null text
    counts as empty; repeated rows give repeated results; other columns are ignored; an empty table gives no rows. A run
    that breaks off leaves the cache as it was or with counts that are right: Spark commits the appended files together.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        content = f.read()
    tokenizer = tokenizer_digest(content)
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts-{tokenizer[:16]}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("content"))
    narrow = stash(keyed.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    misses = keyed.select("content", "text").dropDuplicates(["content"])
    if exists(spark, cache_path):
        misses = misses.join(read_cache(spark, cache_path, tokenizer), "content", "left_anti")
    model = spark.sparkContext.broadcast(content)
    misses.mapInArrow(_counter(model, tokenizer), CACHE).write.mode("append").parquet(cache_path)
    hot = hot_keys(narrow.groupBy("content").agg(F.count(F.lit(1)).alias("copies")), "copies")
    joined = join_salted(narrow, read_cache(spark, cache_path, tokenizer), ["content"], stash(hot, "hot"), ["id"])
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """From an empty cache each time, so that a run encodes every distinct text and its cost is that of the whole work."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-counts"))
