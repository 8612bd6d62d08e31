"""A corpus pipeline: language, near-duplicates, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Every stage but the last
returns the columns of documents; the last adds the token ids and the check that decoding gives the text back. All stages
keep extra columns, whatever they are named, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import bpe, decontaminate, langid, pii, simhash
from recordmill.llm.common import discard, fresh_path, table

#: The stages hold steps that SQL cannot express (trained models, SimHash, deobfuscation, byte pair merges).
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no text, no letter in it, or a score of the model below langid.LEAST_SCORE.

    Repeated rows fare alike. A null lang or doc_id only keeps a row from being learned from; where no row has a lang,
    every document with a letter stays.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; of repeated rows any one.

    Near are texts of which any of the fingerprints of their distinct words differ in at most simhash.RADIUS bits. A null
    doc_id counts as larger than any. Texts without words, null ones too, are duplicates of each other.
    """
    return simhash.keep_one(docs, n_prints=simhash.PRINTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stands in benchmark windows go. Text that is null or has no words stays."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text where there is such a column. Null text stays null."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, their number, and whether they decode to the text; null text counts as empty."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern, add=("ids", "n_tokens", "round_trip"), keep_text=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; a table is deleted once the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
        last = path
    return docs
