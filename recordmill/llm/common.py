"""Helpers that several operators share: the cluster's shared folder, worker imports, splits of labelled rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.operators.shared import discard, exists, fresh_path, hot_keys, join_salted, shared_dir, stash, written  # noqa: F401

#: Rows of a narrow table that a join may broadcast.
FEW_ROWS = 200_000
#: Bytes of an Arrow batch that goes to a Python worker, unless one row is larger.
BATCH_BYTES = 2 << 20
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the place where the driver found it, and bound their batches by bytes.

    On a cluster the package is installed or passed with --py-files; this only adds the driver's own path, which
    serves local sessions whose working directory is another one. Only Spark's default of 64 MB a batch is lowered, as
    Python objects take several times the bytes; another bound of the session stays, and so does its number of rows.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, f"{BATCH_BYTES}b")
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[Column]:
    """The columns of these very names, dots and backticks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], names: tuple[str, ...] | list[str]) -> list[int]:
    """Positions of the columns that bear none of the names in any case of letters."""
    gone = {n.lower() for n in names}
    return [i for i, c in enumerate(columns) if c.lower() not in gone]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow over columns named by position, as it reads a name with a dot as a path; the result's names are the schema's."""
    names = schema.names

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, schema)


def merging(df: DataFrame) -> DataFrame:
    """One side of a join that is to sort and merge, however small Spark believes the tables.

    For tables that grow with the input: Spark sizes them by compressed files, and leaves out the rows that an explode adds.
    """
    return df.hint("merge")


def few_or_merging(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast where it was counted to have at most ``FEW_ROWS`` narrow rows, else merged."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else merging(df)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder; rows without an id are held out too, so never learned from."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(True))


def hash_fraction(*cols: str) -> Column:
    """A number in [0, 1) that depends on the named columns alone, for repeatable sampling."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(1 << 40)) / F.lit(float(1 << 40))


def one_label(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """One 0/1 label a document: rows with a null id or label are ignored; of several labels the smallest counts."""
    return (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
