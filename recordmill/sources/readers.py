"""Readers of patients, sessions, annotations, feature windows and signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.sources import edf

PATIENTS = "patient_num_id long, age double, gender int, split_final int"
SESSIONS = "n_channels int, sfreq double, config_type string"
LEAST_CELLS = 4  # fixed value


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATIENTS).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSIONS).parquet(path)


def path_part(path: Column, from_end: int) -> Column:
    """A component of a path counted from its end, 1 being the file's name; null where the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def _annotation_lines(spark: SparkSession, root: str) -> DataFrame:
    """Cells of every line that is neither blank nor a comment, with the file's header line joined on.

    Each file has its own order of columns, so the header is found in each: the first line with a cell ``start_time``.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    files = reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    lines = files.select("file_path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    cells = lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("#")).select("file_path", "line_no", F.transform(F.split("line", ","), lambda c: F.lower(F.regexp_replace(c, "^[ \t]+|[ \t]+$", ""))).alias("cells"))
    header = cells.where(F.array_contains("cells", "start_time")).groupBy("file_path").agg(F.min_by("cells", "line_no").alias("header"), F.min("line_no").alias("header_no"))
    rows = cells.join(header, "file_path").where(F.col("line_no") > F.col("header_no"))
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("header", F.lit(name)), F.lit(0)).cast("int"))
    return rows.select(
        "file_path", path_part(F.col("file_path"), 3).alias("patient_id"), F.col("line_no").cast("long"), F.size("cells").alias("n_cells"),
        cell("start_time").try_cast("double").alias("start_time"), cell("stop_time").try_cast("double").alias("stop_time"), cell("label").alias("label"),
    )


_GOOD = "n_cells >= 4 and start_time is not null and stop_time is not null and label is not null"


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, patient_id, line_no, start_time, stop_time, label) of all CSV files below root; the patient is the grandparent folder.

    Rows with fewer than four cells or with numbers that cannot be read are left out; see rejected_annotations.
    """
    return _annotation_lines(spark, root).where(_GOOD).drop("n_cells")


def rejected_annotations(spark: SparkSession, root: str) -> DataFrame:
    return _annotation_lines(spark, root).where(f"not coalesce({_GOOD}, false)").select("file_path", "patient_id", "line_no")


def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders in a folder, full path by name."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return {f.getPath().getName(): f.getPath().toString() for f in found if f.isDirectory()}


def read_feature_windows(spark: SparkSession, root: str, version: str = "v2_augmented_labels", patients: DataFrame | None = None) -> DataFrame:
    """Windows of one version with patient_id from the folder below ``version=...``; files of folders that are no number are ignored.

    With ``patients``, a cohort with a column patient_id, only the folders of its patients are listed and read; a folder's
    name counts as a number. A cohort without a folder gives no rows.
    """
    place = f"{root.rstrip('/')}/version={version}"
    paths = [place]
    if patients is not None:
        wanted = {r[0] for r in patients.select(F.col("patient_id").cast("long")).distinct().collect()}  # a number a patient, as folders are listed
        paths = sorted(p for name, p in _folders(spark, place).items() if name.isascii() and name.isdigit() and int(name) in wanted)
        if not paths:
            return spark.createDataFrame([], "patient_id int, file_path string, row_index long")
    found = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)
    patient = F.regexp_extract(F.col("_metadata.file_path"), f"version={version}/([0-9]+)/", 1).try_cast("int")
    rows = found.select("*", patient.alias("patient_id"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    return rows.where("patient_id is not null")


def read_signal(spark: SparkSession, path: str, rate: float = 250.0) -> DataFrame:
    """Long form of Parquet signals in which row position is time and every numeric column a channel."""
    wide = spark.read.parquet(path)
    channels = [c for c, t in wide.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    rows = wide.select(*[F.col(c).cast("double").alias(c) for c in channels], F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("sample_index"))
    long = rows.unpivot(["file_path", "sample_index"], channels, "channel", "value")
    number = F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (c, i)])
    return long.select("file_path", "channel", number[F.col("channel")].alias("channel_no"), "sample_index", (F.col("sample_index") / rate).alias("t"), "value")


def _opened(path: str) -> pq.ParquetFile:
    return pq.ParquetFile(edf.opened(path))


def _channels(schema: pa.Schema) -> list[str]:
    return [f.name for f in schema if pa.types.is_integer(f.type) or pa.types.is_float32(f.type) or pa.types.is_float64(f.type)]


def read_signal_ranges(spark: SparkSession, ranges: DataFrame, rate: float = 250.0, partitions: int | None = None) -> DataFrame:
    """(range_start, range_stop, file_path, channel, ...): of each row (file_path, start, stop) of ``ranges`` the rows of read_signal in it, ends included.

    A task opens a file, reads its footer, and only the row groups that its stretch touches. Stretches may overlap and
    repeat; rows with a null are passed over; file_path stays as it was given. Stores must be ones that pyarrow opens.
    """
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                with _opened(name) as file:
                    sizes = [file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)]
                firsts = [sum(sizes[:g]) for g in range(len(sizes))]
                own = [(g, at) for g, (at, n) in enumerate(zip(firsts, sizes)) if n and at / rate <= stop and (at + n - 1) / rate >= start]
                groups, starts = [pa.array([x[i] for x in own], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), *(pa.array([x] * len(own), pa.float64()) for x in (start, stop)), groups, starts], names=["path", "start", "stop", "group", "first"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, stop, group, first in zip(*(c.to_pylist() for c in b.columns)):
                with _opened(name) as file:
                    names = _channels(file.schema_arrow)
                    for no, channel in enumerate(names):
                        own = file.read_row_group(group, columns=[channel]).column(0).cast(pa.float64()).combine_chunks()
                        index = first + np.arange(len(own), dtype=np.int64)
                        t = index / rate
                        keep = np.flatnonzero((t >= start) & (t <= stop))
                        n = len(keep)
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(np.full(n, x)) for x in (start, stop)), pa.array([name] * n, pa.string()), pa.array([channel] * n, pa.string()), pa.array(np.full(n, no, np.int32)), pa.array(index[keep]), pa.array(t[keep]), own.take(pa.array(keep))],
                            names=["range_start", "range_stop", *edf.NAMES],
                        )

    asked = ranges.select("file_path", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")).dropna().where(edf.HOLDS)
    dealt = asked.repartition(tasks, "file_path", "start", "stop").mapInArrow(listed, "path string, start double, stop double, group long, first long")
    return dealt.repartition(tasks, "path", "group", "start").mapInArrow(read, f"range_start double, range_stop double, {edf.SCHEMA}")
