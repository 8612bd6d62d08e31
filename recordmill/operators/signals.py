"""Excerpts of signals in long form (file_path, channel, channel_no, sample_index, t, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signal rate in Hz, seconds before and of an onset excerpt, stacking distance in microvolts.
RATE, PRE_SECONDS, ZOOM_SECONDS, STACK_UV = 250, 3, 10, 800


def clean_channel(name: Column) -> Column:
    return F.substring_index(F.replace(name, F.lit("EEG "), F.lit("")), "-", 1)


def pick_channels(signals: DataFrame, wanted: list[str], file: str = "file_path") -> DataFrame:
    """(file, wanted_no, wanted, channel): for each wanted electrode the first channel whose upper-cased name holds it."""
    names = signals.select(file, "channel", "channel_no").distinct()
    want = F.array(*[F.struct(F.lit(i).alias("wanted_no"), F.lit(w).alias("wanted")) for i, w in enumerate(wanted)])
    pairs = names.withColumn("w", F.explode(want)).where(F.contains(F.upper("channel"), F.upper("w.wanted")))
    return pairs.groupBy(file, F.col("w.wanted_no").alias("wanted_no"), F.col("w.wanted").alias("wanted")).agg(F.min_by("channel", "channel_no").alias("channel"))


def signal_excerpt(signals: DataFrame, wanted: list[str], start: float = 0.0, stop: float = 10.0, file: str = "file_path") -> DataFrame:
    """(file, channel, label, trace, sample_index, t, uv, stacked): wanted electrodes, start to stop included, volts as microvolts.

    Traces are numbered in the order wanted, without gaps, and stacked ``STACK_UV`` apart.
    """
    picked = pick_channels(signals, wanted, file)
    numbered = picked.withColumn("trace", F.row_number().over(Window.partitionBy(file).orderBy("wanted_no")) - 1).select(file, "channel", "trace")
    cut = signals.where(F.col("t").between(start, stop)).join(numbered, [file, "channel"])
    uv = F.col("value") * 1e6
    return cut.select(file, "channel", clean_channel(F.col("channel")).alias("label"), "trace", "sample_index", "t", uv.alias("uv"), (uv + F.col("trace") * STACK_UV).alias("stacked"))


def onset_ranges(onsets: DataFrame, pre: float = PRE_SECONDS, zoom: float = ZOOM_SECONDS, rate: int = RATE, file: str = "file_path") -> DataFrame:
    """(file_path, start, stop): the stretches that onset_excerpt needs, for readers of ranges; stop is the last sample's second or later.

    Where channels have ``rate`` samples a second, ``onset_excerpt(read_edf_ranges(spark, onset_ranges(onsets)), onsets)``
    equals the excerpt of whole recordings, and opens the onsets' files only. A file's bounds reach a sample further on both sides, so that rounding loses none.
    """
    t0 = F.greatest(F.lit(0.0), F.col("onset_s") - pre)
    return onsets.select(F.col(file).alias("file_path"), F.greatest(F.lit(0.0), t0 - 1.0 / rate).alias("start"), (t0 + zoom + 1.0 / rate).alias("stop"))


def onset_excerpt(signals: DataFrame, onsets: DataFrame, pre: float = PRE_SECONDS, zoom: float = ZOOM_SECONDS, rate: int = RATE, channels: int = 3, file: str = "file_path") -> DataFrame:
    """(file, channel, trace, sample_index, t, scaled, stacked) of the first channels around each file's onset.

    The excerpt starts ``pre`` seconds before the onset (0 at the earliest) and is ``zoom`` seconds long, end excluded.
    A channel is scaled to (value - mean) / (max - min); a flat channel is left out.
    """
    bounds = onsets.select(file, F.greatest(F.lit(0.0), F.col("onset_s") - pre).alias("t0"))
    cut = signals.where(F.col("channel_no") < channels).join(bounds, file)
    first, last = F.floor(F.col("t0") * rate), F.floor((F.col("t0") + zoom) * rate)
    cut = cut.where((F.col("sample_index") >= first) & (F.col("sample_index") < last))
    stats = cut.groupBy(file, "channel").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("span")).where("span > 0")
    scaled = cut.join(stats, [file, "channel"]).withColumn("scaled", (F.col("value") - F.col("mean")) / F.col("span"))
    return scaled.select(file, "channel", F.col("channel_no").alias("trace"), "sample_index", (F.col("sample_index") / float(rate)).alias("t"), "scaled", (F.col("scaled") - F.col("channel_no")).alias("stacked"))
