"""Interval annotations: union durations, event statistics, natural and windowed distributions, onsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.functions.labels import AUDIT_CLASSES, BACKGROUND, display_label, map_class, normalise_label
from recordmill.operators.shared import quantiles, running_max_before, stash, with_share

WINDOW_SECONDS = 4.096  # fixed value: length of a feature window


#: Intervals, once merged where they lie, above which the groups are counted, and those of one group above which it is spread over range partitions.
LARGE_GROUP = 1_000_000


def _coalesced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, from, to): intervals of a batch that meet or overlap as one; inverted ones and those without an end as they are."""
    for b in batches:
        if not b.num_rows:
            continue
        start, stop = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[-2:])
        plain = np.flatnonzero(stop >= start)
        group = np.zeros(b.num_rows, np.int64)
        for c in b.columns[:-2]:
            codes = c.dictionary_encode().indices
            codes = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.unique(group * (codes.max() + 2) + codes + 1, return_inverse=True)[1]
        order = plain[np.lexsort((stop[plain], start[plain], group[plain]))]
        g, reach = group[order], pd.Series(stop[order]).groupby(group[order]).cummax().to_numpy()
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (start[order][1:] > reach[:-1])))[: len(order)]
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(order)) - 1 if len(heads) else heads
        keep = np.concatenate([order[heads], np.setdiff1d(np.arange(b.num_rows), plain)])
        ends = np.concatenate([reach[tails], stop[np.setdiff1d(np.arange(b.num_rows), plain)]])
        kept = b.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(ends, mask=np.isnan(ends)).cast(b.schema[-1].type)], names=b.schema.names)


def interval_union_duration(df: DataFrame, keys: list[str], start: str = "start_time", stop: str = "stop_time", large: int = LARGE_GROUP) -> DataFrame:
    """(keys, seconds): length of the union of each group's intervals; touching intervals merge.

    Intervals of a batch of rows are merged before they move, so that overlapping ones (the channels of a recording) are
    shuffled as one. Each of the rest adds what it reaches beyond all that start before it. Inverted intervals keep their
    negative length where nothing covers them; an interval without a start or stop adds nothing. A group is one file's
    intervals of a label; where one has more than ``large`` of them, groups are spread over range partitions.
    """
    rows = df.select(*keys, F.col(start).cast("double").alias("__from"), F.when(F.col(start).isNotNull(), F.col(stop).cast("double")).alias("__to"))
    rows = stash(rows.mapInArrow(_coalesced, rows.schema), "intervals")
    if rows.count() <= large or rows.groupBy(*keys).count().where(F.col("count") > large).isEmpty():
        before = Window.partitionBy(*keys).orderBy("__from", "__to").rowsBetween(Window.unboundedPreceding, -1)
        reached = rows.withColumn("__reached", F.max("__to").over(before))
    else:
        reached = running_max_before(rows, keys, ["__from", "__to"], "__to", "__reached")
    beyond = F.when(F.col("__reached").isNull() | (F.col("__from") > F.col("__reached")), F.col("__to") - F.col("__from"))
    beyond = beyond.when(F.col("__to") > F.col("__reached"), F.col("__to") - F.col("__reached")).when(F.col("__to").isNotNull(), F.col("__to") - F.col("__to"))
    return reached.withColumn("__s", beyond).groupBy(*keys).agg(F.sum("__s").alias("seconds"))


def annotation_audit(annotations: DataFrame, file: str = "file_path", label: str = "label", drop_inverted: bool = False) -> DataFrame:
    """(label, seconds, prop_pct): union durations summed over files, the longest first."""
    rows = annotations.withColumn("label", normalise_label(F.col(label)))
    rows = rows.where("stop_time >= start_time") if drop_inverted else rows
    totals = interval_union_duration(rows, [file, "label"]).groupBy("label").agg(F.sum("seconds").alias("seconds"))
    return with_share(totals, "seconds").orderBy(F.desc("seconds"), "label")


def distinct_events(annotations: DataFrame, file: str = "file_path", label: str = "label") -> DataFrame:
    return annotations.select(F.col(file).alias("file_path"), normalise_label(F.col(label)).alias("label"), "start_time", "stop_time").distinct()


def event_duration_stats(annotations: DataFrame, background: str = BACKGROUND, file: str = "file_path") -> DataFrame:
    """Per non-background label over distinct events: count, median, mean, min, max and sum of durations; the longest median first."""
    events = distinct_events(annotations, file).where(F.col("label") != background).withColumn("d", F.col("stop_time") - F.col("start_time"))
    medians = quantiles(events, ["label"], [0.5], "d").select("label", F.col("q")[0].alias("median_s"))
    stats = events.groupBy("label").agg(F.count(F.lit(1)).alias("n_events"), F.avg("d").alias("mean_s"), F.min("d").alias("min_s"), F.max("d").alias("max_s"), F.sum("d").alias("total_s"))
    return stats.join(medians, "label", "left").select("label", "n_events", "median_s", "mean_s", "min_s", "max_s", "total_s").orderBy(F.desc("median_s"), "label")


def natural_distribution(annotations: DataFrame, collapse: bool = True, mapping: dict | None = None, file: str = "file_path") -> DataFrame:
    """(label, seconds, prop_pct) over each file's distinct intervals; overlaps count twice. Unmapped labels stay."""
    events = distinct_events(annotations, file)
    label = map_class(F.col("label"), mapping or AUDIT_CLASSES, "keep") if collapse else F.col("label")
    sums = events.groupBy(label.alias("label")).agg(F.sum(F.col("stop_time") - F.col("start_time")).alias("seconds"))
    return with_share(sums, "seconds")


def windowed_distribution(windows: DataFrame, collapse: bool = True, mapping: dict | None = None, label: str = "label", seconds: float = WINDOW_SECONDS) -> DataFrame:
    """(label, windows, seconds, prop_pct): windows counted by label, reading no other column; the commonest first."""
    code = normalise_label(F.col(label))
    name = map_class(code, mapping or AUDIT_CLASSES, "keep") if collapse else code
    counts = windows.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("windows"))
    return with_share(counts, "windows").withColumn("seconds", F.col("windows") * seconds).orderBy(F.desc("windows"), "label")


def compare_distributions(natural: DataFrame, windowed: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Both distributions by source and label: seconds, share, hours, a display label, and the shared limit max * 1.18."""
    rows = natural.select(F.lit("natural").alias("source"), "label", "seconds").unionByName(windowed.select(F.lit("windowed").alias("source"), "label", "seconds"))
    rows = with_share(rows, "seconds", "prop_pct", ["source"])
    limits = rows.agg((F.max("prop_pct") * 1.18).alias("pct_limit"), (F.max(F.col("seconds") / 3600) * 1.18).alias("hours_limit"))
    return rows.crossJoin(F.broadcast(limits)).withColumn("hours", F.col("seconds") / 3600).withColumn("display", display_label(F.col("label"), names or {"": ""}))  # limits are one row


def distribution_difference(natural: DataFrame, windowed: DataFrame) -> DataFrame:
    """(label, natural_pct, windowed_pct, difference) over the labels of either side; a missing one counts as 0."""
    a, b = natural.select("label", F.col("prop_pct").alias("natural_pct")), windowed.select("label", F.col("prop_pct").alias("windowed_pct"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, "label", "full_outer").select("label", zero("natural_pct").alias("natural_pct"), zero("windowed_pct").alias("windowed_pct"), (zero("windowed_pct") - zero("natural_pct")).alias("difference"))


def top_labels(audit: DataFrame, n: int = 5) -> DataFrame:
    return audit.orderBy(F.desc("seconds"), "label").limit(n)


def event_onset(annotations: DataFrame, background: str = BACKGROUND, file: str = "file_path", keep: list[Column] | None = None) -> DataFrame:
    """Per file with a non-background event: onset_s, the earliest event's label, and the first listed one's, upper case."""
    rows = annotations.withColumn("__l", normalise_label(F.col("label"))).where(F.col("__l") != background)
    return rows.groupBy(file).agg(
        F.min("start_time").alias("onset_s"), F.upper(F.min_by("__l", F.struct("start_time", "line_no"))).alias("label"), F.upper(F.min_by("__l", "line_no")).alias("listed_label")
    )
