"""Writers: label tracks, fit datasets and QC reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.functions import labels as L
from echogrid.functions import numeric as N
from echogrid.operators.events import repaired_stop


def write_label_track(segments: DataFrame, path: str, label: str = "state", partition_by: str | None = None) -> None:
    """Tab-separated label lines, sorted by onset inside each output file.

    Rows are range-partitioned by time, so reading the files in name order
    gives the sorted track. With ``partition_by`` each value gets its own track.
    """
    keys = [partition_by] if partition_by else []
    lines = segments.filter(N.is_finite(F.col("t_on"))).select(
        *keys, "t_on", "t_off", L.track_line(F.col("t_on"), F.col("t_off"), F.col(label)).alias("value")
    )
    order = [*keys, "t_on", "t_off"]
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = lines.select(*keys, "value")
    writer = lines.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.text(path)


def bout_track(events: DataFrame) -> DataFrame:
    """Kept bout starts as label rows with one fixed label and repaired stops."""
    stop = repaired_stop(F.col("t_on"), F.col("t_off"))
    return events.filter(L.is_bout_label(F.col("label")) & (F.col("kind") == "produced")).select(
        "session_id", "t_on", F.greatest(stop, F.col("t_on")).alias("t_off"), F.lit("twitter_bout").alias("label")
    )


def plain_track(events: DataFrame, with_label: bool = True) -> DataFrame:
    """Two- or three-column lines of events."""
    line = "%.6f\t%.6f\t%s" if with_label else "%.6f\t%.6f"
    cols = [F.col("t_on"), F.col("t_off")] + ([F.col("label")] if with_label else [])
    return events.select("session_id", "t_on", F.format_string(line, *cols).alias("line"))


def write_fit(parts: dict[str, DataFrame], path: str, partition_by: str | None = None) -> None:
    """One Parquet dataset per named part under ``path``."""
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(os.path.join(path, name))


def write_qc(summary: DataFrame, path: str) -> None:
    """QC rows as JSON lines, written by Spark to any path."""
    summary.write.mode("overwrite").json(path)
