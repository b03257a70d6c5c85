"""Sampled multichannel signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.functions.numeric import is_finite
from echogrid.schema import InputError, require_columns


def signal_meta(signal: DataFrame, fs: float, t0: float = 0.0) -> DataFrame:
    """(session_id, fs, t0, n_samples, n_channels, duration) of long-form samples."""
    if not fs > 0 or math.isinf(fs):
        raise InputError("InvalidFs", "sampling rate must be positive and finite")
    if not math.isfinite(t0):
        raise InputError("InvalidT0", "t0 must be finite")
    per = signal.groupBy("session_id", "channel_id").agg((F.max("sample_idx") + 1).alias("n"))
    return per.groupBy("session_id").agg(
        F.lit(float(fs)).alias("fs"),
        F.lit(float(t0)).alias("t0"),
        F.max("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_channels"),
        ((F.max("n") - 1) / F.lit(float(fs))).alias("duration"),
    )


def check_signal(signal: DataFrame) -> None:
    """All samples finite and every channel complete and equally long."""
    require_columns(signal, ["session_id", "channel_id", "sample_idx", "v"])
    per = signal.groupBy("session_id", "channel_id").agg(
        F.count_if(~is_finite(F.col("v"))).alias("bad"),
        F.count(F.lit(1)).alias("n"),
        (F.max("sample_idx") + 1).alias("span"),
    )
    s = per.groupBy("session_id").agg(
        F.sum("bad").alias("bad"), F.min("n").alias("lo"), F.max("span").alias("hi")
    ).agg(F.sum("bad").alias("bad"), F.count_if(F.col("lo") != F.col("hi")).alias("ragged")).first()
    if s["bad"]:
        raise InputError("SignalFinite", "signal samples must be finite")
    if s["ragged"]:
        raise InputError("SignalShape", "channels of a session must hold the same samples")


def load_signal(
    spark: SparkSession, path: str, fs: float, t0: float = 0.0, channel_ids: list | None = None
) -> tuple[DataFrame, DataFrame]:
    """(samples, meta) from Parquet with (session_id, channel_id, sample_idx, v).

    Numeric channel ids become strings. ``channel_ids`` renames the channels
    1..n in order and must match their number.
    """
    df = spark.read.parquet(path)
    require_columns(df, ["session_id", "channel_id", "sample_idx", "v"])
    df = df.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("channel_id").cast("string").alias("channel_id"),
        F.col("sample_idx").cast("bigint").alias("sample_idx"),
        F.col("v").cast("double").alias("v"),
    )
    if channel_ids:
        have = df.agg(F.count_distinct("channel_id").alias("n")).first()["n"]
        if have != len(channel_ids):
            raise InputError("ChannelIds", f"{len(channel_ids)} ids for {have} channels")
        names = F.array(*[F.lit(str(c)) for c in channel_ids])
        df = df.withColumn("channel_id", F.element_at(names, F.col("channel_id").cast("int")))
    check_signal(df)
    return df, signal_meta(df, fs, t0)


def wide_to_long(wide: DataFrame, channels: list[str], session: str = "session_id", index: str = "sample_idx") -> DataFrame:
    """One column per channel as long-form samples."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel_id"), F.col(c).cast("double").alias("v")) for c in channels]))
    return wide.select(session, F.col(index).cast("bigint").alias("sample_idx"), each.alias("_e")).select(
        F.col(session).alias("session_id"), "_e.channel_id", "sample_idx", "_e.v"
    )
