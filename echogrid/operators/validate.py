"""Input checks: one aggregate pass each, then an error naming the rule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import numeric as N
from echogrid.schema import InputError, require_columns


def event_report(events: DataFrame, session_duration: float = math.inf, buffer: float = 0.0) -> DataFrame:
    """Counts of rule violations per session."""
    require_columns(events, ["t_on", "t_off"])
    lo, hi = -abs(buffer), session_duration + abs(buffer)
    on, off = F.col("t_on"), F.col("t_off")
    bad = ~N.is_finite(on) | ~N.is_finite(off)
    if math.isinf(session_duration):
        outside = F.lit(False)
    else:
        outside = (on < F.lit(lo)) | (off > F.lit(hi)) | (on > F.lit(hi)) | (off < F.lit(lo))
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(bad).alias("n_not_finite"),
        F.count_if(~bad & (off < on)).alias("n_inverted"),
        F.count_if(~bad & outside).alias("n_out_of_bounds"),
    )


def spike_report(
    spikes: DataFrame,
    order: str = "ord",
    chunk: Column | None = None,
    session_duration: float = math.inf,
    buffer: float = 0.0,
) -> DataFrame:
    """Counts of non-finite, out-of-order and out-of-bounds spikes.

    ``chunk`` must rise with ``order``. Steps inside a chunk are compared row by
    row; steps between chunks compare each chunk's first time with the last
    time of the chunk before it.
    """
    require_columns(spikes, ["session_id", "t", order])
    chunk = F.floor(F.col(order) / F.lit(100_000)) if chunk is None else chunk
    t = F.col("t")
    lo, hi = -abs(buffer), session_duration + abs(buffer)
    outside = F.lit(False) if math.isinf(session_duration) else (t < F.lit(lo)) | (t > F.lit(hi))
    w = Window.partitionBy("session_id", "_c").orderBy(order)
    local = (
        spikes.withColumn("_c", chunk)
        .withColumn("_step", F.lag("t").over(w) > t)
        .groupBy("session_id", "_c")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~N.is_finite(t)).alias("n_not_finite"),
            F.count_if("_step").alias("n_unsorted"),
            F.count_if(outside).alias("n_out_of_bounds"),
            F.min_by("t", order).alias("_first"),
            F.max_by("t", order).alias("_last"),
        )
    )
    ws = Window.partitionBy("session_id").orderBy("_c")
    seam = (F.lag("_last").over(ws) > F.col("_first")).cast("long")
    return (
        local.withColumn("_seam", F.coalesce(seam, F.lit(0)))
        .groupBy("session_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_not_finite").alias("n_not_finite"),
            F.sum(F.col("n_unsorted") + F.col("_seam")).alias("n_unsorted"),
            F.sum("n_out_of_bounds").alias("n_out_of_bounds"),
        )
    )


def validate_inputs(
    spikes: DataFrame,
    events: DataFrame,
    session_duration: float = math.inf,
    buffer: float = 0.0,
    order: str = "ord",
) -> None:
    """Raise on the first broken rule; returns nothing when all hold."""
    s = spike_report(spikes, order, None, session_duration, buffer).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_not_finite", "n_unsorted", "n_out_of_bounds")]
    ).first()
    e = event_report(events, session_duration, buffer).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_not_finite", "n_inverted", "n_out_of_bounds")]
    ).first()
    if s["n_not_finite"]:
        raise InputError("SpikeTimesFinite", "spike times must be finite")
    if s["n_unsorted"]:
        raise InputError("SpikeTimesOrder", "spike times must be non-decreasing")
    if e["n_not_finite"]:
        raise InputError("EventTimesFinite", "event times must be finite")
    if e["n_inverted"]:
        raise InputError("EventTimesOrder", "event offsets must not precede onsets")
    if s["n_out_of_bounds"] or e["n_out_of_bounds"]:
        raise InputError("TimeBounds", "times fall outside the session bounds")


def dead_signal_report(binned: DataFrame) -> DataFrame:
    """Spread and peak per channel of a binned signal (session, channel, bin, v)."""
    return binned.groupBy("session_id", "channel_id").agg(
        F.stddev_samp("v").alias("std"), F.max(F.abs("v")).alias("peak")
    )


def require_live_signal(binned: DataFrame, threshold: float = 1e-10) -> None:
    """Raise when all channels of a session are flat; an empty table has no live session either."""
    best = dead_signal_report(binned).groupBy("session_id").agg(F.max(F.coalesce("std", F.lit(0.0))).alias("most"))
    found = best.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("most") < threshold, F.col("session_id"))).alias("dead")).first()
    if found["n"] == 0 or found["dead"] is not None:
        raise InputError("DeadSignal", f"all channels are flat in session {found['dead']}")
