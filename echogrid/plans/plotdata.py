"""Data behind each figure, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.functions import labels as L
from echogrid.operators import events as E
from echogrid.operators import psth as P
from echogrid.operators import smooth as SM
from echogrid.operators import streams as S
from echogrid.operators.basis import ColumnMap

def design_preview(coo: DataFrame, colmap: ColumnMap, first: int = 0, last: int = 50) -> DataFrame:
    """Cells of columns ``first`` to ``last`` (left out) with their labels; the range is the caller's choice."""
    label = F.element_at(F.array(*[F.lit(n) for n in colmap.column_names()]), F.col("col") + 1)
    return coo.filter((F.col("col") >= first) & (F.col("col") < last)).withColumn("label", label)


def kernel_panels(kernels: DataFrame, ptest: DataFrame | None = None, ci: DataFrame | None = None) -> DataFrame:
    """Kernels with their null interval and a dashed flag when not significant."""
    keys = ["session_id", "model_id", "block"]
    out = kernels
    if ptest is not None:
        out = out.join(ptest, keys, "left").withColumn("dashed", F.col("p_value") >= 0.05)
    if ci is not None:
        out = out.join(ci, [*keys, "pos"], "left")
    return out.withColumn("title", L.display_name(F.col("block")))


def cv_curve(cv: DataFrame) -> DataFrame:
    """Mean and spread of the held-out metric per lambda."""
    return cv.groupBy("session_id", "model_id", "lambda_idx", "lambda").agg(
        F.avg("metric").alias("mean_metric"), F.min("metric").alias("lo"), F.max("metric").alias("hi")
    )


def rate_series(rates: DataFrame, sizes: DataFrame, dt: float) -> DataFrame:
    """Observed and predicted rates, smoothed and decimated, per second."""
    out = SM.smooth_decimate(rates, sizes, dt, ["session_id", "model_id"], ["y", "mu"])
    return out.withColumn("t", F.col("bin") * dt)


def psth_panels(spikes: DataFrame, events: DataFrame, cfg: dict) -> DataFrame:
    """Smoothed histograms of heard events and of each produced category."""
    dt = cfg["dt"]
    heard = E.select_kind(events, "perceived").withColumn("panel", F.lit("heard"))
    if (cfg.get("produced_split_mode") or "context") == "context":
        made = E.label_events(events, E.produced_context(E.instants(events)), "produced").withColumnRenamed("stream", "panel")
    else:
        made = E.select_kind(events, "produced").withColumn("panel", L.call_type_stream(F.col("label")))
    keys = ["session_id", "neuron_id", "panel"]
    out = None
    for part, window in ((heard, cfg["heard_window_s"]), (made, cfg["produced_window_s"])):
        one = P.psth(P.align_spikes(spikes, part, tuple(window), dt, ["panel"]), dt, keys)
        out = one if out is None else out.unionByName(one)
    return P.smoothed_psth(out, keys)


def prediction_window(rates: DataFrame, dt: float, start: float, length: float) -> DataFrame:
    """Observed and predicted rates in Hz inside a closed time window."""
    t = F.col("bin") * F.lit(float(dt))
    return (
        rates.withColumn("t", t)
        .filter(t.between(start, start + length))
        .select("session_id", "model_id", "t", (F.col("y") / dt).alias("observed_hz"), (F.col("mu") / dt).alias("predicted_hz"))
    )


def event_boxes(events: DataFrame, start: float, length: float) -> DataFrame:
    """Events that touch the window, clipped to it; empty boxes dropped."""
    end = start + length
    return (
        events.filter((F.col("t_off") >= start) & (F.col("t_on") <= end))
        .withColumn("t_on", F.greatest("t_on", F.lit(float(start))))
        .withColumn("t_off", F.least("t_off", F.lit(float(end))))
        .filter("t_off > t_on")
    )


def event_preview(rates: DataFrame, events: DataFrame, dt: float, kind: str = "produced", n: int = 5, before: float = 10.0, after: float = 10.0) -> DataFrame:
    """Prediction around the n-th event of a kind in every session."""
    at = S.nth_event(events, kind, n).select("session_id", F.col("t_on").alias("event_t"))
    t = F.col("bin") * F.lit(float(dt))
    return (
        rates.join(at, "session_id")
        .withColumn("t", t)
        .filter((t >= F.col("event_t") - before) & (t <= F.col("event_t") + after))
        .select("session_id", "model_id", "event_t", "t", (F.col("y") / dt).alias("observed_hz"), (F.col("mu") / dt).alias("predicted_hz"))
    )


def r2_by_channel(metrics: DataFrame) -> DataFrame:
    """Channels with their r2, ordered for a bar chart."""
    return metrics.select("session_id", "model_id", "r2").orderBy("session_id", "model_id")


def traces(predictions: DataFrame, dt: float) -> DataFrame:
    """Actual and predicted trace per channel."""
    return predictions.select("session_id", "model_id", (F.col("bin") * dt).alias("t"), F.col("y").alias("actual"), F.col("mu").alias("predicted"))
