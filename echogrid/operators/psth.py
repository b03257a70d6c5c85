"""Peri-event spike histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import numeric as N
from echogrid.operators.scan import DEFAULT_CHUNK_S, chunk_of, emit_to_chunks
from echogrid.runtime import spread
from echogrid.schema import InputError


def peri_edges(window: tuple[float, float], bin_size: float) -> list[float]:
    """Edges from t0 in steps of bin_size; the last edge is exactly t1."""
    t0, t1 = float(window[0]), float(window[1])
    if not bin_size > 0:
        raise InputError("BinSize", "bin_size must be positive")
    if t1 <= t0:
        raise InputError("Window", "window must end after it starts")
    n = int(math.floor((t1 - t0) / bin_size + 1e-10))
    edges = [t0 + i * bin_size for i in range(n + 1)]
    if edges[-1] < t1 - 1e-10 * bin_size:
        edges.append(t1)
    else:
        edges[-1] = t1
    return edges


def align_spikes(
    spikes: DataFrame,
    events: DataFrame,
    window: tuple[float, float],
    bin_size: float,
    keep: list[str] | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
    parts: int | None = None,
) -> DataFrame:
    """Counts per (session, neuron, event, peri-event bin), zeros included.

    Instead of pairing events with spikes, every bin edge of every event looks
    up how many spikes precede it in its chunk; a bin is the difference of two
    edges. Work is events x edges + spikes however dense a session is. Edges and
    counts are dealt over ``parts`` partitions; events are spread before they
    are expanded, and counts are added up in a chunk before they move.
    """
    keep = keep or []
    edges = peri_edges(window, bin_size)
    width = edges[-1] - edges[0]
    if width > chunk_s:
        chunk_s = width
    times = spikes.groupBy("session_id", "neuron_id", "t").agg(F.count(F.lit(1)).alias("m"))
    neurons = times.select("session_id", "neuron_id").distinct()
    rows = emit_to_chunks(times, F.col("t") - F.lit(width), F.col("t"), chunk_s).select(
        "session_id", "neuron_id", "chunk", F.col("t").alias("_k"), F.lit(0).alias("_side"), "t", "m"
    )
    start = F.col("t_on") + F.lit(edges[0])
    ask = spread(events.join(neurons, "session_id"), "session_id", "neuron_id", "ev_ord", parts=parts).select(
        "session_id",
        "neuron_id",
        "ev_ord",
        *keep,
        "t_on",
        chunk_of(start, chunk_s).alias("chunk"),
        F.posexplode(F.array(*[F.lit(e) for e in edges])).alias("edge", "x"),
    )
    key = F.col("t_on") + F.col("x")
    ask = ask.withColumn("_k", key + 4 * N.spacing(key)).withColumn("_side", F.lit(1))
    w = (
        Window.partitionBy("session_id", "neuron_id", "chunk")
        .orderBy("_k", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        spread(rows.unionByName(ask, allowMissingColumns=True), "session_id", "neuron_id", "chunk", parts=parts)
        .withColumn("_c", F.coalesce(F.sum("m").over(w), F.lit(0)))
        .withColumn("_near", F.last(F.when(F.col("m").isNotNull(), F.struct("t", "m")), ignorenulls=True).over(w))
        .filter(F.col("edge").isNotNull())
    )
    # The key looks a few ulp ahead; a spike that is not strictly below the
    # edge by the difference test is taken off again.
    at_or_after = F.col("_near.t") - F.col("t_on") >= F.col("x")
    below = F.col("_c") - F.when(at_or_after, F.col("_near.m")).otherwise(0)
    n_bins = len(edges) - 1
    signed = found.select(
        "session_id",
        "neuron_id",
        "chunk",
        "ev_ord",
        *keep,
        F.explode(
            F.array(
                F.struct((F.col("edge") - 1).alias("b"), below.alias("v")),
                F.struct(F.col("edge").alias("b"), (-below).alias("v")),
            )
        ).alias("s"),
    ).filter((F.col("s.b") >= 0) & (F.col("s.b") < n_bins))
    local = signed.groupBy("session_id", "neuron_id", "chunk", "ev_ord", *keep, F.col("s.b").alias("bin")).agg(F.sum("s.v").alias("n"))
    return (
        spread(local, "session_id", "neuron_id", "ev_ord", parts=parts)
        .groupBy("session_id", "neuron_id", "ev_ord", *keep, "bin")
        .agg(F.sum("n").alias("n"))
    )


def zscore_trials(counts: DataFrame) -> DataFrame:
    """Counts z-scored per trial across its bins; flat trials become 0."""
    w = Window.partitionBy("session_id", "neuron_id", "ev_ord")
    sd = F.stddev_samp("n").over(w)
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col("n") - F.avg("n").over(w)) / F.nullif(sd, F.lit(0.0)))
    return counts.withColumn("z", z)


def psth(
    counts: DataFrame, bin_size: float, keys: list[str], zscore: bool = False
) -> DataFrame:
    """(keys, bin, n_trials, mean, sem) over trials; sem is 0 for one trial."""
    if zscore:
        rate = F.col("z")
        counts = zscore_trials(counts)
    else:
        rate = F.col("n") / F.lit(float(bin_size))
    return counts.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg(rate).alias("mean"),
        F.coalesce(F.stddev_samp(rate) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("sem"),
    )


def moving_mean(value: Column, keys: list[str], order: str, width: int) -> Column:
    """Centred moving mean that shrinks at the ends."""
    before = width // 2
    after = width - before - 1
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after))


def smoothed_psth(rates: DataFrame, keys: list[str], smoothing_bins: int = 3) -> DataFrame:
    """Adds smoothed mean and sem for display."""
    if smoothing_bins <= 1:
        return rates.withColumn("mean_plot", F.col("mean")).withColumn("sem_plot", F.col("sem"))
    return rates.withColumn(
        "mean_plot", moving_mean(F.col("mean"), keys, "bin", smoothing_bins)
    ).withColumn("sem_plot", moving_mean(F.col("sem"), keys, "bin", smoothing_bins))
