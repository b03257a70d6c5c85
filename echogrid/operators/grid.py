"""Uniform time grid, onset and interval rasters, spike counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions import numeric as N
from echogrid.runtime import spread
from echogrid.schema import InputError

BLOCK_BINS = 2048


def check_dt(dt: float) -> None:
    if not dt > 0 or dt == float("inf"):
        raise InputError("InvalidDt", "dt must be a positive finite scalar")


def session_extent(
    events: DataFrame | None, spikes: DataFrame | None = None, durations: DataFrame | None = None
) -> DataFrame:
    """(session_id, extent): max of 0, last spike, last event stop, duration."""
    parts = []
    if events is not None:
        parts.append(events.select("session_id", F.col("t_off").alias("t")))
    if spikes is not None:
        parts.append(spikes.select("session_id", F.col("t")))
    if durations is not None:
        parts.append(durations.select("session_id", F.col("duration").alias("t")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    finite = F.when(N.is_finite(F.col("t")), F.col("t"))
    return both.groupBy("session_id").agg(
        F.greatest(F.lit(0.0), F.max(finite)).alias("extent")
    )


def grid_sizes(extent: DataFrame, dt: float) -> DataFrame:
    """(session_id, n_bins) of the grid that covers each extent."""
    check_dt(dt)
    return extent.select("session_id", N.n_grid_bins(F.col("extent"), dt).alias("n_bins"))


def grid_blocks(sizes: DataFrame, block_bins: int = BLOCK_BINS) -> DataFrame:
    """(session_id, blk, first_bin, last_bin): the grid in fixed-length blocks."""
    b = F.lit(block_bins)
    return sizes.select(
        "session_id",
        "n_bins",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bins") - 1) / b))).alias("blk"),
    ).select(
        "session_id",
        "blk",
        (F.col("blk") * b).alias("first_bin"),
        F.least((F.col("blk") + 1) * b - 1, F.col("n_bins") - 1).alias("last_bin"),
    )


def grid(sizes: DataFrame, dt: float, block_bins: int = BLOCK_BINS, per: DataFrame | None = None) -> DataFrame:
    """(session_id, bin, t): t = bin * dt.

    ``per`` has rows by session_id (models, channels, sizes); the grid is then
    laid out for each of them, with their columns. They meet the blocks, not the
    bins: a join after expanding would be planned by the size of the blocks and
    may send all bins to every worker.

    Blocks are spread before they are expanded, so one long session is not
    expanded by one task.
    """
    check_dt(dt)
    blocks, more = grid_blocks(sizes, block_bins), []
    if per is not None:
        blocks, more = blocks.join(per, "session_id"), [c for c in per.columns if c != "session_id"]
    return (
        spread(blocks, "session_id", "blk", *more)
        .select("session_id", *more, F.explode(F.sequence("first_bin", "last_bin")).alias("bin"))
        .withColumn("t", F.col("bin") * F.lit(float(dt)))
    )


def spike_counts(spikes: DataFrame, sizes: DataFrame, dt: float) -> DataFrame:
    """Non-zero spike counts (session_id, neuron_id, bin, n)."""
    check_dt(dt)
    binned = (
        spikes.join(sizes, "session_id")
        .withColumn("bin", N.edge_bin(F.col("t"), dt, F.col("n_bins")))
        .filter(F.col("bin").isNotNull())
    )
    return binned.groupBy("session_id", "neuron_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def spike_raster(spikes: DataFrame, sizes: DataFrame, dt: float) -> DataFrame:
    """Spike counts on every grid bin of every neuron, zeros included."""
    neurons = spikes.select("session_id", "neuron_id").distinct()
    return grid(sizes, dt, per=neurons).join(
        spike_counts(spikes, sizes, dt), ["session_id", "neuron_id", "bin"], "left"
    ).select("session_id", "neuron_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def rasterize_onsets(points: DataFrame, dt: float, sizes: DataFrame | None = None) -> DataFrame:
    """Distinct (session_id, stream, bin) of onset rows (session_id, stream, t_on).

    A grid built from the same events always holds their onsets; pass
    ``sizes`` when the grid is shorter than the events.
    """
    check_dt(dt)
    hit = points.withColumn("bin", N.onset_bin(F.col("t_on"), dt)).filter(F.col("bin") >= 0)
    hit = hit.select("session_id", "stream", "bin").distinct()
    if sizes is not None:
        hit = hit.join(sizes, "session_id").filter(F.col("bin") < F.col("n_bins")).drop("n_bins")
    return hit


def interval_bins(intervals: DataFrame, sizes: DataFrame, dt: float) -> DataFrame:
    """(session_id, first_bin, last_bin) covered by intervals, clipped to the grid."""
    first, last = N.cover_bins(F.col("t_on"), F.col("t_off"), dt)
    return (
        intervals.filter(N.is_finite(F.col("t_on")) & N.is_finite(F.col("t_off")))
        .filter(F.col("t_off") > F.col("t_on"))
        .join(sizes, "session_id")
        .select(
            "session_id",
            F.greatest(first, F.lit(0)).alias("first_bin"),
            F.least(last, F.col("n_bins") - 1).alias("last_bin"),
        )
        .filter(F.col("first_bin") <= F.col("last_bin"))
    )


def expand_bins(spans: DataFrame, block_bins: int = BLOCK_BINS) -> DataFrame:
    """Distinct (session_id, bin) of bin spans, expanded block by block."""
    b = F.lit(block_bins)
    return (
        spans.withColumn(
            "blk", F.explode(F.sequence(F.floor(F.col("first_bin") / b), F.floor(F.col("last_bin") / b)))
        )
        .repartition("session_id", "blk")
        .select(
            "session_id",
            F.explode(
                F.sequence(
                    F.greatest(F.col("first_bin"), F.col("blk") * b),
                    F.least(F.col("last_bin"), (F.col("blk") + 1) * b - 1),
                )
            ).alias("bin"),
        )
        .distinct()
    )


def with_mask(cells: DataFrame, bad: DataFrame | None) -> DataFrame:
    """Adds ``good``; ``bad`` lists masked (session_id, bin)."""
    if bad is None:
        return cells.withColumn("good", F.lit(True))
    flag = bad.select("session_id", "bin", F.lit(False).alias("_ok")).distinct()
    return cells.join(flag, ["session_id", "bin"], "left").withColumn(
        "good", F.coalesce("_ok", F.lit(True))
    ).drop("_ok")


def seconds(bin_col: Column, dt: float) -> Column:
    return bin_col * F.lit(float(dt))
