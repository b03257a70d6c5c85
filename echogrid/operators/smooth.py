"""Smoothing, decimation, resampling and normalising of gridded series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.config import round_half_away
from echogrid.runtime import spread
from echogrid.schema import InputError


def smooth_decimate(
    series: DataFrame,
    sizes: DataFrame,
    dt: float,
    keys: list[str],
    values: list[str],
    sigma_s: float = 0.05,
    step_s: float = 0.1,
) -> DataFrame:
    """Gaussian-smoothed series per second at every step: (keys, bin, values).

    Kernel of +-3 sigma, zero padded; only centres that fit the grid are kept.
    Each value is sent just to the kept centres it reaches, so the full-rate
    smooth series is never formed. ``series`` may leave out zero bins.
    """
    sigma = max(1, round_half_away(sigma_s / dt))
    h = 3 * sigma
    norm = sum(math.exp(-0.5 * (i / sigma) ** 2) for i in range(-h, h + 1))
    k = max(1, round_half_away(step_s / dt))
    b = F.col("bin")
    lo = F.greatest(F.ceil((b - 2 * h) / F.lit(float(k))), F.lit(0))
    hi = F.floor(b / F.lit(float(k)))
    reach = series.withColumn("_j", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array())))
    centre = F.col("_j") * k + h
    g = F.exp(F.lit(-0.5) * F.pow((b - centre) / F.lit(float(sigma)), F.lit(2.0))) / F.lit(norm * dt)
    hit = (
        reach.join(sizes, "session_id")
        .filter(centre <= F.col("n_bins") - h - 1)
        .select(*keys, centre.alias("centre"), *[(F.col(v) * g).alias(v) for v in values])
    )
    return hit.groupBy(*keys, F.col("centre").alias("bin")).agg(*[F.sum(v).alias(v) for v in values])


def resample_linear(
    signal: DataFrame, meta: DataFrame, sizes: DataFrame, dt: float, keys: list[str], parts: int | None = None
) -> DataFrame:
    """Linear interpolation of samples onto grid bins: (keys, bin, v).

    ``meta`` has (session_id, fs, t0, n_samples). A sample reaches the bins
    between its neighbours with a falling weight, so no join of samples with
    bins is needed. Bins outside the recording are left out (zero).
    """
    d = F.lit(float(dt))
    s = signal.join(meta, "session_id").join(sizes, "session_id")
    i, fs, t0 = F.col("sample_idx"), F.col("fs"), F.col("t0")
    lo = F.greatest(F.floor((t0 + (i - 1) / fs) / d), F.lit(0))
    hi = F.least(F.ceil((t0 + (i + 1) / fs) / d), F.col("n_bins") - 1)
    each = s.withColumn("bin", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array())))
    x = (F.col("bin") * d - t0) * fs
    w = 1 - F.abs(x - i)
    inside = (x >= 0) & (x <= F.col("n_samples") - 1)
    near = each.filter(inside & (w > 0)).select(*keys, "bin", (F.col("v") * w).alias("v"))
    if parts is not None:
        near = spread(near, *keys, "bin", parts=parts)
    return near.groupBy(*keys, "bin").agg(F.sum("v").alias("v"))


def normalize(series: DataFrame, n_rows: DataFrame, keys: list[str], mode: str = "zscore") -> DataFrame:
    """z-score or min-max per key over all ``n_rows`` grid rows, absent rows zero.

    Flat series pass through. Returns only rows present in ``series``; for a
    dense result pass a dense series.
    """
    if mode == "none":
        return series
    if mode not in ("zscore", "minmax"):
        raise InputError("InvalidNormalize", f"unknown normalization mode {mode!r}")
    v = F.col("v")
    stats = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(v).alias("_s"), F.avg(v).alias("_m"),
        F.var_pop(v).alias("_vp"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
    ).join(n_rows, [k for k in keys if k in n_rows.columns])
    n = F.col("n_rows").cast("double")
    mean = F.col("_s") / n
    c = F.col("_c")
    # Spread around the full mean: present rows plus the implicit zeros.
    ss = c * (F.col("_vp") + F.pow(F.col("_m") - mean, F.lit(2.0))) + (n - c) * mean * mean
    sd = F.sqrt(ss / F.greatest(n - 1, F.lit(1.0)))
    sparse = c < F.col("n_rows")
    lo = F.when(sparse, F.least(F.col("_lo"), F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(sparse, F.greatest(F.col("_hi"), F.lit(0.0))).otherwise(F.col("_hi"))
    if mode == "zscore":
        stats = stats.select(*keys, mean.alias("_shift"), F.when(sd > 0, sd).otherwise(F.lit(None)).alias("_scale"))
    else:
        stats = stats.select(*keys, lo.alias("_shift"), F.when(hi > lo, hi - lo).otherwise(F.lit(None)).alias("_scale"))
    scaled = (v - F.col("_shift")) / F.col("_scale")
    return series.join(stats, keys).withColumn("v", F.coalesce(scaled, v)).drop("_shift", "_scale")
