"""Fit metrics, roll-ups and the Wald comparison of states."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.config import SIGNIFICANCE_LEVEL
from echogrid.functions import numeric as N
from echogrid.operators.moments import unpack_sym

NAN = float("nan")


def poisson_metrics(rows: DataFrame, keys: list[str], y: str = "y", mu: str = "mu") -> DataFrame:
    """nll (with ln y!), pseudoR2 and deviance explained, one pass per key."""
    yc = F.col(y).cast("double")
    m = F.greatest(F.col(mu), F.lit(N.EPS))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(yc).alias("_sy"),
        F.sum(m - yc * F.log(m) + N.log_factorial(yc)).alias("nll"),
        F.sum(yc * F.log(m) - m).alias("_model"),
        F.sum(F.when(yc > 0, yc * F.log(yc) - yc).otherwise(F.lit(0.0))).alias("_sat"),
    )
    base = F.greatest(F.col("_sy") / F.col("_n"), F.lit(N.EPS))
    null = F.col("_sy") * F.log(base) - F.col("_n") * base
    room = F.col("_sat") - null
    # The two sums cancel exactly only in exact arithmetic.
    flat = F.abs(room) <= 1e-12 * (F.abs(F.col("_sat")) + F.abs(null))
    r2 = F.when(flat, F.lit(NAN)).otherwise(1 - (F.col("_sat") - F.col("_model")) / F.when(~flat, room))
    return sums.select(*keys, "nll", r2.alias("pseudoR2"), r2.alias("deviance_explained"))


def signal_metrics(rows: DataFrame, keys: list[str], y: str = "y", pred: str = "mu") -> DataFrame:
    """mse, rmse, r2, correlation, mae, explained variance, one pass per key."""
    a, b = F.col(y), F.col(pred)
    r = a - b
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(r * r).alias("mse"),
        F.avg(F.abs(r)).alias("mae"),
        F.var_samp(a).alias("_va"),
        F.var_samp(b).alias("_vb"),
        F.var_samp(r).alias("_vr"),
        F.covar_samp(a, b).alias("_cab"),
        F.avg(a).alias("_ma"),
        F.avg(b).alias("_mb"),
    )
    nan = F.lit(NAN)
    va, vb, n = F.coalesce("_va", F.lit(0.0)), F.coalesce("_vb", F.lit(0.0)), F.col("_n")
    still = F.when((va == 0) & (vb == 0) & (F.col("_ma") == F.col("_mb")), 1.0).otherwise(0.0)
    corr = F.when((va > 0) & (vb > 0), F.try_divide("_cab", F.sqrt(va) * F.sqrt(vb))).otherwise(still)
    total = va * (n - 1)
    return s.select(
        *keys,
        "mse",
        F.sqrt("mse").alias("rmse"),
        F.when(total > 0, 1 - F.try_divide(F.col("mse") * n, total)).otherwise(nan).alias("r2"),
        corr.alias("correlation"),
        "mae",
        F.when(va > 0, 1 - F.try_divide(F.col("_vr"), va)).otherwise(nan).alias("explained_variance"),
    )


def significance_rollup(ptest: DataFrame, keys: list[str], level: float = SIGNIFICANCE_LEVEL) -> DataFrame:
    """Kernels tested, kernels significant and their names per key; non-finite p are skipped."""
    hit = F.col("p_value") < level
    return ptest.filter(N.is_finite(F.col("p_value"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_kernels"),
        F.count_if(hit).alias("n_significant"),
        F.array_sort(F.collect_list(F.when(hit, F.col("block")))).alias("hits"),
    )


def significance_totals(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: models, models with a hit and their names, kernels tested and significant."""
    any_hit = F.col("n_significant") > 0
    return rollup.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if(any_hit).alias("n_models_hit"),
        F.array_sort(F.collect_list(F.when(any_hit, F.col("model_id")))).alias("models_hit"),
        F.sum("n_kernels").alias("n_kernels"),
        F.sum("n_significant").alias("n_significant"),
    )


def channel_r2_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median r2 over channels, undefined ones left out."""
    ok = metrics.filter(N.is_finite(F.col("r2")))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_channels"), F.avg("r2").alias("mean_r2"), F.percentile("r2", 0.5).alias("median_r2")
    )


def grade(r2):
    """Quality band of a channel."""
    return F.when(r2 > 0.3, "GOOD").when(r2 > 0.1, "FAIR").otherwise("POOR")


def weight_norm(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Euclidean norm of weights (keys, w array)."""
    return weights.select(*keys, F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)).alias("weight_norm"))


def wald_contrast(fits: DataFrame, keys: list[str], a: int, b: int) -> DataFrame:
    """(keys, difference, z_score, p_value) of w[a] - w[b] by the inverse packed Hessian; null where there is none."""
    kinds = dict(fits.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", difference double, z_score double, p_value double"

    def row(w: np.ndarray, packed: np.ndarray) -> tuple[float | None, ...]:
        h = unpack_sym(packed, len(w))
        pick = np.zeros(len(w))
        pick[a], pick[b] = 1.0, -1.0
        try:
            variance = float(pick @ np.linalg.solve(h, pick))
        except np.linalg.LinAlgError:
            variance = 0.0
        if not variance > 0:
            return None, None, None
        gap = float(pick @ w)
        z = gap / math.sqrt(variance)
        return gap, z, math.erfc(abs(z) / math.sqrt(2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [row(np.asarray(w, float), np.asarray(h, float)) for w, h in zip(pdf["w"], pdf["hessian"], strict=True)]
            yield pd.concat(
                [pdf[keys], pd.DataFrame(found, columns=["difference", "z_score", "p_value"], index=pdf.index, dtype=float)], axis=1
            )

    return fits.select(*keys, "w", "hessian").mapInPandas(run, schema)
