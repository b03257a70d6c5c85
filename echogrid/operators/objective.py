"""Objectives, gradients and predictions at given weights, from the long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions.numeric import RATE_CAP, clip_eta

KEYS = ["session_id", "model_id"]


def linear_predictor(coo: DataFrame, weights: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """(keys, bin, eta) of bins with cells; weights per (keys, col) or a column expression."""
    if weights is not None:
        coo = coo.join(weights, [*KEYS, "col"])
        weight = F.col("w")
    return coo.groupBy(*KEYS, "bin").agg(F.sum(F.col("val") * weight).alias("eta"))


def with_response(eta: DataFrame, response: DataFrame) -> DataFrame:
    """Bins with cells or responses: (keys, bin, eta, y), zeros filled in."""
    y = response.select(*KEYS, "bin", F.col("y").cast("double").alias("y"))
    return eta.join(y, [*KEYS, "bin"], "full").select(
        *KEYS, "bin", F.coalesce("eta", F.lit(0.0)).alias("eta"), F.coalesce("y", F.lit(0.0)).alias("y")
    )


def poisson_objective(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(keys, nll): sum of mu - y*eta over all bins; empty bins add exp(0) each."""
    e = clip_eta(F.col("eta"))
    part = cells.groupBy(*KEYS).agg(
        F.sum(F.exp(e) - F.col("y") * e).alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    return part.join(sizes, "session_id").select(*KEYS, (F.col("_s") + F.col("n_bins") - F.col("_c")).alias("nll"))


def gaussian_objective(cells: DataFrame, sizes: DataFrame, link: str = "identity") -> DataFrame:
    """(keys, nll): half the squared residuals over all bins."""
    if link == "identity":
        r, empty = F.col("y") - F.col("eta"), 0.0
    elif link == "log":
        r, empty = F.col("y") - F.exp(clip_eta(F.col("eta"))), 0.5
    else:
        raise ValueError("link must be 'identity' or 'log'")
    part = cells.groupBy(*KEYS).agg(F.sum(0.5 * r * r).alias("_s"), F.count(F.lit(1)).alias("_c"))
    return part.join(sizes, "session_id").select(
        *KEYS, (F.col("_s") + F.lit(empty) * (F.col("n_bins") - F.col("_c"))).alias("nll")
    )


def gradient(coo: DataFrame, cells: DataFrame, family: str = "poisson") -> DataFrame:
    """(keys, col, grad): X'(mu - y), or X'((mu - y) mu) for the Gaussian log link."""
    e = clip_eta(F.col("eta"))
    if family == "poisson":
        r = F.exp(e) - F.col("y")
    elif family == "identity":
        r = F.col("eta") - F.col("y")
    else:
        r = (F.exp(e) - F.col("y")) * F.exp(e)
    part = cells.select(*KEYS, "bin", r.alias("_r"))
    return coo.join(part, [*KEYS, "bin"]).groupBy(*KEYS, "col").agg(F.sum(F.col("val") * F.col("_r")).alias("grad"))


def row_weight(eta: Column, family: str) -> Column:
    """Hessian weight per bin: capped mu, or its square for the Gaussian log link."""
    mu = F.least(F.exp(eta if family == "poisson" else clip_eta(eta)), F.lit(RATE_CAP))
    return mu if family == "poisson" else mu * mu


def weighted_gram(coo: DataFrame, cells: DataFrame, family: str = "poisson") -> DataFrame:
    """(keys, i, j, h), i <= j: X' diag(weight) X, pairs formed within a row."""
    rows = coo.groupBy(*KEYS, "bin").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("r"))
    rows = rows.join(cells.select(*KEYS, "bin", row_weight(F.col("eta"), family).alias("_w")), [*KEYS, "bin"])
    return (
        rows.select(*KEYS, "r", "_w", F.posexplode("r").alias("a", "x"))
        .select(*KEYS, "_w", "x", F.explode(F.expr("slice(r, a + 1, size(r))")).alias("z"))
        .groupBy(*KEYS, F.col("x.col").alias("i"), F.col("z.col").alias("j"))
        .agg(F.sum(F.col("_w") * F.col("x.val") * F.col("z.val")).alias("h"))
    )


def predict_bins(eta: DataFrame, grid: DataFrame, link: str = "log") -> DataFrame:
    """(keys, bin, mu) on every bin of a grid laid out per model."""
    full = grid.select(*KEYS, "bin").join(eta, [*KEYS, "bin"], "left")
    e = F.coalesce("eta", F.lit(0.0))
    return full.select(*KEYS, "bin", (F.exp(clip_eta(e)) if link == "log" else e).alias("mu"))


def second_difference(values: DataFrame, keys: list[str], order: str, value: str, length: Column) -> DataFrame:
    """(keys, order, d2): v(i) - 2 v(i+1) + v(i+2) for i in 0..length-3 wherever one of the three has a row.

    Positions without a row count as zero. Each value is added to the three
    differences it is part of, so nothing is ordered and a long series combines
    on the map side.
    """
    i = F.col(order)
    stencil = F.array(*[F.struct((i - k).alias("at"), F.lit(c).alias("c")) for k, c in enumerate((1.0, -2.0, 1.0))])
    return (
        values.select(*keys, F.col(value).alias("_v"), length.alias("_n"), F.explode(stencil).alias("s"))
        .filter((F.col("s.at") >= 0) & (F.col("s.at") <= F.col("_n") - 3))
        .groupBy(*keys, F.col("s.at").alias(order))
        .agg(F.sum(F.col("_v") * F.col("s.c")).alias("d2"))
    )


def penalty_energy(weights: DataFrame, penalty: DataFrame) -> DataFrame:
    """(keys, block, energy): squared length of the penalty rows applied to (keys, col, w); absent weights are zero."""
    applied = (
        weights.join(penalty, "col")
        .groupBy(*KEYS, "block", "row")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("_d"))
    )
    return applied.groupBy(*KEYS, "block").agg(F.sum(F.col("_d") * F.col("_d")).alias("energy"))
