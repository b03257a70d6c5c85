"""Penalised GLM fits: Gaussian from moments, Poisson and log-link by Newton.

Gaussian models are solved where their moments land: p x p numbers of one
model, never its rows. The others are jobs of the Newton solver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.operators.basis import ColumnMap
from echogrid.operators.features import block_matrix, fold_of
from echogrid.operators.moments import pack_sym, split_moments, sum_vectors
from echogrid.operators.newton import MODEL, bucket_of, by_lane, models_of, new_jobs, newton_fit, rate, together
from echogrid.runtime import materialize, spread


def min_norm_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution; directions the data cannot identify stay 0."""
    if a.size == 0:
        return np.zeros(b.shape)
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def penalty(w: np.ndarray, d: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """lam * |Dw|^2 and its gradient."""
    if lam == 0 or d.size == 0:
        return 0.0, np.zeros(w.shape)
    dw = d @ w
    return float(lam * (dw @ dw)), 2 * lam * (d.T @ dw)


# ---- standardising -----------------------------------------------------------


def scaling(n: float, sx: np.ndarray, gram: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column means and spreads from moments; ``keep`` marks untouched columns."""
    mean = sx / n
    var = np.maximum((np.diag(gram) - n * mean**2) / max(n - 1, 1), 0.0)
    std = np.sqrt(var)
    # Cancellation leaves a tiny positive variance on constant columns.
    flat = std < np.maximum(1e-10, 1e-8 * np.abs(mean))
    std = np.where(flat, 1.0, std)
    return np.where(keep, 0.0, mean), np.where(keep, 1.0, std)


def scaled_moments(mom, mean: np.ndarray, std: np.ndarray):
    """Moments of (x - mean) / std from moments of x."""
    n, sy, yy, sx, xty, g = mom
    g2 = (g - np.outer(mean, sx) - np.outer(sx, mean) + n * np.outer(mean, mean)) / np.outer(std, std)
    return n, sy, yy, (sx - n * mean) / std, (xty - mean * sy) / std, g2


# ---- Gaussian, identity link -------------------------------------------------


@dataclass
class Ridge:
    """Solver of one Gaussian problem from (X'X, X'y).

    The closed form weighs the penalty with lam; the iterative form, like the
    objective and Hessian, with 2 * lam.
    """

    d: np.ndarray
    form: str = "closed_form"

    def fit(self, gram: np.ndarray, xty: np.ndarray, lam: float) -> np.ndarray:
        factor = 1.0 if self.form == "closed_form" and lam > 0 else 2.0
        return min_norm_solve(gram + factor * lam * (self.d.T @ self.d), xty)


Fitter = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def gauss_cv_fit(
    moments: DataFrame,
    colmap: ColumnMap,
    d: np.ndarray,
    lambdas: list[float],
    standardize: bool = True,
    fitter: Fitter | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validated Gaussian fits of all models: (fit rows, cv rows).

    Training moments of a fold are the totals minus the fold, so one pass over
    the data serves every lambda and fold. Standardising uses all rows.
    """
    p = colmap.p
    solve = fitter or Ridge(d).fit
    icept = colmap.get("intercept")
    keep = np.zeros(p, dtype=bool)
    if icept is not None:
        keep[icept.first] = True
    if not standardize:
        keep[:] = True

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mom = {int(r.fold): split_moments(r.vec, p) for r in pdf.itertuples(index=False)}
        total = tuple(sum(parts) for parts in zip(*mom.values()))
        mean, std = scaling(total[0], total[3], total[5], keep)
        mom = {f: scaled_moments(m, mean, std) for f, m in mom.items()}
        tot = scaled_moments(total, mean, std)
        scores = np.full((len(lambdas), len(mom)), np.nan)
        for i, lam in enumerate(lambdas):
            for j, f in enumerate(sorted(mom)):
                n, _, yy, _, xty, g = mom[f]
                w = solve(tot[5] - g, tot[4] - xty, lam)
                scores[i, j] = max(yy - 2 * w @ xty + w @ g @ w, 0.0) / n
        best = int(np.argmin(scores.mean(axis=1)))
        lam = lambdas[best]
        w = solve(tot[5], tot[4], lam)
        dtd = d.T @ d
        resid = max(tot[2] - 2 * w @ tot[4] + w @ tot[5] @ w, 0.0)
        pen, pen_grad = penalty(w, d, lam)
        a = tot[5] + lam * dtd
        return pd.DataFrame(
            {
                "session_id": [pdf.session_id.iloc[0]],
                "model_id": [pdf.model_id.iloc[0]],
                "n_rows": [int(tot[0])],
                "sum_y": [float(total[1])],
                "best_lambda": [float(lam)],
                "w": [w],
                "mean": [mean],
                "std": [std],
                "nll": [0.5 * resid + pen],
                "gradient": [tot[5] @ w - tot[4] + pen_grad],
                "hessian": [pack_sym(tot[5] + 2 * lam * dtd)],
                "condition": [float(np.linalg.cond(a)) if p else 0.0],
                "fold_metric": [scores.ravel()],
            }
        )

    schema = (
        "session_id bigint, model_id string, n_rows bigint, sum_y double, best_lambda double, w array<double>,"
        " mean array<double>, std array<double>, nll double, gradient array<double>,"
        " hessian array<double>, condition double, fold_metric array<double>"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return together([fit(mine) for mine in models_of(pdf).values()], [c.split()[0] for c in schema.split(",")])

    dealt = spread(moments.withColumn("bucket", bucket_of(moments.sparkSession, moments.count())), "bucket")
    fits = dealt.groupBy("bucket").applyInPandas(run, schema)
    return fits, cv_rows(fits, lambdas)


def cv_rows(fits: DataFrame, lambdas: list[float]) -> DataFrame:
    """(session, model, lambda_idx, lambda, fold, metric) from packed scores."""
    m = len(lambdas)
    lams = F.array(*[F.lit(float(x)) for x in lambdas])
    k = F.size("fold_metric") / F.lit(m)
    return fits.select(*MODEL, k.cast("int").alias("_k"), F.posexplode("fold_metric").alias("_p", "metric")).select(
        *MODEL,
        F.floor(F.col("_p") / F.col("_k")).cast("int").alias("lambda_idx"),
        F.element_at(lams, F.floor(F.col("_p") / F.col("_k")).cast("int") + 1).alias("lambda"),
        (F.col("_p") % F.col("_k")).alias("fold"),
        "metric",
    )


def choose_lambda(cv: DataFrame, keys: list[str]) -> DataFrame:
    """First lambda (in list order) with the least unweighted mean metric."""
    mean = cv.groupBy(*keys, "lambda_idx", "lambda").agg(F.avg("metric").alias("mean_metric"))
    best = F.min(F.struct("mean_metric", "lambda_idx", "lambda")).alias("_b")
    return mean.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.lambda").alias("best_lambda"), F.col("_b.mean_metric").alias("mean_metric")
    )


# ---- Newton fits -------------------------------------------------------------


def fold_linear_terms(moments: DataFrame, p: int, lambdas: list[float]) -> DataFrame:
    """Jobs of the lambda x fold grid: b over training rows, plus held-out b.

    Array arithmetic per (model, fold); cfg = lambda index * folds + fold.
    """
    per = moments.select(*MODEL, "fold", F.col("vec")[0].alias("n"), F.slice("vec", 4 + p, p).alias("b"))
    total = sum_vectors(per.select(*MODEL, F.col("b").alias("vec")), MODEL).withColumnRenamed("vec", "b_all")
    lam = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(lambdas)]))
    folds = moments.groupBy(*MODEL).agg(F.count(F.lit(1)).alias("k"))
    return (
        per.join(total, MODEL)
        .join(folds, MODEL)
        .withColumn("l", lam)
        .select(
            *MODEL,
            (F.col("l.i") * F.col("k") + F.col("fold")).cast("int").alias("cfg"),
            F.col("l.i").alias("lambda_idx"),
            F.col("l.x").alias("lam"),
            F.col("fold").alias("holdout"),
            F.zip_with("b_all", "b", lambda a, c: a - c).alias("b"),
            F.col("b").alias("b_hold"),
            "n",
        )
    )


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def poisson_cv_fit(
    blocks: DataFrame,
    moments: DataFrame,
    colmap: ColumnMap,
    d: np.ndarray,
    lambdas: list[float],
    optimizer: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validated Poisson fits of all models: (final jobs, cv rows)."""
    p = colmap.p
    terms = materialize(fold_linear_terms(moments, p, lambdas))
    cvfit = newton_fit(blocks, new_jobs(terms, p), colmap, d, optimizer, brief=True)
    scored = cvfit.select(*MODEL, "cfg", "w_best", "hold_sum", "converged").join(terms, [*MODEL, "cfg"])
    cv = materialize(
        scored.select(
            *MODEL, "lambda_idx", F.col("lam").alias("lambda"), F.col("holdout").alias("fold"),
            ((F.col("hold_sum") - dot("w_best", "b_hold")) / F.col("n")).alias("metric"), "converged",
        )
    )
    best = choose_lambda(cv, MODEL)
    total = sum_vectors(moments.select(*MODEL, F.slice("vec", 4 + p, p).alias("vec")), MODEL)
    final = total.join(best, MODEL).select(
        *MODEL, F.lit(0).alias("cfg"), F.col("best_lambda").alias("lam"), F.lit(-1).alias("holdout"), F.col("vec").alias("b")
    )
    return newton_fit(blocks, new_jobs(final, p), colmap, d, optimizer), cv


def log_link_fit(
    blocks: DataFrame, moments: DataFrame, colmap: ColumnMap, d: np.ndarray, lam: float, optimizer: dict | None = None
) -> DataFrame:
    """Gaussian response with a log link at one lambda."""
    zero = F.array_repeat(F.lit(0.0), colmap.p)
    models = moments.select(*MODEL).distinct().select(
        *MODEL, F.lit(0).alias("cfg"), F.lit(float(lam)).alias("lam"), F.lit(-1).alias("holdout"), zero.alias("b")
    )
    return newton_fit(blocks, new_jobs(models, colmap.p), colmap, d, optimizer, family="gauss_log")


def log_link_cv_fit(
    blocks: DataFrame,
    moments: DataFrame,
    colmap: ColumnMap,
    d: np.ndarray,
    lambdas: list[float],
    optimizer: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validated Gaussian fits with a log link: (final jobs, cv rows).

    The score of a fold is the mean squared error of its rows through the link.
    """
    p = colmap.p
    terms = materialize(fold_linear_terms(moments, p, lambdas))
    tried = newton_fit(blocks, new_jobs(terms, p), colmap, d, optimizer, "gauss_log", brief=True)
    scored = tried.select(*MODEL, "cfg", "hold_sum", "converged").join(terms, [*MODEL, "cfg"])
    cv = materialize(
        scored.select(
            *MODEL, "lambda_idx", F.col("lam").alias("lambda"), F.col("holdout").alias("fold"),
            (2 * F.col("hold_sum") / F.col("n")).alias("metric"), "converged",
        )
    )
    final = choose_lambda(cv, MODEL).select(
        *MODEL, F.lit(0).alias("cfg"), F.col("best_lambda").alias("lam"), F.lit(-1).alias("holdout"),
        F.array_repeat(F.lit(0.0), p).alias("b"),
    )
    return newton_fit(blocks, new_jobs(final, p), colmap, d, optimizer, "gauss_log"), cv


# ---- using a fit -------------------------------------------------------------


def predict(blocks: DataFrame, weights: DataFrame, colmap: ColumnMap, link: str = "log") -> DataFrame:
    """(session, model, row_idx, bin, fold, y, mu) from weights (session, model, w[, mean, std]).

    Weights ride along once per block, not once per row.
    """
    scaled = "mean" in weights.columns
    cols = [*MODEL, "w"] + (["mean", "std"] if scaled else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y, rows = block_matrix(row, colmap)
                if scaled:
                    x = (x - np.asarray(row.mean, float)) / np.asarray(row.std, float)
                eta = x @ np.asarray(row.w, float)
                length = int(row.last_bin) - int(row.first_bin) + 1
                bins = int(row.first_bin) + np.arange(length)
                if row.bad is not None and len(row.bad):
                    bins = np.setdiff1d(bins, np.asarray(row.bad, dtype=np.int64))
                yield pd.DataFrame(
                    {
                        "session_id": row.session_id,
                        "model_id": row.model_id,
                        "row_idx": rows,
                        "bin": bins,
                        "fold": fold_of(rows, row.n_rows, row.k).astype("int32"),
                        "y": y,
                        "mu": rate(eta) if link == "log" else eta,
                    }
                )

    schema = "session_id bigint, model_id string, row_idx bigint, bin bigint, fold int, y double, mu double"
    return by_lane(blocks, weights.select(*cols)).mapInPandas(run, schema)


def unpack_kernels(weights: DataFrame, colmap: ColumnMap, extra: list[str] | None = None) -> DataFrame:
    """(session, model[, extra], block, pos, lag_bin, lag_s, weight) of every block.

    Basis blocks are expanded back to lags. The signal's own history is left
    out, as in the block list it is not a kernel.
    """
    keep = [*MODEL, *(extra or [])]
    blocks = [b for b in colmap.blocks if b.name != "lfp_history"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = np.vstack([np.asarray(v, float) for v in pdf.w])
            for b in blocks:
                coeffs = w[:, b.first : b.first + b.n]
                k = coeffs if b.taps is None else coeffs @ b.taps.T
                m = k.shape[1]
                timed = b.kind in ("lagged", "history")
                out = {c: np.repeat(pdf[c].to_numpy(), m) for c in keep}
                out["block"] = b.name
                out["pos"] = np.tile(np.arange(m, dtype="int32"), len(pdf))
                lags = pd.array(b.lags if timed else [None] * m, dtype="Int32")
                secs = b.lags * colmap.dt if timed else np.full(m, np.nan)
                out["lag_bin"] = pd.array(np.tile(lags, len(pdf)), dtype="Int32")
                out["lag_s"] = pd.array(np.tile(secs, len(pdf)), dtype="Float64") if timed else pd.array([None] * (m * len(pdf)), dtype="Float64")
                out["weight"] = k.ravel()
                yield pd.DataFrame(out)

    types = {"session_id": "bigint", "model_id": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'int')}" for c in keep)
    schema += ", block string, pos int, lag_bin int, lag_s double, weight double"
    return weights.select(*keep, "w").mapInPandas(run, schema)


def kernel_peaks(weights: DataFrame, colmap: ColumnMap, extra: list[str] | None = None) -> DataFrame:
    """(session, model[, extra], block, peak): largest absolute kernel weight, row by row."""
    keep = [*MODEL, *(extra or [])]
    blocks = [b for b in colmap.blocks if b.name != "lfp_history"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = np.vstack([np.asarray(v, float) for v in pdf.w])
            for b in blocks:
                coeffs = w[:, b.first : b.first + b.n]
                k = coeffs if b.taps is None else coeffs @ b.taps.T
                yield pdf[keep].assign(block=b.name, peak=np.abs(k).max(axis=1))

    types = {"session_id": "bigint", "model_id": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'int')}" for c in keep) + ", block string, peak double"
    return weights.select(*keep, "w").mapInPandas(run, schema)
