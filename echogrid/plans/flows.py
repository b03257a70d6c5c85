"""End-to-end flows: spike models, signal models and state label export."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid import config as C
from echogrid.operators import basis as B
from echogrid.operators import dsp as D
from echogrid.operators import evaluate as EV
from echogrid.operators import events as E
from echogrid.operators import features as X
from echogrid.operators import fit as FT
from echogrid.operators import grid as G
from echogrid.operators import infer as I
from echogrid.operators import moments as M
from echogrid.operators import states as ST
from echogrid.operators import streams as S
from echogrid.operators import validate as V
from echogrid.operators.scan import DEFAULT_CHUNK_S
from echogrid.plans import sinks
from echogrid.runtime import materialize

MODEL = FT.MODEL


@dataclass
class FitResult:
    """DataFrames of a run, all keyed by session and model (neuron or channel)."""

    cfg: dict
    colmap: B.ColumnMap
    penalty: np.ndarray
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def write(self, path: str) -> None:
        """All frames as Parquet datasets, by session; plus the column dimension."""
        spark = next(iter(self.frames.values())).sparkSession
        cols = spark.createDataFrame(
            [(r["block"], r["col"], r["pos"], r["lag_s"], r["kind"]) for r in self.colmap.records()],
            "block string, col int, pos int, lag_s double, kind string",
        )
        sinks.write_fit({**self.frames, "colmap": cols}, path, "session_id")


def collapsed(events: DataFrame, cfg: dict, chunk_s: float) -> DataFrame:
    return materialize(E.collapse_bouts(events, C.bout_window(cfg), chunk_s))


def shared_inputs(events: DataFrame, sizes: DataFrame, cfg: dict, chunk_s: float):
    """Impulses, conversation spans (only when states are modelled) and layout."""
    resp_s, gap_s = C.state_windows(cfg)
    impulses = materialize(S.build_streams(events, cfg["dt"], cfg, sizes, chunk_s))
    spans = ST.conversation_bins(events, sizes, cfg["dt"], resp_s, gap_s, chunk_s)
    return impulses, spans


def fit_spikes(
    spikes: DataFrame,
    events: DataFrame,
    cfg: dict | None = None,
    bad: DataFrame | None = None,
    n_perms: int | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> FitResult:
    """Poisson encoding models of every neuron of every session."""
    cfg = C.merge(C.load(cfg), {"response_type": "spikes"})
    dt, k, lambdas = cfg["dt"], cfg["cv"]["k"], list(cfg["cv"]["lambdas"])
    n_perms = C.N_PERMUTATIONS if n_perms is None else n_perms
    events = collapsed(events, cfg, chunk_s)
    sizes = materialize(G.grid_sizes(G.session_extent(events, spikes), dt))
    counts = materialize(
        G.spike_counts(spikes, sizes, dt).select(
            "session_id", F.col("neuron_id").alias("model_id"), "bin", F.col("n").cast("double").alias("y")
        )
    )
    # A neuron without a spike on the grid is a model too: its response is one explicit zero.
    named = spikes.select("session_id", F.col("neuron_id").alias("model_id")).distinct()
    silent = named.join(counts, MODEL, "left_anti").join(sizes.select("session_id"), "session_id", "left_semi")
    counts = counts.unionByName(silent.select(*MODEL, F.lit(0).cast("bigint").alias("bin"), F.lit(0.0).alias("y")))
    impulses, spans = shared_inputs(events, sizes, cfg, chunk_s)
    colmap = B.column_map(cfg, S.produced_names(events, cfg))
    d, _ = B.smoothness_penalty(colmap, cfg)
    blocks = materialize(X.design_blocks(impulses, counts, sizes, colmap, k, spans, bad))
    mom = materialize(M.fold_moments(blocks, colmap))
    fits, cv = FT.poisson_cv_fit(blocks, mom, colmap, d, lambdas, cfg["optimizer"])
    fits = materialize(fits.withColumn("w", F.col("w_best")).withColumn("nll", F.col("f_best")))
    out = FitResult(cfg, colmap, d)
    weights = fits.select(*MODEL, "lam", "w")
    rates = FT.predict(blocks, weights, colmap, "log")
    counts_by = S.event_counts(impulses)
    out.frames = {
        "events": events, "grid": sizes, "counts": counts, "impulses": impulses, "states": spans, "cv": cv,
        "fits": fits.select(*MODEL, "lam", "w", "hessian", "gradient", "nll", "iters", "converged"),
        "rates": rates, "kernels": FT.unpack_kernels(weights, colmap),
        "metrics": EV.poisson_metrics(rates, MODEL), "event_counts": counts_by,
    }
    if n_perms > 0:
        cross = I.all_shifted_cross(blocks, colmap, n_perms, I.seeded(cfg["seed"]))
        nulls = materialize(I.poisson_nulls(blocks, cross, weights.select(*MODEL, "lam"), colmap, d, cfg["optimizer"]))
        out.frames["ptest"], out.frames["ptest_ci"] = I.permutation_test(weights, nulls, colmap)
        out.frames["null_status"] = I.unsettled(nulls)
    return out


def fit_signal(
    signal: DataFrame,
    meta: DataFrame,
    events: DataFrame,
    fs: float,
    cfg: dict | None = None,
    n_perms: int | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> FitResult:
    """Gaussian encoding models of every channel of every session."""
    cfg = C.merge(C.load(cfg), {"response_type": "lfp"})
    dt, k, lambdas = cfg["dt"], cfg["cv"]["k"], list(cfg["cv"]["lambdas"])
    link = str(cfg["lfp"].get("link") or "identity").lower()
    n_perms = cfg.get("n_perms", C.N_PERMUTATIONS) if n_perms is None else n_perms
    ends = meta.select("session_id", (F.col("t0") + F.col("duration")).alias("_end"))
    events = E.within_recording(events.join(ends, "session_id"), F.col("_end")).drop("_end")
    events = collapsed(events, cfg, chunk_s)
    # The grid follows the events alone; samples beyond it are not modelled.
    sizes = materialize(G.grid_sizes(G.session_extent(events), dt))
    raw = materialize(D.bin_signal(signal, meta, sizes, dt, fs, cfg))
    V.require_live_signal(raw, C.DEAD_SIGNAL_STD)
    flat = materialize(D.remove_drift(raw, sizes, dt, C.DRIFT_HIGHPASS_HZ, C.DRIFT_HIGHPASS_ORDER))
    resp = flat.select("session_id", F.col("channel_id").alias("model_id"), "bin", F.col("v").alias("y"))
    impulses, spans = shared_inputs(events, sizes, cfg, chunk_s)
    colmap = B.column_map(cfg, S.produced_names(events, cfg))
    d, _ = B.smoothness_penalty(colmap, cfg)
    blocks = materialize(X.design_blocks(impulses, resp, sizes, colmap, k, spans))
    mom = materialize(M.fold_moments(blocks, colmap))
    if link == "log":
        fits, cv = FT.log_link_cv_fit(blocks, mom, colmap, d, lambdas, cfg["optimizer"])
        fits = fits.select(
            *MODEL, F.col("lam").alias("best_lambda"), F.col("w_best").alias("w"), F.col("f_best").alias("nll"),
            "gradient", F.col("report").alias("hessian"), "iters", "converged",
        )
    else:
        fits, cv = FT.gauss_cv_fit(mom, colmap, d, lambdas)
    fits = materialize(fits)
    pred = FT.predict(blocks, fits, colmap, link)
    out = FitResult(cfg, colmap, d)
    metrics = EV.signal_metrics(pred, MODEL)
    out.frames = {
        "events": events, "grid": sizes, "binned": raw, "impulses": impulses, "states": spans, "cv": cv,
        "fits": fits, "predictions": pred, "kernels": FT.unpack_kernels(fits, colmap),
        "metrics": metrics.withColumn("grade", EV.grade(F.col("r2"))), "event_counts": S.event_counts(impulses),
    }
    if n_perms > 0:
        if link == "log":
            lam = fits.select(*MODEL, F.col("best_lambda").alias("lam"))
            nulls = materialize(I.log_link_nulls(blocks, lam, colmap, d, n_perms, cfg["seed"], cfg["optimizer"]))
            out.frames["null_status"] = I.unsettled(nulls)
        else:
            nulls = materialize(I.gauss_nulls(fits, I.all_shifted_cross(blocks, colmap, n_perms, I.seeded(cfg["seed"])), colmap, d))
        p, ci = I.permutation_test(fits, nulls, colmap)
        out.frames["ptest"], out.frames["ptest_ci"] = p, ci
        out.frames["significance"] = EV.significance_rollup(p, MODEL)
    return out


def export_states(
    events: DataFrame,
    path: str | None = None,
    cfg: dict | None = None,
    durations: DataFrame | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """State segments of every session; written as label tracks when a path is given.

    ``durations`` (session_id, duration) stretches the grid to the audio length.
    """
    cfg = C.load(cfg)
    resp_s, gap_s = C.state_windows(cfg)
    sizes = G.grid_sizes(G.session_extent(events, None, durations), cfg["dt"])
    spans = ST.conversation_bins(events, sizes, cfg["dt"], resp_s, gap_s, chunk_s)
    segments = ST.state_segments(spans, sizes, cfg["dt"])
    if path:
        sinks.write_label_track(segments, path, partition_by="session_id")
    return segments


def export_bouts(events: DataFrame, path: str | None = None, cfg: dict | None = None, chunk_s: float = DEFAULT_CHUNK_S) -> DataFrame:
    """Bout starts of every session as a label track."""
    track = sinks.bout_track(E.collapse_bouts(events, C.bout_window(C.load(cfg)), chunk_s))
    if path:
        sinks.write_label_track(track, path, "label", "session_id")
    return track


def qc_summary(result: FitResult) -> DataFrame:
    """One row per model: size, weight norm, chosen lambda, event counts, state contrast, permutation verdicts."""
    lam = "lam" if "lam" in result.fits.columns else "best_lambda"
    base = result.fits.select(*MODEL, F.col(lam).alias("best_lambda"), F.size("w").alias("n_params"), "w", "hessian")
    score = FT.choose_lambda(result.cv, MODEL).select(*MODEL, F.col("mean_metric").alias("best_lambda_mean_metric"))
    counts = result.event_counts.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "n")))).alias("event_counts")
    )
    out = (
        base.join(EV.weight_norm(base.select(*MODEL, "w"), MODEL), MODEL)
        .join(score, MODEL)
        .join(result.grid.select("session_id", "n_bins"), "session_id")
        .join(counts, "session_id", "left")
    )
    states = result.colmap.get("states")
    if states is not None:
        out = out.join(EV.wald_contrast(base, MODEL, states.first, states.first + 1), MODEL, "left")
    if "ptest" in result.frames:
        out = out.join(EV.significance_rollup(result.ptest, MODEL), MODEL, "left")
    return out.drop("w", "hessian")
