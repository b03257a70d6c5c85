"""Lagged features: long (COO) form in SQL, and compact design blocks for fitting.

The long form has one row per non-zero cell and is what the relational queries
read. Fitting reads design blocks instead: one row per (session, model, block
of bins) that carries only the impulses, responses and spans which reach the
block. The lagged columns are formed inside the task that uses them, so the
shuffle moves impulses, not lags x impulses.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.operators import grid as G
from echogrid.operators.basis import Block, ColumnMap
from echogrid.runtime import spread


# ---- long form ---------------------------------------------------------------


def lag_block(series: DataFrame, lag_lo: int, lag_hi: int, keys: list[str]) -> DataFrame:
    """(keys, bin, lag, val): cell (bin, lag) holds the series at bin - lag.

    ``series`` lists non-zero (keys, bin, val); cells before the first grid bin
    are dropped and everything absent is zero.
    """
    return (
        series.select(*keys, "bin", "val", F.explode(F.sequence(F.lit(lag_lo), F.lit(lag_hi))).alias("lag"))
        .withColumn("bin", F.col("bin") + F.col("lag"))
        .filter(F.col("bin") >= 0)
        .select(*keys, "bin", "lag", "val")
    )


def taps_frame(spark, blocks: list[Block]) -> DataFrame:
    """(stream, lag, col, phi): non-zero taps; its size is fixed by the config."""
    rows = [
        (b.name, int(lag), b.first + k, float(b.taps[i, k]))
        for b in blocks
        for i, lag in enumerate(b.lags)
        for k in range(b.n)
        if b.taps[i, k] != 0.0
    ]
    return spark.createDataFrame(rows, "stream string, lag int, col int, phi double")


def project_basis(
    series: DataFrame, taps: DataFrame, keys: list[str], parts: int | None = None, block_bins: int = G.BLOCK_BINS
) -> DataFrame:
    """(keys, bin, col, val): lagged series (keys, stream, bin, val) on a basis.

    The series is hashed by (keys, block of bins), with copies for the blocks
    its lags reach, and expanded there: cells are added up where they arise.
    ``parts`` tasks share them.
    """
    span = taps.groupBy("stream").agg(F.min("lag").alias("_lo"), F.max("lag").alias("_hi"))
    near = series.select(*keys, "stream", "bin", "val").join(F.broadcast(span), "stream")
    near = _reach(near, F.col("bin") + F.col("_lo"), F.col("bin") + F.col("_hi"), block_bins).drop("_lo", "_hi")
    hit = (
        spread(near, *keys, "blk", parts=parts)
        .join(F.broadcast(taps), "stream")
        .select(*keys, "blk", (F.col("bin") + F.col("lag")).alias("bin"), "col", (F.col("val") * F.col("phi")).alias("val"))
        .filter((F.col("bin") >= 0) & (F.floor(F.col("bin") / F.lit(block_bins)) == F.col("blk")))
    )
    return hit.groupBy(*keys, "blk", "bin", "col").agg(F.sum("val").alias("val")).drop("blk")


def design_coo(
    impulses: DataFrame,
    response: DataFrame,
    sizes: DataFrame,
    colmap: ColumnMap,
    convo_spans: DataFrame | None = None,
    bad: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Non-zero design cells (session_id, model_id, bin, col, val), bad bins dropped.

    ``response`` lists non-zero (session_id, model_id, bin, y). Lags are taken
    on the full grid; masked bins are removed afterwards. Models and sizes meet
    the impulses, not the cells, and cells are hashed by (session, model, bin)
    into ``parts`` partitions, which sums over a design row find in place.
    """
    spark = impulses.sparkSession
    models = response.select("session_id", "model_id").distinct()
    on_grid, inside = ["session_id", "model_id", "n_bins"], F.col("bin") < F.col("n_bins")
    shared = []
    lagged = colmap.lagged
    if lagged:
        series = impulses.select("session_id", "stream", "bin", F.lit(1.0).alias("val")).join(models, "session_id")
        cells = project_basis(series.join(sizes, "session_id"), taps_frame(spark, lagged), on_grid, parts)
        shared.append(cells.filter(inside))
    icept = colmap.get("intercept")
    if icept is not None:
        shared.append(
            G.grid(sizes, colmap.dt, per=models).select(
                "session_id", "model_id", "bin", F.lit(icept.first).alias("col"), F.lit(1.0).alias("val")
            )
        )
    states = colmap.get("states")
    if states is not None:
        from echogrid.operators.states import compute_states

        cells = compute_states(convo_spans, sizes, colmap.dt, bad)
        shared.append(
            cells.select(
                "session_id",
                "bin",
                F.when(F.col("convo"), states.first).when(F.col("spon"), states.first + 1).alias("col"),
                F.lit(1.0).alias("val"),
            ).filter(F.col("col").isNotNull()).join(models, "session_id")
        )
    out = None
    for part in shared:
        part = part.select("session_id", "model_id", "bin", F.col("col").cast("int").alias("col"), "val")
        out = part if out is None else out.unionByName(part)
    hist = colmap.history
    if hist is not None:
        series = response.filter("y <> 0").select("session_id", "model_id", "bin", F.col("y").cast("double").alias("val"))
        series = series.join(sizes, "session_id")
        if hist.taps is None:
            part = lag_block(series, hist.lag_lo, hist.lag_hi, on_grid).withColumn(
                "col", (F.col("lag") - hist.lag_lo + hist.first).cast("int")
            )
        else:
            part = project_basis(
                series.withColumn("stream", F.lit(hist.name)), taps_frame(spark, [hist]), on_grid, parts
            )
        part = part.filter(inside).select("session_id", "model_id", "bin", "col", "val")
        out = part if out is None else out.unionByName(part)
    if bad is not None:
        out = out.join(bad.select("session_id", "bin"), ["session_id", "bin"], "left_anti")
    return spread(out.select("session_id", "model_id", "bin", "col", "val"), "session_id", "model_id", "bin", parts=parts)


def column_stats(coo: DataFrame, n_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, mean, std) over all rows, implicit zeros included.

    A spread below 1e-10 is replaced by 1, so such a column is only centred.
    """
    sums = coo.groupBy(*keys, "col").agg(
        F.sum("val").alias("_s"), F.sum(F.col("val") * F.col("val")).alias("_q")
    )
    n = F.col("n_rows").cast("double")
    mean = F.col("_s") / n
    var = F.greatest((F.col("_q") - n * mean * mean) / (n - 1), F.lit(0.0))
    return sums.join(n_rows, [k for k in keys if k in n_rows.columns]).select(
        *keys, "col", mean.alias("mean"), F.when(F.sqrt(var) < 1e-10, 1.0).otherwise(F.sqrt(var)).alias("std")
    )


# ---- block form --------------------------------------------------------------


def _reach(df: DataFrame, lo: Column, hi: Column, b: int) -> DataFrame:
    first = F.greatest(F.floor(lo / F.lit(b)), F.lit(0))
    return df.withColumn("blk", F.explode(F.sequence(first, F.greatest(F.floor(hi / F.lit(b)), first))))


def design_blocks(
    impulses: DataFrame,
    response: DataFrame,
    sizes: DataFrame,
    colmap: ColumnMap,
    k_folds: int = 5,
    convo_spans: DataFrame | None = None,
    bad: DataFrame | None = None,
    models: DataFrame | None = None,
    block_bins: int = G.BLOCK_BINS,
) -> DataFrame:
    """One row per (session, model, block of bins) with what its rows need.

    Every array is bounded by the block length plus the lag reach.
    """
    b = block_bins
    if models is None:
        models = response.select("session_id", "model_id").distinct()
    blocks = G.grid_blocks(sizes, b).join(sizes.withColumnRenamed("n_bins", "n_rows"), "session_id")
    blocks = blocks.withColumn("row0", F.col("first_bin")).withColumn("bad", F.array().cast("array<bigint>"))
    if bad is not None:
        from pyspark.sql import Window

        per = (
            bad.join(sizes, "session_id")
            .filter((F.col("bin") >= 0) & (F.col("bin") < F.col("n_bins")))
            .groupBy("session_id", F.floor(F.col("bin") / b).alias("blk"))
            .agg(F.collect_set("bin").alias("_bad"))
        )
        w = Window.partitionBy("session_id").orderBy("blk")
        gone = F.coalesce(F.size("_bad"), F.lit(0))
        blocks = (
            blocks.drop("bad")
            .join(per, ["session_id", "blk"], "left")
            .withColumn("_n", F.when(F.col("_bad").isNull(), 0).otherwise(gone))
            .withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_all", F.sum("_n").over(Window.partitionBy("session_id")))
            .withColumn("row0", F.col("first_bin") - F.col("_before"))
            .withColumn("n_rows", F.col("n_rows") - F.col("_all"))
            .withColumn("bad", F.coalesce("_bad", F.array().cast("array<bigint>")))
            .drop("_bad", "_n", "_before", "_all")
        )
    lagged = colmap.lagged
    imp = None
    if lagged:
        order = F.create_map(*[x for i, blk in enumerate(lagged) for x in (F.lit(blk.name), F.lit(i))])
        lo = min(blk.lag_lo for blk in lagged)
        hi = max(blk.lag_hi for blk in lagged)
        hit = impulses.filter(F.col("stream").isin([blk.name for blk in lagged])).withColumn(
            "s", F.element_at(order, F.col("stream"))
        )
        imp = (
            _reach(hit, F.col("bin") + lo, F.col("bin") + hi, b)
            .groupBy("session_id", "blk")
            .agg(F.collect_list(F.struct("s", "bin")).alias("_i"))
            .select("session_id", "blk", F.col("_i.s").alias("imp_s"), F.col("_i.bin").alias("imp_b"))
        )
    out = blocks
    if imp is not None:
        out = out.join(imp, ["session_id", "blk"], "left")
    else:
        out = out.withColumn("imp_s", F.lit(None).cast("array<int>")).withColumn("imp_b", F.lit(None).cast("array<bigint>"))
    if colmap.get("states") is not None:
        spans = (
            _reach(convo_spans, F.col("first_bin"), F.col("last_bin"), b)
            .groupBy("session_id", "blk")
            .agg(F.collect_list(F.struct("first_bin", "last_bin")).alias("_c"))
            .select("session_id", "blk", F.col("_c.first_bin").alias("cv_lo"), F.col("_c.last_bin").alias("cv_hi"))
        )
        out = out.join(spans, ["session_id", "blk"], "left")
    else:
        out = out.withColumn("cv_lo", F.lit(None).cast("array<bigint>")).withColumn("cv_hi", F.lit(None).cast("array<bigint>"))
    halo = colmap.history.lag_hi if colmap.history is not None else 0
    ys = (
        _reach(response.filter("y <> 0"), F.col("bin"), F.col("bin") + halo, b)
        .groupBy("session_id", "model_id", "blk")
        .agg(F.collect_list(F.struct("bin", F.col("y").cast("double").alias("y"))).alias("_y"))
        .select("session_id", "model_id", "blk", F.col("_y.bin").alias("y_b"), F.col("_y.y").alias("y_v"))
    )
    full = (
        out.join(models, "session_id")
        .join(ys, ["session_id", "model_id", "blk"], "left")
        .withColumn("k", F.lit(k_folds))
        .select(
            "session_id", "model_id", "blk", "first_bin", "last_bin", "row0", "n_rows", "k",
            "bad", "imp_s", "imp_b", "cv_lo", "cv_hi", "y_b", "y_v",
        )
    )
    # Sorted by model inside each task, so a task sums a model in one go.
    return spread(full, "session_id", "model_id", "blk").sortWithinPartitions("session_id", "model_id", "blk")


def fold_of(rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """Fold of each retained row: contiguous, the first n mod k folds one longer."""
    base, rem = divmod(int(n), int(k))
    cut = rem * (base + 1)
    late = rem + (rows - cut) // max(base, 1)
    return np.where(rows < cut, rows // (base + 1), late)


def fold_expr(row: Column, n: Column, k: int) -> Column:
    base = F.floor(n / F.lit(k))
    rem = n % F.lit(k)
    cut = rem * (base + 1)
    late = rem + F.floor((row - cut) / F.greatest(base, F.lit(1)))
    return F.when(row < cut, F.floor(row / (base + 1))).otherwise(late).cast("int")


def _lag_view(values: np.ndarray, n_lags: int) -> np.ndarray:
    """Row i, column j: the series j lags back, newest lag first."""
    return np.lib.stride_tricks.sliding_window_view(values, n_lags)[:, ::-1]


def _dense(bins, vals, start: int, length: int) -> np.ndarray:
    out = np.zeros(length)
    if bins is not None and len(bins):
        at = np.asarray(bins, dtype=np.int64) - start
        ok = (at >= 0) & (at < length)
        out[at[ok]] = 1.0 if vals is None else np.asarray(vals, dtype=float)[ok]
    return out


def block_matrix(row, colmap: ColumnMap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X, y, retained row numbers) of one design block."""
    first, last = int(row.first_bin), int(row.last_bin)
    length = last - first + 1
    x = np.zeros((length, colmap.p))
    imp_s = None if row.imp_s is None else np.asarray(row.imp_s)
    imp_b = None if row.imp_b is None else np.asarray(row.imp_b, dtype=np.int64)
    lagged = colmap.lagged
    for blk in colmap.blocks:
        cols = slice(blk.first, blk.first + blk.n)
        if blk.kind == "intercept":
            x[:, cols] = 1.0
        elif blk.kind == "lagged" and imp_s is not None:
            bins = imp_b[imp_s == lagged.index(blk)]
            if bins.size:
                z = _dense(bins, None, first - blk.lag_hi, length + blk.lag_hi - blk.lag_lo)
                # Only impulses before bin 0 are absent; the grid starts there.
                x[:, cols] = _lag_view(z, blk.lag_hi - blk.lag_lo + 1) @ blk.taps
        elif blk.kind == "states":
            convo = np.zeros(length, dtype=bool)
            if row.cv_lo is not None:
                for a, z_ in zip(row.cv_lo, row.cv_hi):
                    convo[max(int(a) - first, 0) : max(int(z_) - first + 1, 0)] = True
            x[:, blk.first] = convo
            x[:, blk.first + 1] = ~convo
        elif blk.kind == "history" and row.y_b is not None:
            z = _dense(row.y_b, row.y_v, first - blk.lag_hi, length + blk.lag_hi - blk.lag_lo)
            view = _lag_view(z, blk.lag_hi - blk.lag_lo + 1)
            x[:, cols] = view if blk.taps is None else view @ blk.taps
    y = _dense(row.y_b, row.y_v, first, length)
    keep = np.ones(length, dtype=bool)
    if row.bad is not None and len(row.bad):
        keep[np.asarray(row.bad, dtype=np.int64) - first] = False
    rows = int(row.row0) + np.arange(int(keep.sum()))
    return x[keep], y[keep], rows
