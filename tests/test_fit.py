import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echogrid import config as C
from echogrid.operators import basis as B
from echogrid.operators import features as X
from echogrid.operators import fit as FT
from echogrid.operators import infer as I
from echogrid.operators import moments as M
from echogrid.operators import newton as NT
from echogrid.runtime import materialize


def test_design_layout():
    cfg = {"dt": 0.1, "heard_window_s": [0, 0.2], "produced_window_s": [-0.1, 0.1], "history_window_s": [0.1, 0.3],
           "heard_basis": {"n_basis": 3}, "produced_basis": {"n_basis": 3}}
    names = ["produced_spontaneous", "produced_after_heard", "produced_after_produced"]
    cm = B.column_map(cfg, names)
    assert cm.p == 21
    assert [(b.name, b.first, b.n) for b in cm.blocks][0] == ("intercept", 0, 1)
    assert cm.get("states").first == 16 and cm.get("spike_history").first == 18
    assert B.column_map({**cfg, "exclude_predictors": ["states", " Spike_History "]}, names).p == 16
    assert B.column_map({**cfg, "exclude_predictors": "heard_any"}, names).p == 15
    with pytest.raises(C.ConfigError):
        B.column_map({**cfg, "history_window_s": [0, 0.1]}, names)


def penalty_map():
    names = ["heard_addressed", "heard_overheard", "produced_a", "produced_b", "produced_c", "spike_history"]
    blocks = [B.Block("intercept", "intercept", 0, 1)]
    blocks += [B.Block(n, "lagged", 1 + 4 * i, 4) for i, n in enumerate(names)]
    blocks += [B.Block("states", "states", 25, 2)]
    return B.ColumnMap(blocks, 0.1, "spikes")


def test_penalty():
    cm = penalty_map()
    d, rows = B.smoothness_penalty(cm)
    assert d.shape == (12, 27)
    assert list(d[0, 1:5]) == [1, -2, 1, 0] and list(d[1, 1:5]) == [0, 1, -2, 1]
    assert B.smoothness_penalty(cm, {"spike_history": False})[0].shape == (10, 27)
    d, rows = B.smoothness_penalty(cm, {}, {"heard": 4, "produced": 9, "history": 0})
    assert d[0, 1] == 2 and d[4, 9] == 3 and rows["spike_history"]["rows"] == [] and d.shape == (10, 27)


def small_problem(spark, bad=None, k=4, excl=(), n=300, seed=0):
    rng = np.random.default_rng(seed)
    cfg = {"dt": 1.0, "heard_window_s": [0, 3], "produced_window_s": [-2, 2], "history_window_s": [1, 3],
           "heard_basis": {"n_basis": 3}, "produced_basis": {"n_basis": 3}, "exclude_predictors": list(excl)}
    cm = B.column_map(cfg, ["produced_any"], ["heard_any"])
    imp = [(1, s, int(b)) for s in ("heard_any", "produced_any") for b in rng.choice(n, 30, replace=False)]
    z = {s: np.zeros(n) for s in ("heard_any", "produced_any")}
    for _, s, b in imp:
        z[s][b] = 1
    y = rng.poisson(0.7, n).astype(float)
    spans = [(1, 20, 60), (1, 150, 190)]
    convo = np.zeros(n)
    for _, a, e in spans:
        convo[a : e + 1] = 1
    cols = []
    for blk in cm.blocks:
        if blk.kind == "intercept":
            cols.append(np.ones((n, 1)))
        elif blk.kind == "states":
            cols.append(np.column_stack([convo, 1 - convo]))
        else:
            src = y if blk.kind == "history" else z[blk.name]
            lag = np.zeros((n, len(blk.lags)))
            for j, L in enumerate(blk.lags):
                for i in range(n):
                    if 0 <= i - L < n:
                        lag[i, j] = src[i - L]
            cols.append(lag if blk.taps is None else lag @ blk.taps)
    xmat = np.hstack(cols)
    keep = np.ones(n, bool)
    if bad:
        keep[list(bad)] = False
    impulses = spark.createDataFrame(imp, "session_id bigint, stream string, bin bigint")
    resp = spark.createDataFrame([(1, "n0", i, float(v)) for i, v in enumerate(y) if v], "session_id bigint, model_id string, bin bigint, y double")
    sizes = spark.createDataFrame([(1, n)], "session_id bigint, n_bins bigint")
    cspan = spark.createDataFrame(spans, "session_id bigint, first_bin bigint, last_bin bigint")
    badf = spark.createDataFrame([(1, b) for b in bad], "session_id bigint, bin bigint") if bad else None
    blocks = materialize(X.design_blocks(impulses, resp, sizes, cm, k, cspan, badf, block_bins=32))
    coo = X.design_coo(impulses, resp, sizes, cm, cspan, badf)
    return cm, xmat[keep], y[keep], keep, blocks, coo


@pytest.mark.parametrize("bad", [None, [3, 4, 31, 32, 200]])
def test_blocks_and_coo_match_dense(spark, bad):
    cm, x, y, keep, blocks, coo = small_problem(spark, bad)
    got = np.zeros((len(keep), cm.p))
    for r in coo.collect():
        got[r["bin"], r["col"]] += r["val"]
    np.testing.assert_allclose(got[keep], x, atol=1e-12)
    mom = M.fold_moments(blocks, cm).collect()
    total = np.sum([r["vec"] for r in mom], axis=0)
    n, sy, yy, sx, xty, g = M.split_moments(total, cm.p)
    assert n == len(y)
    np.testing.assert_allclose(g, x.T @ x, atol=1e-9)
    np.testing.assert_allclose(xty, x.T @ y, atol=1e-9)
    folds = X.fold_of(np.arange(len(y)), len(y), 4)
    for r in mom:
        gf = M.split_moments(r["vec"], cm.p)[5]
        xf = x[folds == r["fold"]]
        np.testing.assert_allclose(gf, xf.T @ xf, atol=1e-9)


def test_fold_rule():
    sizes = np.bincount(X.fold_of(np.arange(103), 103, 4))
    assert list(sizes) == [26, 26, 26, 25]
    assert list(np.bincount(X.fold_of(np.arange(10), 10, 5))) == [2] * 5


def dense_poisson(x, y, d, lam):
    w = np.zeros(x.shape[1])
    for _ in range(100):
        mu = np.exp(x @ w)
        g = x.T @ (mu - y) + 2 * lam * d.T @ d @ w
        h = x.T @ (mu[:, None] * x) + 2 * lam * d.T @ d
        w = w - np.linalg.lstsq(h, g, rcond=1e-12)[0]
    return w


def test_poisson_fit(spark):
    cm, x, y, keep, blocks, coo = small_problem(spark, [3, 50], excl=["states"])
    d, _ = B.smoothness_penalty(cm)
    mom = materialize(M.fold_moments(blocks, cm))
    lambdas = [0.1, 1.0, 10.0]
    fit, cv = FT.poisson_cv_fit(blocks, mom, cm, d, lambdas, {"tol_grad": 1e-10})
    folds = X.fold_of(np.arange(len(y)), len(y), 4)
    want = np.zeros((3, 4))
    for i, lam in enumerate(lambdas):
        for f in range(4):
            w = dense_poisson(x[folds != f], y[folds != f], d, lam)
            e = x[folds == f] @ w
            want[i, f] = np.mean(np.exp(e) - y[folds == f] * e)
    got = np.zeros((3, 4))
    for r in cv.collect():
        got[r["lambda_idx"], r["fold"]] = r["metric"]
    np.testing.assert_allclose(got, want, atol=1e-7)
    row = fit.first()
    best = lambdas[int(np.argmin(want.mean(axis=1)))]
    assert row["lam"] == best and row["converged"]
    np.testing.assert_allclose(row["w_best"], dense_poisson(x, y, d, best), atol=1e-6)
    w = fit.select("session_id", "model_id", "w_best").withColumnRenamed("w_best", "w")
    pred = sorted((r["row_idx"], r["mu"], r["bin"]) for r in FT.predict(blocks, w, cm).collect())
    np.testing.assert_allclose([m for _, m, _ in pred], np.exp(x @ np.array(row["w_best"])), rtol=1e-6)
    assert [b for _, _, b in pred] == list(np.flatnonzero(keep))
    kern = FT.unpack_kernels(w, cm).filter("block = 'heard_any'").orderBy("pos").collect()
    blk = cm.get("heard_any")
    np.testing.assert_allclose([r["weight"] for r in kern], blk.taps @ np.array(row["w_best"])[blk.first : blk.first + blk.n], atol=1e-9)


def test_gauss_fit(spark):
    cm, x, y, keep, blocks, coo = small_problem(spark, [3, 50])
    d, _ = B.smoothness_penalty(cm)
    mom = materialize(M.fold_moments(blocks, cm))
    lambdas = [0.1, 1.0, 10.0]
    fits, cv = FT.gauss_cv_fit(mom, cm, d, lambdas)
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    std[std < 1e-10] = 1
    mean[0], std[0] = 0, 1
    xs = (x - mean) / std
    folds = X.fold_of(np.arange(len(y)), len(y), 4)
    want = np.zeros((3, 4))
    for i, lam in enumerate(lambdas):
        for f in range(4):
            a, b = xs[folds != f], y[folds != f]
            w = np.linalg.lstsq(a.T @ a + lam * d.T @ d, a.T @ b, rcond=1e-12)[0]
            want[i, f] = np.mean((y[folds == f] - xs[folds == f] @ w) ** 2)
    got = np.zeros((3, 4))
    for r in cv.collect():
        got[r["lambda_idx"], r["fold"]] = r["metric"]
    np.testing.assert_allclose(got, want, atol=1e-7)
    row = fits.first()
    np.testing.assert_allclose(row["mean"], mean, atol=1e-9)
    np.testing.assert_allclose(row["std"], std, atol=1e-9)
    pred = sorted((r["row_idx"], r["mu"]) for r in FT.predict(blocks, fits, cm, "identity").collect())
    np.testing.assert_allclose([m for _, m in pred], xs @ np.array(row["w"]), atol=1e-7)


def test_log_link(spark):
    cm, x, y, keep, blocks, coo = small_problem(spark, excl=["states", "spike_history"])
    d, _ = B.smoothness_penalty(cm)
    mom = M.fold_moments(blocks, cm)
    row = FT.log_link_fit(blocks, mom, cm, d, 0.5, {"tol_grad": 1e-9}).first()
    w = np.array(row["w_best"])
    mu = np.exp(x @ w)
    g = -x.T @ ((y - mu) * mu) + 2 * 0.5 * d.T @ d @ w
    assert np.max(np.abs(g)) < 1e-4


def dense_log_link(x, y, d, lam):
    """Damped Newton by bisection on the damping, in plain numpy."""
    value = lambda w: 0.5 * np.sum((y - np.exp(x @ w)) ** 2) + lam * np.sum((d @ w) ** 2)
    w, damp = np.zeros(x.shape[1]), 1.0
    for _ in range(3000):
        mu = np.exp(x @ w)
        g = -x.T @ ((y - mu) * mu) + 2 * lam * d.T @ d @ w
        if np.max(np.abs(g)) < 1e-9:
            break
        h = x.T @ ((mu**2 - (y - mu) * mu)[:, None] * x) + 2 * lam * d.T @ d
        values, q = np.linalg.eigh(h)
        step = -q @ ((q.T @ g) / np.maximum(np.abs(values) + damp, 1e-9)) * (1.0)
        if value(w + step) <= value(w):
            w, damp = w + step, damp / 3
        else:
            damp = max(3 * damp, 1e-8)
    return w


def log_slope(x, y, d, lam, w):
    mu = np.exp(x @ w)
    return np.max(np.abs(-x.T @ ((y - mu) * mu) + 2 * lam * d.T @ d @ w))


def test_shifted_log_link_refits(spark):
    cm, x, y, keep, blocks, coo = small_problem(spark, [3, 31, 32, 200], excl=["states", "spike_history"])
    d, _ = B.smoothness_penalty(cm)
    lam = spark.createDataFrame([(1, "n0", 2.0)], "session_id bigint, model_id string, lam double")
    nulls = I.log_link_nulls(blocks, lam, cm, d, 6, 42, {"tol_grad": 1e-9}).collect()
    n = F.lit(len(y)).cast("bigint")
    shift = {r["id"]: r["k"] for r in spark.range(6).select("id", I.shift_of(F.lit(1).cast("bigint"), F.lit("n0"), F.col("id").cast("int"), n, 42).alias("k")).collect()}
    assert sorted(r["perm"] for r in nulls) == list(range(6))
    for r in nulls:
        moved = np.roll(y, shift[r["perm"]])
        assert r["converged"] and log_slope(x, moved, d, 2.0, np.array(r["w"])) < 1e-5
        want = dense_log_link(x, moved, d, 2.0)
        value = lambda w: 0.5 * np.sum((moved - np.exp(x @ w)) ** 2) + 2.0 * np.sum((d @ w) ** 2)  # noqa: B023, E731
        assert value(np.array(r["w"])) <= value(want) + 1e-6


@pytest.mark.parametrize("family", ["poisson", "gauss_log"])
def test_passes_agree_with_solving_in_one_task(spark, monkeypatch, family):
    cm, x, y, keep, blocks, coo = small_problem(spark, [3, 31, 32, 200], excl=["states", "spike_history"])
    d, _ = B.smoothness_penalty(cm)
    jobs = [(1, "n0", c, lam, hold, (x.T @ y).tolist() if family == "poisson" else [0.0] * cm.p, shift)
            for c, (lam, hold, shift) in enumerate([(0.5, -1, 0), (0.5, 2, 0), (5.0, -1, 17), (5.0, -1, 290), (1.0, 0, len(y))])]
    linear = spark.createDataFrame(jobs, "session_id bigint, model_id string, cfg int, lam double, holdout int, b array<double>, shift bigint")
    short = {r["cfg"]: r for r in NT.newton_fit(blocks, NT.new_jobs(linear, cm.p), cm, d, {"tol_grad": 1e-9}, family).collect()}
    monkeypatch.setattr(NT, "BLOCK_BINS", 64)
    monkeypatch.setattr(NT, "LANE_BLOCKS", 1)
    long = {r["cfg"]: r for r in NT.newton_fit(blocks, NT.new_jobs(linear, cm.p), cm, d, {"tol_grad": 1e-9}, family).collect()}
    assert set(short) == set(long) == set(range(5))
    for c in short:
        assert long[c]["converged"] and short[c]["converged"]
        np.testing.assert_allclose(long[c]["w_best"], short[c]["w_best"], atol=1e-6)
        np.testing.assert_allclose(long[c]["report"], short[c]["report"], rtol=1e-5, atol=1e-6)
        assert long[c]["hold_sum"] == pytest.approx(short[c]["hold_sum"], abs=1e-6)


def test_steps_leave_directions_of_negative_curvature():
    h, g = np.diag([4.0, -1.0, 0.0]), np.array([1.0, 1.0, 0.0])
    step, promised, damp = NT.damped_step(h, g, 0.0)
    assert damp > 1 and promised > 0 and g @ step < 0 and step[2] == 0


def test_shifted_refits(spark):
    cm, x, y, keep, blocks, coo = small_problem(spark, [3, 31, 32, 200], excl=["states"])
    d, _ = B.smoothness_penalty(cm)
    n = len(y)
    perms = spark.range(4).select(F.lit(1).cast("bigint").alias("s"), F.lit("n0").alias("m"), F.col("id").cast("int").alias("perm"))
    shift = {r["perm"]: r["k"] for r in perms.select("perm", I.shift_of(F.col("s"), F.col("m"), F.col("perm"), F.lit(n).cast("bigint"), 42).alias("k")).collect()}
    cross = materialize(I.all_shifted_cross(blocks, cm, 4, I.seeded(42)))
    rows = cross.collect()
    assert sorted(r["perm"] for r in rows) == [0, 1, 2, 3]
    for r in rows:
        np.testing.assert_allclose(r["b"], x.T @ np.roll(y, shift[r["perm"]]), atol=1e-9)
    fits, _ = FT.gauss_cv_fit(M.fold_moments(blocks, cm), cm, d, [1.0])
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    mean[0], std[0] = 0, 1
    xs = (x - mean) / std
    for r in I.gauss_nulls(fits, cross, cm, d).collect():
        want = np.linalg.lstsq(xs.T @ xs + d.T @ d, xs.T @ np.roll(y, shift[r["perm"]]), rcond=1e-12)[0]
        np.testing.assert_allclose(r["w"], want, atol=1e-7)


def test_a_stack_of_steps_is_the_step_of_each():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(9, 12, 5))
    h = np.einsum("jui,juk->jik", a, a)
    h[1] -= 20 * np.eye(5)
    h[2, :, 4] = h[2, 4, :] = 0
    h[3] = np.ones((5, 5))
    h[4] = 0
    g = rng.normal(size=(9, 5))
    g[2, 4] = 0
    damp = np.where(np.arange(9) % 2, 0.5, 0.0)
    dead = np.zeros((9, 5, 5))
    dead[2, 4, 4] = 1
    for known in (None, dead):
        step, promised, used = NT.damped_steps(h, g, damp, known)
        for i in range(9):
            one = NT.damped_step(h[i], g[i], float(damp[i]))
            np.testing.assert_allclose(step[i], one[0], rtol=1e-7, atol=1e-9)
            assert promised[i] == pytest.approx(one[1], rel=1e-7, abs=1e-9) and used[i] == pytest.approx(one[2])


def test_distinct_rows_stand_for_all():
    x = np.random.default_rng(1).integers(0, 2, (300, 4)).astype(float)
    rows, place = NT.distinct_rows(x)
    assert len(rows) == 16
    np.testing.assert_array_equal(rows[place], x)


def test_verdicts_of_several_models_match_the_long_form(spark):
    cm = B.ColumnMap([B.Block("intercept", "intercept", 0, 1), B.Block("heard_any", "lagged", 1, 2, 0, 2, np.array([[1.0, 0], [0.5, 0.5], [0, 2]])),
                      B.Block("spike_history", "history", 3, 2, 1, 2)], 1.0, "spikes")
    rng = np.random.default_rng(5)
    real = [(s, m, rng.normal(size=5).tolist()) for s in range(3) for m in ("a", "b")]
    null = [(s, m, i, rng.normal(size=5).tolist()) for s, m, _ in real for i in range(7 + s)]
    w = spark.createDataFrame(real, "session_id bigint, model_id string, w array<double>")
    nulls = spark.createDataFrame(null, "session_id bigint, model_id string, perm int, w array<double>")
    p, ci = I.permutation_test(w, nulls, cm)
    keys = [*I.MODEL, "block"]
    long = FT.unpack_kernels(nulls, cm, ["perm"]).filter("block <> 'intercept'")
    want_p = I.permutation_p(FT.unpack_kernels(w, cm).filter("block <> 'intercept'"), I.null_peaks(long, keys), keys)
    want_ci = I.percentile_interval(long, [*keys, "pos"], "weight")
    for got, want, n in ((p, want_p, 3), (ci, want_ci, 4)):
        a, b = ({tuple(r)[:n]: tuple(r)[n:] for r in df.collect()} for df in (got, want))
        assert set(a) == set(b) and len(a) == (12 if n == 3 else 30)
        for k in a:
            np.testing.assert_allclose(a[k], b[k], atol=1e-12)
    # Refits meet their model once; no row per lag and refit is shuffled.
    assert "unpack" not in p._jdf.queryExecution().toString() and "collect_list" not in ci._jdf.queryExecution().toString()


def test_models_are_solved_side_by_side(monkeypatch):
    rng = np.random.default_rng(7)
    d = np.eye(4)
    opt = {"tol_grad": 1e-9, "tol_fun": 0.0, "max_iter": 100}
    rows, jobs, want = [], [], []
    for k in range(5):
        x = rng.integers(0, 2, (60 + k, 4)).astype(float)
        y, folds = rng.poisson(1.0, len(x)).astype(float), np.arange(len(x)) % 3
        rows.append(NT.ModelRows(x, y, folds, "poisson"))
        for hold in (-1, 0, 2):
            jobs.append({"session_id": k, "model_id": "n0", "cfg": hold + 1, "lam": 0.5, "holdout": hold, "shift": 0, "b": x[folds != hold].T @ y[folds != hold]})
            kept, b, w = x[folds != hold], jobs[-1]["b"], np.zeros(4)
            for _ in range(60):
                mu = np.exp(kept @ w)
                w = w - np.linalg.solve(kept.T @ (kept * mu[:, None]) + np.eye(4), kept.T @ mu - b + w)
            want.append(w)
    rounds, taken = [], NT.next_candidates
    monkeypatch.setattr(NT, "next_candidates", lambda *args: rounds.append(len(args[1])) or taken(*args))
    done = NT.solve_models(rows, np.arange(0, 16, 3), NT._stack(pd.DataFrame(jobs), 4), d, "poisson", opt)
    # Rounds of the slowest job, not of each model.
    assert len(rounds) == done["iters"].max() and rounds[0] == 15 and done["converged"].all()
    np.testing.assert_allclose(done["w_best"], want, atol=1e-7)


def test_factors_of_a_stack_of_packed_matrices():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(6, 9, 5))
    h = np.einsum("jui,juk->jik", a, a)
    upper = np.triu_indices(5)
    pivots, unit = NT.factored(np.ascontiguousarray(h[:, upper[0], upper[1]].T), 5)
    for j in range(6):
        u = np.triu(unit[:, :, j], 1) + np.eye(5)
        np.testing.assert_allclose(u.T @ np.diag(pivots[:, j]) @ u, h[j], rtol=1e-9, atol=1e-9)
