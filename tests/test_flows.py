import math
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid import config as C
from echogrid.functions import numeric as N
from echogrid.operators import evaluate as EV
from echogrid.operators import infer as I
from echogrid.operators import psth as P
from echogrid.operators import validate as V
from echogrid.operators.moments import pack_sym
from echogrid.plans import flows, plotdata, sinks
from echogrid.schema import InputError
from echogrid.sources import files, labels, signal
from tests import synthetic_sessions as synthetic


def test_text_labels(spark, tmp_path):
    path = tmp_path / "S12_heard.txt"
    path.write_text("# head\n0.5\t0.7\tproduced\n\n 1.0\t1.5\ttrill\tphee \n2.0\t2.0\n")
    rows = labels.load_labels(spark, str(path), "perceived").orderBy("ev_ord").collect()
    assert [(r["kind"], r["t_on"], r["t_off"], r["label"]) for r in rows] == [
        ("produced", 0.5, 0.7, "produced"), ("perceived", 1.0, 1.5, "trill\tphee"), ("perceived", 2.0, 2.0, "")]
    assert rows[0]["session_id"] == 12
    assert labels.count_label_lines(spark, str(path)) == 3
    assert labels.count_label_lines(spark, str(tmp_path / "none.txt")) == 0
    for text, code in (("1.0\n", "InvalidLabelsStruct"), ("a\t2\tx\n", "InvalidLabelTimes"), ("2\t1\tx\n", "InvalidLabelTimes")):
        path.write_text(text)
        with pytest.raises(InputError) as err:
            labels.load_labels(spark, str(path), "perceived")
        assert err.value.code == code
    path.write_text("1\t2\tphee\n")
    with pytest.raises(InputError) as err:
        labels.load_labels(spark, str(path))
    assert err.value.code == "InvalidLabelKind"
    with pytest.raises(InputError):
        labels.load_labels(spark, "x.csv")


def test_validation(spark, make_events):
    def sp(ts):
        return spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(ts)], "session_id bigint, ord bigint, t double")

    ok = make_events([("P", 0.1, 0.2)])
    V.validate_inputs(sp([0.1, 0.2, 0.2]), ok, 1.0)
    for spikes, events, code in (
        (sp([0.2, 0.1]), ok, "SpikeTimesOrder"), (sp([0.1, float("nan")]), ok, "SpikeTimesFinite"),
        (sp([0.1]), make_events([("P", 0.3, 0.2)]), "EventTimesOrder"), (sp([0.1, 2.0]), ok, "TimeBounds"),
        (sp([0.1]), make_events([("P", 0.3, 5.0)]), "TimeBounds"),
    ):
        with pytest.raises(InputError) as err:
            V.validate_inputs(spikes, events, 1.0)
        assert err.value.code == code


def test_metrics(spark):
    y, mu = np.arange(4.0), np.array([0.5, 1.2, 1.8, 2.5])
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(y, mu)], "k int, y double, mu double")
    row = EV.poisson_metrics(df, ["k"]).first()
    lf = np.array([math.lgamma(v + 1) for v in y])
    model, sat = np.sum(y * np.log(mu) - mu), np.sum(y[1:] * np.log(y[1:]) - y[1:])
    null = np.sum(y * np.log(1.5) - 1.5)
    assert abs(row["nll"] - np.sum(mu - y * np.log(mu) + lf)) < 1e-9
    assert abs(row["pseudoR2"] - (1 - (sat - model) / (sat - null))) < 1e-12
    ones = spark.createDataFrame([(1, 1.0, 1.0)] * 3, "k int, y double, mu double")
    assert math.isnan(EV.poisson_metrics(ones, ["k"]).first()["pseudoR2"])
    s = EV.signal_metrics(ones, ["k"]).first()
    assert math.isnan(s["r2"]) and s["correlation"] == 1.0 and s["mse"] == 0.0
    big = spark.createDataFrame([(1, 30.0, 25.0), (1, 2.0, 3.0)], "k int, y double, mu double")
    want = 25 - 30 * math.log(25) + math.lgamma(31) + 3 - 2 * math.log(3) + math.lgamma(3)
    assert abs(EV.poisson_metrics(big, ["k"]).first()["nll"] - want) < 1e-9


def test_percentile(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (4, 2, 1, 3)], "k int, v double")
    r = I.percentile_interval(df, ["k"], "v", 25, 97.5).first()
    assert r["ci_lower"] == 1.5 and r["ci_upper"] == 4.0


def test_psth_matches_pairs(spark, make_events):
    rng = np.random.default_rng(0)
    times = np.round(np.sort(rng.uniform(0, 30, 400)), 1)
    evs = np.round(rng.uniform(0, 30, 25), 1)
    spikes = spark.createDataFrame([(1, "a", float(t)) for t in times], "session_id bigint, neuron_id string, t double")
    events = make_events([("P", t, t + 0.1) for t in evs])
    for win, size in (((-1.0, 1.0), 0.1), ((-0.5, 0.75), 0.2)):
        edges = P.peri_edges(win, size)
        got = {(r["ev_ord"], r["bin"]): r["n"] for r in P.align_spikes(spikes, events, win, size, chunk_s=4.0).collect()}
        assert len(got) == len(evs) * (len(edges) - 1)
        for i, e in enumerate(evs):
            rel = times - e
            rel = rel[(rel >= win[0]) & (rel < win[1])]
            want = np.histogram(rel, edges)[0]
            assert [got[(i, b)] for b in range(len(edges) - 1)] == list(want)


def test_config():
    assert C.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}}
    assert C.get_path({"a": {"b": 1}}, "a.b") == 1 and C.get_path({}, "x.y", 7) == 7
    assert C.set_path({}, "a.b.c", 3) == {"a": {"b": {"c": 3}}}
    assert C.round_half_away(-2.5) == -3 and C.round_half_away(2.5) == 3
    with pytest.raises(C.ConfigError):
        C.split_mode({"produced_split_mode": "other"})
    with pytest.raises(C.ConfigError):
        C.bout_window({"twitter_bout_window_s": 0})


def test_files(tmp_path):
    p = str(tmp_path / "a.wav")
    with wave.open(p, "wb") as fh:
        fh.setnchannels(1)
        fh.setsampwidth(2)
        fh.setframerate(100)
        fh.writeframes(b"\0\0" * 250)
    assert files.audio_duration(p) == 2.5
    with pytest.raises(InputError):
        files.resolve_file("nope.txt")
    assert files.resolve_file("nope.txt", allow_empty=True) is None


def test_spike_flow_recovers_kernel(spark, tmp_path):
    events, spikes = synthetic.synthetic_spikes(spark, 1, 300.0, dt=0.01)
    cfg = {"dt": 0.05, "heard_window_s": [0, 1], "produced_window_s": [-2, 1], "history_window_s": [0.05, 0.2],
           "exclude_predictors": ["states"], "cv": {"k": 3, "lambdas": [0.1, 1.0]}}
    out = flows.fit_spikes(spikes, events, cfg, n_perms=5)
    m = out.metrics.first()
    assert math.isfinite(m["nll"]) and m["pseudoR2"] > 0.02
    made = out.kernels.filter(F.col("block").startswith("produced_")).orderBy(F.desc("weight")).first()
    assert -2.0 <= made["lag_s"] <= -0.8
    assert {r["block"] for r in out.ptest.collect()} == {b.name for b in out.colmap.blocks} - {"intercept"}
    assert out.null_status.first()["n_refits"] == 5
    qc = flows.qc_summary(out)
    row = qc.first()
    assert row["n_params"] == out.colmap.p and row["n_kernels"] > 0 and row["event_counts"]["heard_any"] > 0
    sinks.write_qc(qc, str(tmp_path / "qc"))
    assert spark.read.json(str(tmp_path / "qc")).count() == 1
    for name in ("kernels", "metrics", "cv"):
        sinks.write_fit({name: out.frames[name]}, str(tmp_path / "fit"))
        assert os.path.exists(tmp_path / "fit" / name)
    assert plotdata.kernel_panels(out.kernels, out.ptest, out.ptest_ci).count() == out.kernels.count()
    assert plotdata.event_preview(out.rates, out.events, 0.05).count() > 0
    assert plotdata.psth_panels(spikes, events, {**out.cfg, "dt": 0.25}).count() > 0


def test_signal_flow(spark):
    sig, meta, events = synthetic.synthetic_signal(spark, 1, {"session_duration": 60.0, "fs": 400.0, "n_channels": 2})
    cfg = {"dt": 0.05, "history_window_s": [0.1, 0.5], "lfp": {"bandpass_hz": [70, 150], "power_smoothing_ms": 50}, "cv": {"k": 3}}
    out = flows.fit_signal(sig, meta, events, 400.0, cfg, n_perms=20)
    rows = out.metrics.collect()
    assert len(rows) == 2 and all(math.isfinite(r["r2"]) for r in rows)
    assert out.significance.count() == 2


def test_state_export(spark, make_events, tmp_path):
    ev = make_events([("P", 2, 2.2), ("R", 4, 4.3), ("R", 5, 5.2), ("P", 7, 7.4), ("R", 9, 9.2)])
    dur = spark.createDataFrame([(1, 15.0)], "session_id bigint, duration double")
    path = str(tmp_path / "track")
    seg = flows.export_states(ev, path, {"dt": 1.0}, dur)
    assert seg.count() == 3
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert sorted(lines) == ["0.000000\t2.000000\tspon", "10.000000\t16.000000\tspon", "2.000000\t10.000000\tconvo"]


def test_signal_checks(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, float("nan"))], "session_id bigint, channel_id string, sample_idx bigint, v double")
    with pytest.raises(InputError):
        signal.check_signal(df)
    meta = signal.signal_meta(df, 10.0).first()
    assert meta["n_samples"] == 2 and meta["duration"] == 0.1


def test_wald(spark):
    h = np.array([[4.0, 1.0], [1.0, 3.0]])
    rows = [(1, [0.7, 0.2], pack_sym(h).tolist()), (2, [0.0, 0.0], [0.0, 0.0, 0.0])]
    fits = spark.createDataFrame(rows, "model_id int, w array<double>, hessian array<double>")
    got = {r["model_id"]: r for r in EV.wald_contrast(fits, ["model_id"], 0, 1).collect()}
    cov = np.linalg.inv(h)
    z = 0.5 / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert abs(got[1]["z_score"] - z) < 1e-12 and abs(got[1]["p_value"] - math.erfc(z / math.sqrt(2))) < 1e-12
    assert got[2]["z_score"] is None or math.isnan(got[2]["z_score"])


def test_rollup_names_the_hits(spark):
    p = spark.createDataFrame([(1, "a", "x", 0.01), (1, "a", "y", 0.2), (1, "b", "x", 0.5), (1, "b", "y", float("nan"))],
                              "session_id int, model_id string, block string, p_value double")
    roll = EV.significance_rollup(p, ["session_id", "model_id"])
    assert {r["model_id"]: (r["n_kernels"], r["n_significant"], r["hits"]) for r in roll.collect()} == {"a": (2, 1, ["x"]), "b": (1, 0, [])}
    total = EV.significance_totals(roll, ["session_id"]).first()
    assert (total["n_models"], total["n_models_hit"], total["models_hit"]) == (2, 1, ["a"])


def test_neuron_without_spikes_is_fitted(spark, make_events):
    ev = make_events([("P", 0.2, 0.4), ("R", 0.5, 0.6), ("P", 0.9, 1.0), ("R", 1.2, 1.3)])
    spikes = [(1, "n0", t / 50) for t in range(90)] + [(1, "mute", -5.0)]
    cfg = {"dt": 0.05, "heard_window_s": [0, 0.2], "produced_window_s": [-0.2, 0.2], "history_window_s": [0.05, 0.3],
           "cv": {"k": 2, "lambdas": [0.5]}}
    out = flows.fit_spikes(spark.createDataFrame(spikes, "session_id bigint, neuron_id string, t double"), ev, cfg, n_perms=0)
    assert {r["model_id"] for r in out.fits.collect()} == {"n0", "mute"}


def test_log_link_flow(spark):
    sig, meta, events = synthetic.synthetic_signal(spark, 1, {"session_duration": 40.0, "fs": 200.0, "n_channels": 1})
    cfg = {"dt": 0.1, "history_window_s": [0.1, 0.3], "lfp": {"link": "log", "bandpass_hz": [20, 60]}, "cv": {"k": 2, "lambdas": [1.0]}}
    out = flows.fit_signal(sig, meta, events, 200.0, cfg, n_perms=5)
    assert out.predictions.filter("mu <= 0").isEmpty()
    assert math.isfinite(out.metrics.first()["mse"])
    assert all(0 <= r["p_value"] <= 1 for r in out.ptest.collect())
    assert out.null_status.first()["n_refits"] == 5


def test_dead_session_is_told(spark):
    rows = [(s, "c", b, float(b) if s == 1 else 2.0) for s in (1, 2) for b in range(5)]
    binned = spark.createDataFrame(rows, "session_id bigint, channel_id string, bin bigint, v double")
    with pytest.raises(InputError, match="session 2"):
        V.require_live_signal(binned)
    V.require_live_signal(binned.filter("session_id = 1"))


def test_label_lines_with_tabs_numbers_and_line_numbers(spark, tmp_path):
    path = tmp_path / "S3_x.txt"
    path.write_text("# head\n1\t2\t\tproduced\n1e0\t2\theard\n")
    got = sorted((r["kind"], r["label"]) for r in labels.load_text(spark, str(path), "perceived").collect())
    assert got == [("perceived", "heard"), ("produced", "produced")]
    path.write_text("# head\n1\t2\tx\n\n1d\t2f\tx\n")
    with pytest.raises(InputError, match="line 4 of"):
        labels.load_text(spark, str(path), "perceived")


def test_log_factorial_of_large_counts(spark):
    ys = [0, 1, 5, 20, 21, 22, 50, 1000, 10**6]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in ys], "y bigint").select(N.log_factorial(F.col("y"))).collect()]
    assert np.allclose(sorted(got), sorted(math.lgamma(y + 1) for y in ys), rtol=1e-12, atol=1e-12)
