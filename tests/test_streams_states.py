from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echogrid.operators import events as E
from echogrid.operators import grid as G
from echogrid.operators import states as ST
from echogrid.operators import streams as S


def stream_bins(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["stream"]].append(r["bin"])
    return {k: sorted(v) for k, v in out.items()}


def sizes(spark, n):
    return spark.createDataFrame([(1, n)], "session_id bigint, n_bins bigint")


def test_single_heard(spark, make_events):
    got = stream_bins(S.build_streams(make_events([("P", 0.05, 0.25)]), 0.1, {}, sizes(spark, 6)))
    assert got == {"heard_any": [0], "heard_overheard": [0]}


def test_stream_overlap(spark, make_events):
    ev = make_events([("P", 0.05, 0.08), ("R", 0.10, 0.18), ("R", 0.20, 0.28), ("P", 0.30, 0.38), ("R", 0.40, 0.48)])
    got = stream_bins(S.build_streams(ev, 0.1, {}, sizes(spark, 6)))
    assert got["heard_any"] == [0, 3] and got["heard_addressed"] == [0, 3]
    assert got["produced_after_heard"] == [1, 4] and got["produced_after_produced"] == [2]
    assert got["produced_any"] == [1, 2, 4]


def test_stream_edges(spark, make_events):
    ev = make_events([("P", 0.10, 0.20), ("R", 0.50, 0.60), ("R", 0.60, 0.70), ("P", 0.20, 0.20)])
    got = stream_bins(S.build_streams(ev, 0.1, {}, sizes(spark, 6)))
    assert got["heard_any"] == [1]
    assert got["produced_after_heard"] == [5]
    assert "produced_after_produced" not in got


def test_stream_lookback(spark, make_events):
    ev = make_events([("P", 1.0, 1.2), ("R", 2.0, 2.2), ("R", 2.5, 2.7), ("R", 8.0, 8.2)])
    got = stream_bins(S.build_streams(ev, 0.5, {}, sizes(spark, 20)))
    assert got["produced_after_heard"] == [4]
    assert got["produced_after_produced"] == [5]
    assert got["produced_spontaneous"] == [16]


def test_call_types(spark, make_events):
    ev = make_events([("R", 0.0, 0.05, "phee"), ("R", 0.1, 0.15, "Twitter"), ("R", 0.2, 0.25, "trill"), ("R", 0.3, 0.35, "trill-phee"), ("R", 0.4, 0.45, "egg12")])
    cfg = {"produced_split_mode": "call_type"}
    assert S.produced_names(ev, cfg) == [
        "produced_phee", "produced_twitter", "produced_trill", "produced_trillphee", "produced_egg"]
    got = stream_bins(S.build_streams(ev, 0.1, cfg, sizes(spark, 6)))
    assert got["produced_phee"] == [0] and got["produced_twitter"] == [1]
    assert got["produced_trill"] == [2] and got["produced_trillphee"] == [3]


CASES = [
    (1.0, 15, [("P", 1.0, 1.3), ("R", 7.0, 7.3)], []),
    (1.0, 16, [("P", 2, 2.2), ("R", 4, 4.3), ("R", 5, 5.2), ("P", 7, 7.4), ("R", 9, 9.2)], list(range(2, 10))),
    (1.0, 18, [("P", 1, 1.2), ("R", 3, 3.2), ("P", 6, 6.3)], [1, 2, 3]),
    (1.0, 14, [("P", 0.5, 0.7), ("R", 2, 2.3)], [0, 1, 2]),
]


@pytest.mark.parametrize("dt,n,rows,expected", CASES)
@pytest.mark.parametrize("chunk_s", [0.7, 3.0, 500.0])
def test_states(spark, make_events, dt, n, rows, expected, chunk_s):
    spans = ST.conversation_bins(make_events(rows), sizes(spark, n), dt, 5.0, 5.0, chunk_s)
    st = ST.compute_states(spans, sizes(spark, n), dt).orderBy("bin").collect()
    assert [r["bin"] for r in st if r["convo"]] == expected
    assert all(r["convo"] != r["spon"] for r in st) and len(st) == n


def test_back_chain(spark, make_events):
    ev = make_events([("P", 3.3, 3.4), ("P", 3.9, 4.0), ("P", 4.35, 4.4), ("P", 4.75, 4.8), ("R", 5.1, 5.3)])
    for chunk_s in (0.4, 1.0, 100.0):
        iv = ST.merge_intervals(ST.conversation_intervals(ev, 5.0, 5.0, chunk_s=chunk_s), chunk_s=chunk_s).collect()
        assert [(r["t_on"], r["t_off"]) for r in iv] == [(3.9, 5.3)]


def onsets(df):
    return sorted(r["t_on"] for r in df.collect())


def test_bouts(spark, make_events):
    ev = make_events([("R", 0, 0.1, "twitterA"), ("R", 0.4, 0.5, "twitterB"), ("R", 2.0, 2.1, "twitterC")])
    assert onsets(E.collapse_bouts(ev, 1.0)) == [0.0, 2.0]
    ev = make_events([("R", t, t + 0.1, "twitter") for t in (0, 1.6, 3.3)])
    assert onsets(E.collapse_bouts(ev, 1.5)) == [0.0, 1.6, 3.3]
    ev = make_events([("R", t, t + 0.1, "t-w_itter") for t in (0, 0.4, 1.6, 1.7, 3.3)] + [("P", 0.2, 0.3, "twitter")])
    for chunk_s in (0.5, 2.0, 100.0):
        assert onsets(E.collapse_bouts(ev, 1.5, chunk_s)) == [0.0, 0.2, 1.6, 3.3]


def test_segments(spark, make_events):
    ev = make_events(CASES[1][2])
    spans = ST.conversation_bins(ev, sizes(spark, 16), 1.0, 5.0, 5.0)
    seg = ST.state_segments(spans, sizes(spark, 16), 1.0)
    got = sorted((r["t_on"], r["t_off"], r["state"]) for r in seg.collect())
    assert got == [(0.0, 2.0, "spon"), (2.0, 10.0, "convo"), (10.0, 16.0, "spon")]
    st = ST.compute_states(spans, sizes(spark, 16), 1.0)
    st = st.withColumn("state", F.when(F.col("convo"), "convo").when(F.col("spon"), "spon"))
    again = sorted((r["t_on"], r["t_off"], r["state"]) for r in ST.run_length_segments(st, 1.0).collect())
    assert again == got


def test_timebase(spark, make_events):
    ev = make_events([("P", 0.0, 0.101)])
    assert G.grid_sizes(G.session_extent(ev), 0.05).first()["n_bins"] == 3
    spikes = spark.createDataFrame([(1, "n", t) for t in (0.05, 0.1, 0.19)], "session_id bigint, neuron_id string, t double")
    ext = G.session_extent(make_events([("P", 0.0, 0.22)]), spikes)
    n = G.grid_sizes(ext, 0.02).first()["n_bins"]
    assert (n - 1) * 0.02 >= 0.22 - 1e-12


def test_spike_bins(spark):
    rows = [(1, "n", t) for t in (0.0, 0.1, 0.2, 0.5)]
    spikes = spark.createDataFrame(rows, "session_id bigint, neuron_id string, t double")
    got = G.spike_raster(spikes, sizes(spark, 6), 0.1).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 1, 1, 0, 0, 1]
    import numpy as np

    for dt in (0.1, 0.05, 0.01):
        ts = [float(x) for x in np.round(np.arange(0, 3, 0.01), 2)]
        df = spark.createDataFrame([(1, "n", t) for t in ts], "session_id bigint, neuron_id string, t double")
        n = int(round(3 / dt))
        got = {r["bin"]: r["n"] for r in G.spike_counts(df, sizes(spark, n), dt).collect()}
        edges = np.append(np.arange(n) * dt, (n - 1) * dt + dt)
        want = np.histogram(ts, edges)[0]
        assert [got.get(i, 0) for i in range(n)] == list(want)
