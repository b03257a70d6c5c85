"""Expanded rows are dealt over as many partitions as the input asks for, and stay where they are expanded."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from echogrid.operators import basis as B
from echogrid.operators import dsp as D
from echogrid.operators import features as X
from echogrid.operators import objective as O
from echogrid.operators import psth as P
from echogrid.operators import smooth as SM
from echogrid.operators import states as ST
from echogrid.runtime import parts_for, spread


def test_partitions_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(spark, 0, 10) == parts_for(spark, 10, 10) == least
    assert parts_for(spark, 1001, 10) == 101
    assert spread(spark.range(10), "id", parts=7).rdd.getNumPartitions() == 7


def test_projection_over_block_borders(spark):
    taps = spark.createDataFrame([("a", lag, k, 1.0 + lag + 10 * k) for lag in range(-2, 4) for k in range(2)], "stream string, lag int, col int, phi double")
    bins = [0, 1, 3, 4, 7, 8, 19]
    series = spark.createDataFrame([(1, "a", b, float(b + 1)) for b in bins], "session_id long, stream string, bin long, val double")
    found = X.project_basis(series, taps, ["session_id"], parts=5, block_bins=4)
    assert found.rdd.getNumPartitions() == 5
    wanted = {}
    for b in bins:
        for lag in range(-2, 4):
            for k in range(2):
                if b + lag >= 0:
                    wanted[b + lag, k] = wanted.get((b + lag, k), 0.0) + (b + 1) * (1.0 + lag + 10 * k)
    rows = found.collect()
    assert len(rows) == len(wanted)
    assert all(abs(r.val - wanted[r.bin, r.col]) < 1e-9 for r in rows)


def test_long_form_is_summed_where_its_cells_lie(spark):
    cols = B.ColumnMap([B.Block("a", "lagged", 0, 2, 0, 1, np.eye(2)), B.Block("spike_history", "history", 2, 2, 1, 2)], 1.0, "spikes")
    impulses = spark.createDataFrame([(s, "a", b) for s in (1, 2) for b in (2, 5, 9)], "session_id long, stream string, bin long")
    response = spark.createDataFrame([(s, "n0", b, 1.0) for s in (1, 2) for b in (3, 9)], "session_id long, model_id string, bin long, y double")
    sizes = spark.createDataFrame([(1, 10), (2, 12)], "session_id long, n_bins long")
    cells = X.design_coo(impulses, response, sizes, cols, parts=6)
    assert cells.rdd.getNumPartitions() == 6
    assert {(r.session_id, r.bin, r.col) for r in cells.collect()} == {
        (s, b + lag, first + lag - low)
        for s, n in ((1, 10), (2, 12))
        for bins, lags, first, low in (((2, 5, 9), (0, 1), 0, 0), ((3, 9), (1, 2), 2, 1))
        for b in bins
        for lag in lags
        if b + lag < n
    }
    eta = O.linear_predictor(cells, weight=F.lit(1.0))
    assert eta.rdd.getNumPartitions() == 6


def test_peri_event_counts_in_parts(spark):
    rng = random.Random(3)
    spikes = [(1, "n0", rng.uniform(0, 60)) for _ in range(300)]
    events = [(1, i, "k", rng.uniform(0, 60)) for i in range(40)]
    found = P.align_spikes(
        spark.createDataFrame(spikes, "session_id long, neuron_id string, t double"),
        spark.createDataFrame(events, "session_id long, ev_ord long, kind string, t_on double"),
        (-1.5, 2.0), 0.5, ["kind"], 4.0, 9,
    )
    assert found.rdd.getNumPartitions() == 9
    edges = P.peri_edges((-1.5, 2.0), 0.5)
    rows = {(r.ev_ord, r.bin): r.n for r in found.collect()}
    assert len(rows) == 40 * (len(edges) - 1)
    for _, i, _, on in events:
        for k in range(len(edges) - 1):
            assert rows[i, k] == sum(edges[k] <= t - on < edges[k + 1] for _, _, t in spikes)


def test_resampling_in_parts(spark):
    signal = spark.createDataFrame([(1, "c", i, float(i * i)) for i in range(16)], "session_id long, channel_id string, sample_idx long, v double")
    meta = spark.createDataFrame([(1, 4.0, 0.5, 16)], "session_id long, fs double, t0 double, n_samples long")
    sizes = spark.createDataFrame([(1, 15)], "session_id long, n_bins long")
    found = SM.resample_linear(signal, meta, sizes, 0.3, ["session_id", "channel_id"], 5)
    assert found.rdd.getNumPartitions() == 5
    plain = SM.resample_linear(signal, meta, sizes, 0.3, ["session_id", "channel_id"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_runs_of_bins_over_words(spark):
    rng = random.Random(5)
    for share in (0.1, 0.5, 0.9, 1.0):
        bins = [b for b in range(400) if rng.random() < share]
        cells = spark.createDataFrame([(1, b, "x") for b in bins + bins[:3]], "session_id long, bin long, state string")
        segments = ST.run_length_segments(cells, 1.0)
        found = sorted((r.first_bin, r.last_bin) for r in segments.collect())
        have = set(bins)
        assert found == list(zip([b for b in bins if b - 1 not in have], [b for b in bins if b + 1 not in have], strict=True))


def test_bins_meet_spans_without_a_shuffle_of_bins(spark):
    spans = spark.createDataFrame([(1, 5, 3000), (1, 2990, 4100), (2, 0, 0)], "session_id long, first_bin long, last_bin long")
    sizes = spark.createDataFrame([(1, 5000), (2, 3), (3, 2)], "session_id long, n_bins long")
    states = ST.compute_states(spans, sizes, 1.0)
    rows = {(r.session_id, r.bin): (r.convo, r.spon) for r in states.collect()}
    assert len(rows) == 5005
    for (s, b), found in rows.items():
        inside = (s == 1 and 5 <= b <= 4100) or (s == 2 and b == 0)
        assert found == (inside, not inside)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and ", bin#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_short_channels_share_python_calls(spark):
    """End states over a tail equal those sample by sample, and no Python call is made per channel."""
    b, a = D.butterworth(3, 0.06, "high")
    filt = D.LinearFilter(b, a)
    x = np.random.default_rng(1).normal(size=150)
    z = np.array([0.3, -0.2, 0.1])
    for v in x:
        z = filt.A @ z + filt.B * v
    assert np.allclose(filt.run(x, np.array([0.3, -0.2, 0.1]))[1], z, atol=1e-10)
    ends = spark.createDataFrame(
        [(s, f"c{c}", k, 4, float(s), [1.0 * k, 0.0, float(c)]) for s in (1, 2) for c in range(5) for k in range(3)],
        "session_id long, channel_id string, blk long, n int, edge double, push array<double>",
    )
    found = D._start_states(ends, filt, False)
    assert "InPandas" in found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        z = filt.rest * r.session_id
        for k in range(r.blk):
            z = filt.advance(4) @ z + np.array([1.0 * k, 0.0, float(r.channel_id[1:])])
        assert np.allclose(r.z, z)
