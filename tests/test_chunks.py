"""Random dense sessions against brute force, with chunks far shorter than the session."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import events as E
from echogrid.operators import scan
from echogrid.operators import states as ST
from echogrid.runtime import materialize
from echogrid.operators.events import mark_addressed


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in (1, 2):
        for i in range(160 if s == 1 else 25):
            on = round(float(rng.uniform(0, 150)), 1)
            off = on + round(float(rng.choice([0.0, 0.2, 0.7, 9.0], p=[0.1, 0.5, 0.35, 0.05])), 1)
            kind = "perceived" if rng.random() < 0.6 else "produced"
            rows.append((s, i, kind, on, off, "twitter" if rng.random() < 0.7 else "phee"))
    df = spark.createDataFrame(rows, "session_id bigint, ev_ord bigint, kind string, t_on double, t_off double, label string")
    return rows, materialize(df)


def test_classes(case):
    rows, df = case
    points = E.instants(df)
    ctx = {(r["session_id"], r["ev_ord"]): r["stream"] for r in E.label_events(df, E.produced_context(points, chunk_s=7.0), "produced").collect()}
    near = {(r["session_id"], r["ev_ord"]): r["stream"] for r in E.label_events(df, E.heard_proximity(points, chunk_s=7.0), "perceived").collect()}
    for s, i, kind, on, _, _ in rows:
        mine = [r for r in rows if r[0] == s]
        if kind == "produced":
            prev = [r for r in mine if on - 5.0 <= r[3] < on]
            want = "produced_spontaneous"
            if prev:
                top = max(r[3] for r in prev)
                want = "produced_after_heard" if min((r for r in prev if r[3] == top), key=lambda r: r[1])[2] == "perceived" else "produced_after_produced"
            assert ctx[(s, i)] == want
        else:
            d = min([0.0 if r[3] <= on <= r[4] else (r[3] - on if on < r[3] else on - r[4]) for r in mine if r[2] == "produced"], default=np.inf)
            assert near[(s, i)] == ("heard_addressed" if d <= 4 else "heard_overheard" if d >= 5 else None)


def test_sequences_and_bouts(case):
    rows, df = case
    for gap in (0.3, 1.1):
        got = sorted((r["session_id"], r["p_on"], r["p_off"]) for r in ST.produced_sequences(df, gap, 5.0).collect())
        want = []
        for s in (1, 2):
            cur = None
            for r in sorted((r for r in rows if r[0] == s and r[2] == "produced"), key=lambda r: (r[3], r[1])):
                if cur is not None and r[3] - cur[1] <= gap:
                    cur[1] = max(cur[1], r[4])
                else:
                    if cur is not None and cur[1] > cur[0]:
                        want.append((s, *cur))
                    cur = [r[3], r[4]]
            if cur is not None and cur[1] > cur[0]:
                want.append((s, *cur))
        assert got == sorted(want)
    kept = E.collapse_bouts(df, 2.05, 6.0).filter("kind = 'produced' and label = 'twitter'").collect()
    got = sorted((r["session_id"], r["t_on"], r["ev_ord"] - E.BOUT_ORD_SHIFT) for r in kept)
    want = []
    for s in (1, 2):
        start = None
        for r in sorted((r for r in rows if r[0] == s and r[2] == "produced" and r[5] == "twitter"), key=lambda r: (r[3], r[1])):
            if start is None or r[3] - start > 2.05:
                start = r[3]
                want.append((s, r[3], r[1]))
    assert got == sorted(want)


def test_chunk_size_does_not_matter(case):
    _, df = case
    runs = []
    for chunk in (4.0, 500.0):
        iv = ST.merge_intervals(ST.conversation_intervals(df, 3.0, 0.3, chunk_s=chunk), chunk_s=chunk)
        addressed = mark_addressed(df, 2.0, chunk).select("session_id", "ev_ord", "addressed")
        runs.append((sorted(map(tuple, iv.collect())), sorted(map(tuple, addressed.collect()))))
    assert runs[0] == runs[1] and len(runs[0][0]) > 3


def test_long_intervals_are_not_copied(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        on = round(float(rng.uniform(0, 300)), 1)
        length = float(rng.choice([0.2, 40.0, 1e12, -1e9], p=[0.7, 0.2, 0.05, 0.05])) if on > 60 else 0.3
        rows.append((1, i, "produced" if rng.random() < 0.4 else "perceived", on, round(on + length, 1), "phee"))
    df = materialize(spark.createDataFrame(rows, "session_id bigint, ev_ord bigint, kind string, t_on double, t_off double, label string"))
    made = [(min(r[3], r[4]), max(r[3], r[4])) for r in rows if r[2] == "produced"]
    near = {r["ev_ord"]: r["stream"] for r in E.label_events(df, E.heard_proximity(E.instants(df), chunk_s=7.0), "perceived").collect()}
    for _, i, kind, on, _, _ in rows:
        if kind == "perceived":
            d = min(max(lo - on, on - hi, 0.0) for lo, hi in made)
            assert near[i] == ("heard_addressed" if d <= 4 else "heard_overheard" if d >= 5 else None)
    spans = df.filter("t_off > t_on").select("session_id", "t_on", "t_off")
    got = sorted((r["t_on"], r["t_off"]) for r in scan.merge_islands(spans, ["session_id"], 0.5, chunk_s=7.0).collect())
    want = []
    for on, off in sorted((r[3], r[4]) for r in rows if r[4] > r[3]):
        if want and on - want[-1][1] <= 0.5:
            want[-1] = (want[-1][0], max(want[-1][1], off))
        else:
            want.append((on, off))
    assert got == want and len(want) > 3


def test_asof_without_reach(spark):
    rng = np.random.default_rng(9)
    left = sorted(rng.uniform(0, 1000, 60).round(2).tolist())
    right = sorted(set(rng.uniform(0, 400, 25).round(2).tolist()))
    lhs = spark.createDataFrame([(1, v) for v in left], "s bigint, a double")
    rhs = spark.createDataFrame([(1, v) for v in right], "s bigint, b double")
    for strict in (False, True):
        got = scan.asof_join(lhs, rhs, ["s"], F.col("a"), F.col("b"), ["b"], None, strict=strict, chunk_s=11.0)
        got = {r["a"]: r["match"] and r["match"]["b"] for r in got.collect()}
        assert got == {v: max((x for x in right if x < v or (x == v and not strict)), default=None) for v in left}


def test_prefix_rank(spark):
    df = spark.range(0, 500).select(F.lit(1).alias("s"), (F.col("id") * 3).alias("bin"))
    got = scan.prefix_rank(df, ["s"], "bin", F.floor(F.col("bin") / 64)).orderBy("bin").collect()
    assert [r["row_idx"] for r in got] == list(range(500))
