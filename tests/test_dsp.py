import numpy as np
import pytest

from echogrid.operators import dsp as D
from echogrid.operators import smooth as SM


def naive_lfilter(b, a, x, z):
    b, a = np.asarray(b, float), np.asarray(a, float)
    m = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, m + 1 - len(b))), np.pad(a, (0, m + 1 - len(a)))
    z = np.append(z, 0.0)
    y = np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = b[1:] * v + z[1:] - a[1:] * y[i]
    return y


def naive_filtfilt(b, a, x):
    m = max(len(a), len(b)) - 1
    pad = 3 * m
    rest = D.LinearFilter(b, a).rest
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = naive_lfilter(b, a, e, rest * e[0])[::-1]
    return naive_lfilter(b, a, y, rest * y[0])[::-1][pad:-pad]


def naive_hilbert(x):
    n = len(x)
    f = np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(f * h)


def frames(spark, xs):
    rows = [(s, "c", i, float(v)) for s, x in xs.items() for i, v in enumerate(x)]
    sig = spark.createDataFrame(rows, "session_id bigint, channel_id string, sample_idx bigint, v double")
    meta = spark.createDataFrame([(s, len(x)) for s, x in xs.items()], "session_id bigint, n_samples bigint")
    return sig, meta


def collect(df, s):
    got = sorted((r["sample_idx"], r["v"]) for r in df.filter(f"session_id = {s}").collect())
    assert [i for i, _ in got] == list(range(len(got)))
    return np.array([v for _, v in got])


def test_butterworth_shape():
    b, a = D.butterworth(4, [0.14, 0.3], "bandpass")
    w = np.exp(1j * np.pi * np.array([0.14, 0.3, 0.01, 0.9]))
    gain = np.abs(np.polyval(b, w) / np.polyval(a, w))
    np.testing.assert_allclose(gain[:2], np.sqrt(0.5), rtol=1e-9)
    assert gain[2] < 1e-4 and gain[3] < 1e-4
    # Published table values of the second-order half-band low-pass.
    b, a = D.butterworth(2, 0.5, "low")
    np.testing.assert_allclose(b, [0.2928932, 0.5857864, 0.2928932], atol=1e-6)
    np.testing.assert_allclose(a, [1, 0, 0.1715729], atol=1e-6)


@pytest.mark.parametrize("which", ["band", "box", "drift"])
def test_filtfilt(spark, which):
    rng = np.random.default_rng(1)
    xs = {1: rng.normal(size=1000), 2: rng.normal(size=333).cumsum()}
    b, a = {"band": D.band_filter([70, 150], 1000.0), "box": (np.ones(50) / 50, np.array([1.0])),
            "drift": D.butterworth(3, 0.02, "high")}[which]
    sig, meta = frames(spark, xs)
    out = D.filtfilt(sig, meta, b, a, block=128)
    for s, x in xs.items():
        np.testing.assert_allclose(collect(out, s), naive_filtfilt(b, a, x), atol=1e-8)


@pytest.mark.parametrize("fan", [2, 3])
def test_states_through_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(D, "FAN", fan)
    rng = np.random.default_rng(5)
    xs = {1: rng.normal(size=700), 2: rng.normal(size=90).cumsum()}
    b, a = D.butterworth(3, 0.02, "high")
    sig, meta = frames(spark, xs)
    out = D.filtfilt(sig, meta, b, a, block=64)
    for s, x in xs.items():
        np.testing.assert_allclose(collect(out, s), naive_filtfilt(b, a, x), atol=1e-8)


@pytest.mark.parametrize("width,block", [(2, 16), (50, 128), (50, 16), (33, 1000)])
def test_box(spark, width, block):
    rng = np.random.default_rng(6)
    xs = {1: rng.normal(size=1000) + 1e4, 2: rng.normal(size=333).cumsum(), 3: rng.normal(size=3 * width - 2)}
    sig, meta = frames(spark, xs)
    out = D.box_filtfilt(sig, meta, width, block).cache()
    for s, x in xs.items():
        np.testing.assert_allclose(collect(out, s), naive_filtfilt(np.ones(width) / width, np.array([1.0]), x), atol=1e-8)
    with pytest.raises(D.InputError):
        D.box_filtfilt(*frames(spark, {1: rng.normal(size=3 * width - 3)}), width, block)


def test_hilbert(spark):
    rng = np.random.default_rng(2)
    xs = {1: rng.normal(size=1000), 2: rng.normal(size=777), 3: rng.normal(size=5)}
    sig, meta = frames(spark, xs)
    out = D.envelope(sig, meta).cache()
    for s, x in xs.items():
        np.testing.assert_allclose(collect(out, s), np.abs(naive_hilbert(x)), atol=1e-9)


def test_resample_and_normalize(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    sig, _ = frames(spark, {1: x})
    meta = spark.createDataFrame([(1, 10.0, 0.05, 200)], "session_id bigint, fs double, t0 double, n_samples bigint")
    for dt in (0.07, 0.25):
        n = int(22 / dt)
        sizes = spark.createDataFrame([(1, n)], "session_id bigint, n_bins bigint")
        got = {r["bin"]: r["v"] for r in SM.resample_linear(sig, meta, sizes, dt, ["session_id", "channel_id"]).collect()}
        t = np.arange(n) * dt
        want = np.interp(t, 0.05 + np.arange(200) / 10.0, x, left=0, right=0)
        np.testing.assert_allclose([got.get(i, 0.0) for i in range(n)], want, atol=1e-9)
        sparse = SM.resample_linear(sig, meta, sizes, dt, ["session_id", "channel_id"])
        rows = sizes.withColumnRenamed("n_bins", "n_rows")
        z = {r["bin"]: r["v"] for r in SM.normalize(sparse, rows, ["session_id", "channel_id"]).collect()}
        ref = (want - want.mean()) / want.std(ddof=1)
        np.testing.assert_allclose([z[i] for i in sorted(z)], ref[sorted(z)], atol=1e-8)


def test_smooth_decimate(spark):
    rng = np.random.default_rng(4)
    n, dt = 500, 0.01
    y = rng.poisson(0.2, n).astype(float)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y) if v], "session_id bigint, bin bigint, y double")
    sizes = spark.createDataFrame([(1, n)], "session_id bigint, n_bins bigint")
    got = {r["bin"]: r["y"] for r in SM.smooth_decimate(df, sizes, dt, ["session_id"], ["y"]).collect()}
    g = np.exp(-0.5 * (np.arange(-15, 16) / 5) ** 2)
    want = np.convolve(y, g / g.sum(), "same") / dt
    keep = range(15, n - 15, 10)
    np.testing.assert_allclose([got.get(i, 0.0) for i in keep], want[list(keep)], atol=1e-9)
    assert set(got) <= set(keep)
