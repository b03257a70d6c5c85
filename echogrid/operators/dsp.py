"""Channel filters on blocks of samples.

A long channel is never held by one task. Recursive filters are linear, so a
block's end state is (its response from rest) + (a fixed matrix) x (its start
state); start states follow from one small row per block. The Hilbert
transform is a circular convolution done with a two-stage FFT whose groups
hold about the square root of the channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.runtime import materialize, spread
from echogrid.schema import InputError

CHANNEL = ["session_id", "channel_id"]
BLOCK_SAMPLES = 4096
SUB = 64
TILE = 32
# Blocks (or groups of them) whose states one task walks.
FAN = 256


# ---- filter design -----------------------------------------------------------


def butterworth(order: int, cut: float | list[float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter; ``cut`` in units of Nyquist."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = 4.0 * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / 2.0)
    if kind == "high":
        p, z = warp[0] / poles, np.zeros(order)
    elif kind == "low":
        p, z = warp[0] * poles, np.zeros(0)
    elif kind == "bandpass":
        bw, mid = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
        half = poles * bw / 2
        root = np.sqrt(half**2 - mid**2 + 0j)
        p, z = np.concatenate([half + root, half - root]), np.zeros(order)
    else:
        raise InputError("InvalidFilter", f"unknown filter kind {kind!r}")
    pd_, zd = (4 + p) / (4 - p), (4 + z) / (4 - z)
    zd = np.concatenate([zd, -np.ones(len(pd_) - len(zd))])
    b, a = np.real(np.poly(zd)), np.real(np.poly(pd_))
    if kind == "high":
        at = -1.0
    elif kind == "low":
        at = 1.0
    else:
        at = np.exp(2j * np.arctan(np.sqrt(warp[0] * warp[1]) / 4.0))
    gain = np.abs(np.polyval(a, at) / np.polyval(b, at))
    return b * gain, a


def band_filter(band: list[float], fs: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass; a band reaching Nyquist becomes a high-pass at its low edge."""
    if len(band) != 2 or band[0] >= band[1]:
        raise InputError("InvalidBandpass", "bandpass must be [low, high] with low < high")
    lo, hi = band[0] / (fs / 2), band[1] / (fs / 2)
    if hi >= 1:
        return butterworth(order, lo, "high")
    return butterworth(order, [lo, hi], "bandpass")


class LinearFilter:
    """State-space form of (b, a) for whole blocks."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
        m = max(len(a), len(b)) - 1
        b = np.pad(b / a[0], (0, m + 1 - len(b)))
        a = np.pad(a / a[0], (0, m + 1 - len(a)))
        self.m = m
        self.pad = 3 * m
        self.A = np.zeros((m, m))
        self.A[:, 0] = -a[1:]
        self.A[: m - 1, 1:] += np.eye(m - 1) if m > 1 else 0
        self.B = b[1:] - a[1:] * b[0]
        self.rest = np.linalg.solve(np.eye(m) - self.A, self.B)
        # Response of one sub-block: output to input, output to start state.
        self.free = np.zeros((SUB, m))
        pulse = np.zeros(SUB)
        state, drive = np.eye(m), self.B.copy()
        pulse[0] = b[0]
        reach = np.zeros((m, SUB))
        for i in range(SUB):
            self.free[i] = state[0]
            if i + 1 < SUB:
                pulse[i + 1] = drive[0]
            reach[:, SUB - 1 - i] = drive
            drive = self.A @ drive
            state = self.A @ state
        self.step = state
        self.reach = reach
        self.powers = [np.linalg.matrix_power(self.A, i) for i in range(SUB)]
        lag = np.subtract.outer(np.arange(SUB), np.arange(SUB))
        self.forced = np.where(lag >= 0, pulse[np.clip(lag, 0, SUB - 1)], 0.0)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, end state) of a block from start state z."""
        n = len(x)
        full = n // SUB
        y = np.empty(n)
        if full:
            parts = x[: full * SUB].reshape(full, SUB)
            y_forced = parts @ self.forced.T
            pushes = parts @ self.reach.T
            starts = np.empty((full, self.m))
            for i in range(full):
                starts[i] = z
                z = self.step @ z + pushes[i]
            y[: full * SUB] = (y_forced + starts @ self.free.T).ravel()
        tail = n - full * SUB
        if tail:
            xt = x[full * SUB :]
            y[full * SUB :] = self.forced[:tail, :tail] @ xt + self.free[:tail] @ z
            z = self.powers[tail] @ z + self.reach[:, SUB - tail :] @ xt
        return y, z

    def advance(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.A, n)


# ---- zero-phase filtering ----------------------------------------------------


def _extended(signal: DataFrame, meta: DataFrame, pad: int) -> DataFrame:
    """Samples with odd reflections of ``pad`` at both ends, index shifted to 0."""
    s = signal.join(meta.select("session_id", "n_samples"), "session_id")
    i, n = F.col("sample_idx"), F.col("n_samples")
    ends = s.filter((i <= pad) | (i >= n - 1 - pad))
    anchors = ends.groupBy(*CHANNEL).agg(
        F.max(F.when(i == 0, F.col("v"))).alias("_first"), F.max(F.when(i == n - 1, F.col("v"))).alias("_last")
    )
    left = ends.filter((i >= 1) & (i <= pad)).join(anchors, CHANNEL).select(
        *CHANNEL, (-i).alias("sample_idx"), (2 * F.col("_first") - F.col("v")).alias("v")
    )
    right = ends.filter((i <= n - 2) & (i >= n - 1 - pad)).join(anchors, CHANNEL).select(
        *CHANNEL, (2 * (n - 1) - i).alias("sample_idx"), (2 * F.col("_last") - F.col("v")).alias("v")
    )
    both = signal.select(*CHANNEL, "sample_idx", "v").unionByName(left).unionByName(right)
    return both.withColumn("sample_idx", F.col("sample_idx") + pad)


def to_blocks(samples: DataFrame, block: int = BLOCK_SAMPLES) -> DataFrame:
    """(channel, blk, v array): consecutive samples in blocks."""
    return (
        samples.groupBy(*CHANNEL, F.floor(F.col("sample_idx") / block).alias("blk"))
        .agg(F.array_sort(F.collect_list(F.struct("sample_idx", "v"))).alias("_a"))
        .select(*CHANNEL, "blk", F.col("_a.v").alias("v"))
    )


def _start_states(ends: DataFrame, filt: LinearFilter, backward: bool) -> DataFrame:
    """(channel, blk, z): start state of each block from per-block end states.

    A run of blocks acts on a state like one long block (a power of the fixed
    matrix, and an end state from rest), so runs of ``FAN`` are composed level
    by level up to one run per channel, and states handed down again: no group
    holds more than ``FAN`` short rows. The edge sample sets the resting state.
    ``ends`` is read once per level and should be materialised.
    """
    head = "session_id bigint, channel_id string, "

    powers: dict[int, np.ndarray] = {}

    def after(z: np.ndarray, n: int, push: np.ndarray) -> np.ndarray:
        if n not in powers:
            powers[n] = filt.advance(int(n))
        return powers[n] @ z + np.asarray(push, float)

    def runs(rows: DataFrame) -> DataFrame:
        # Rows of a run in a row: one Python call takes many short channels.
        order = F.col("blk").desc() if backward else F.col("blk").asc()
        return spread(rows, *CHANNEL, "up").sortWithinPartitions(*CHANNEL, "up", order)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["session_id", "channel_id", "blk", "n", "push"])

        key, n, z = None, 0, np.zeros(filt.m)
        for pdf in batches:
            done = []
            for *of, size, push in zip(pdf.session_id, pdf.channel_id, pdf.up, pdf.n, pdf.push):
                if of != key:
                    if key is not None:
                        done.append((*key, n, z))
                    key, n, z = of, 0, np.zeros(filt.m)
                n, z = n + size, after(z, size, push)
            yield frame(done)
        if key is not None:
            yield frame([(*key, n, z)])

    def hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, z = None, np.zeros(filt.m)
        for pdf in batches:
            starts = []
            for *of, size, push, first in zip(pdf.session_id, pdf.channel_id, pdf.up, pdf.n, pdf.push, pdf.z):
                if of != key:
                    key, z = of, np.asarray(first, float)
                starts.append(z)
                z = after(z, size, push)
            yield pd.DataFrame({"session_id": pdf.session_id, "channel_id": pdf.channel_id, "blk": pdf.blk, "z": starts})

    up = F.floor(F.col("blk") / F.lit(FAN))
    named = F.col("session_id").isNotNull() & F.col("channel_id").isNotNull()  # others match no state
    levels = [ends.filter(named).select(*CHANNEL, "blk", F.col("n").cast("bigint").alias("n"), "push")]
    most = int(ends.agg(F.max("blk")).first()[0] or 0)
    while most >= FAN:
        groups = runs(levels[-1].withColumn("up", up)).select(*CHANNEL, "up", "n", "push")
        levels.append(groups.mapInPandas(compose, head + "blk bigint, n bigint, push array<double>"))
        most //= FAN
    edge = F.max_by("edge", "blk") if backward else F.min_by("edge", "blk")
    rest = F.transform(F.array(*[F.lit(float(v)) for v in filt.rest]), lambda v: v * F.col("edge"))
    above = ends.groupBy(*CHANNEL).agg(edge.alias("edge")).select(*CHANNEL, F.lit(0).cast("bigint").alias("up"), rest.alias("z"))
    for level in reversed(levels):
        groups = runs(level.withColumn("up", up).join(above, [*CHANNEL, "up"]))
        starts = groups.mapInPandas(hand_down, head + "blk bigint, z array<double>")
        above = starts.withColumnRenamed("blk", "up")
    return starts


def filtfilt(
    signal: DataFrame, meta: DataFrame, b: np.ndarray, a: np.ndarray, block: int = BLOCK_SAMPLES
) -> DataFrame:
    """Zero-phase filter of every channel: (channel, sample_idx, v)."""
    filt = LinearFilter(b, a)
    short = meta.filter(F.col("n_samples") <= filt.pad)
    if not short.isEmpty():
        raise InputError("SignalTooShort", f"filtering needs more than {filt.pad} samples")
    blocks = to_blocks(_extended(signal, meta, filt.pad), block)
    rest = np.zeros(filt.m)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = [np.asarray(v, float) for v in pdf.v]
            yield pd.DataFrame(
                {"session_id": pdf.session_id, "channel_id": pdf.channel_id, "blk": pdf.blk,
                 "n": [len(x) for x in xs], "edge": [x[0] for x in xs], "push": [filt.run(x, rest)[1] for x in xs]}
            )

    head = "session_id bigint, channel_id string, blk bigint, "
    z1 = _start_states(materialize(blocks.mapInPandas(ends, head + "n int, edge double, push array<double>")), filt, False)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys = [filt.run(np.asarray(v, float), np.asarray(z, float))[0] for v, z in zip(pdf.v, pdf.z)]
            yield pd.DataFrame(
                {"session_id": pdf.session_id, "channel_id": pdf.channel_id, "blk": pdf.blk, "v": ys,
                 "n": [len(y) for y in ys], "edge": [y[-1] for y in ys], "push": [filt.run(y[::-1], rest)[1] for y in ys]}
            )

    once = materialize(
        blocks.join(z1, [*CHANNEL, "blk"]).mapInPandas(
            forward, head + "v array<double>, n int, edge double, push array<double>"
        )
    )
    z2 = _start_states(once.drop("v"), filt, True)

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys = [filt.run(np.asarray(v, float)[::-1], np.asarray(z, float))[0][::-1] for v, z in zip(pdf.v, pdf.z)]
            yield pd.DataFrame({"session_id": pdf.session_id, "channel_id": pdf.channel_id, "blk": pdf.blk, "v": ys})

    done = once.select(*CHANNEL, "blk", "v").join(z2, [*CHANNEL, "blk"]).mapInPandas(backward, head + "v array<double>")
    idx = (F.col("blk") * block + F.col("_p") - filt.pad).alias("sample_idx")
    flat = done.select(*CHANNEL, "blk", F.posexplode("v").alias("_p", "v")).select(*CHANNEL, idx, "v")
    return (
        flat.join(meta.select("session_id", "n_samples"), "session_id")
        .filter((F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("n_samples")))
        .drop("n_samples")
    )


def box_filtfilt(signal: DataFrame, meta: DataFrame, width: int, block: int = BLOCK_SAMPLES) -> DataFrame:
    """``filtfilt`` with a box of ``width`` samples, in time that doesn't depend on the width.

    A box looks width - 1 samples back, then as many ahead; that is less than
    the reflected ends, so resting states never reach a sample that is kept.
    Each block takes its samples and those in reach, and both passes are
    differences of its prefix sums: one shuffle, no state between blocks.
    """
    reach = width - 1
    if not meta.filter(F.col("n_samples") <= 3 * reach).isEmpty():
        raise InputError("SignalTooShort", f"filtering needs more than {3 * reach} samples")
    size = max(block, 2 * reach)
    j = F.col("sample_idx")
    # Reflected samples make index j the first of the 2 * reach + 1 that output j averages.
    wide = _extended(signal, meta, reach).withColumn(
        "blk", F.explode(F.sequence(F.floor(F.greatest(j - 2 * reach, F.lit(0)) / size), F.floor(j / size)))
    )
    packed = wide.groupBy(*CHANNEL, "blk").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "v"))).alias("_a"))

    def moving_sum(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[width:] - c[:-width]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # The rest of a last block has no output of its own.
            pdf = pdf[[len(v) > 2 * reach for v in pdf.v]]
            ys = [moving_sum(moving_sum(np.asarray(v, float))) / width**2 for v in pdf.v]
            yield pd.DataFrame({"session_id": pdf.session_id, "channel_id": pdf.channel_id, "blk": pdf.blk, "v": ys})

    done = packed.select(*CHANNEL, "blk", F.col("_a.v").alias("v")).mapInPandas(
        smooth, "session_id bigint, channel_id string, blk bigint, v array<double>"
    )
    return done.select(*CHANNEL, "blk", F.posexplode("v").alias("_p", "v")).select(
        *CHANNEL, (F.col("blk") * size + F.col("_p")).alias("sample_idx"), "v"
    )


# ---- Hilbert envelope --------------------------------------------------------


def fft_shape(n: int) -> tuple[int, int, int]:
    """(rows, columns, tile) of the two-stage FFT for a circular length-n kernel."""
    lg = max(int(np.ceil(np.log2(max(2 * n - 1, 2)))), 2)
    r = 1 << (lg // 2)
    c = 1 << (lg - lg // 2)
    return r, c, min(TILE, r)


def hilbert_kernel(j: np.ndarray, n: int) -> np.ndarray:
    """Circular Hilbert kernel of length n at integer offsets j (mod n)."""
    j = np.mod(j, n).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if n % 2 == 0:
            h = np.where(j % 2 == 1, 2.0 / n / np.tan(np.pi * j / n), 0.0)
        else:
            h = (1 / np.tan(np.pi * j / n) - np.cos(np.pi * j) / np.sin(np.pi * j / n)) / n
    return np.where(j == 0, 0.0, h)


def _columns_forward(cols: np.ndarray, tile2: int, r: int, c: int, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """FFT down the columns of one tile, twiddled, cut into row tiles."""
    spec = np.fft.fft(cols, axis=0)
    n2 = tile2 * t + np.arange(cols.shape[1])
    spec = spec * np.exp(-2j * np.pi * np.outer(np.arange(r), n2) / (r * c))
    for t1 in range(r // t):
        yield t1, spec[t1 * t : (t1 + 1) * t]


def _rows_of(parts, t: int, c: int) -> np.ndarray:
    m = np.zeros((t, c), dtype=complex)
    for tile2, re, im in parts:
        w = len(re) // t
        m[:, tile2 * t : tile2 * t + w] = (np.asarray(re) + 1j * np.asarray(im)).reshape(t, w)
    return m


def _tile_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows)


def hilbert(signal: DataFrame, meta: DataFrame) -> DataFrame:
    """Imaginary part of the analytic signal: (channel, sample_idx, v)."""
    lg = F.greatest(F.ceil(F.log2((2 * F.col("n_samples") - 1).cast("double"))), F.lit(2)).cast("int")
    pow2 = lambda e: F.pow(F.lit(2.0), e).cast("int")
    half = F.floor(lg / 2).cast("int")
    dims = meta.select(
        "session_id", "n_samples", pow2(half).alias("r"), pow2(lg - half).alias("c"),
        F.least(F.lit(TILE), pow2(half)).alias("t"),
    )
    keys = "session_id bigint, channel_id string, n_samples bigint, r int, c int, t int, "
    tile = "t1 int, t2 int, re array<double>, im array<double>"

    def emit(out: list, base: dict, tile2: int, cols: np.ndarray, r: int, c: int, t: int) -> None:
        for t1, part in _columns_forward(cols, tile2, r, c, t):
            out.append({**base, "t1": t1, "t2": tile2, "re": part.real.ravel(), "im": part.imag.ravel()})

    # Stage 1, kernel: one per signal length, generated in place.
    lengths = dims.select("n_samples", "r", "c", "t").distinct()
    ktiles = lengths.withColumn("t2", F.explode(F.sequence(F.lit(0), (F.col("c") / F.col("t")).cast("int") - 1)))

    def kernel_cols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.itertuples(index=False):
                n, r, c, t = int(row.n_samples), int(row.r), int(row.c), int(row.t)
                idx = np.arange(r)[:, None] * c + (row.t2 * t + np.arange(t))[None, :]
                m = r * c
                signed = np.where(idx < n, idx, idx - m)
                k = np.where((signed < n) & (signed > -n), hilbert_kernel(signed, n), 0.0)
                emit(out, {"n_samples": n, "r": r, "c": c, "t": t}, int(row.t2), k, r, c, t)
            yield _tile_frame(out)

    kspec = ktiles.repartition("n_samples", "t2").mapInPandas(
        kernel_cols, "n_samples bigint, r int, c int, t int, " + tile
    )
    packed = F.array_sort(F.collect_list(F.struct("t2", "re", "im"))).alias("_p")
    krows = kspec.groupBy("n_samples", "r", "c", "t", "t1").agg(packed)

    def kernel_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = np.fft.fft(_rows_of(zip(row.p_t2, row.p_re, row.p_im), row.t, row.c), axis=1)
                out.append({"n_samples": row.n_samples, "t1": row.t1, "k_re": m.real.ravel(), "k_im": m.imag.ravel()})
            yield _tile_frame(out)

    split = [F.col("_p.t2").alias("p_t2"), F.col("_p.re").alias("p_re"), F.col("_p.im").alias("p_im")]
    kfft = krows.select("n_samples", "r", "c", "t", "t1", *split).mapInPandas(
        kernel_rows, "n_samples bigint, t1 int, k_re array<double>, k_im array<double>"
    )

    # Stage 1, signal.
    s = signal.join(dims, "session_id")
    cols = (
        s.groupBy(*CHANNEL, "n_samples", "r", "c", "t", F.floor(F.col("sample_idx") % F.col("c") / F.col("t")).cast("int").alias("t2"))
        .agg(F.collect_list(F.struct("sample_idx", "v")).alias("_a"))
        .select(*CHANNEL, "n_samples", "r", "c", "t", "t2", F.col("_a.sample_idx").alias("i"), F.col("_a.v").alias("v"))
    )

    def signal_cols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.itertuples(index=False):
                r, c, t = int(row.r), int(row.c), int(row.t)
                i = np.asarray(row.i, dtype=np.int64)
                m = np.zeros((r, t))
                m[i // c, i % c - row.t2 * t] = np.asarray(row.v, float)
                base = {"session_id": row.session_id, "channel_id": row.channel_id, "n_samples": row.n_samples, "r": r, "c": c, "t": t}
                emit(out, base, int(row.t2), m, r, c, t)
            yield _tile_frame(out)

    sspec = cols.mapInPandas(signal_cols, keys + tile)

    # Stage 2: row FFT, product with the kernel, inverse row FFT.
    rows = sspec.groupBy(*CHANNEL, "n_samples", "r", "c", "t", "t1").agg(packed)
    rows = rows.select(*CHANNEL, "n_samples", "r", "c", "t", "t1", *split).join(kfft, ["n_samples", "t1"])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r, c, t = int(row.r), int(row.c), int(row.t)
                m = np.fft.fft(_rows_of(zip(row.p_t2, row.p_re, row.p_im), t, c), axis=1)
                k = (np.asarray(row.k_re) + 1j * np.asarray(row.k_im)).reshape(t, c)
                back = np.fft.ifft(m * k, axis=1)
                k1 = row.t1 * t + np.arange(t)
                back = back * np.exp(2j * np.pi * np.outer(k1, np.arange(c)) / (r * c))
                base = {"session_id": row.session_id, "channel_id": row.channel_id, "n_samples": row.n_samples, "r": r, "c": c, "t": t}
                for t2 in range(c // t):
                    part = back[:, t2 * t : (t2 + 1) * t]
                    out.append({**base, "t1": row.t1, "t2": t2, "re": part.real.ravel(), "im": part.imag.ravel()})
            yield _tile_frame(out)

    mixed = rows.mapInPandas(product, keys + tile)
    packed1 = F.array_sort(F.collect_list(F.struct("t1", "re", "im"))).alias("_p")
    final = mixed.groupBy(*CHANNEL, "n_samples", "r", "c", "t", "t2").agg(packed1).select(
        *CHANNEL, "n_samples", "r", "c", "t", "t2",
        F.col("_p.t1").alias("p_t1"), F.col("_p.re").alias("p_re"), F.col("_p.im").alias("p_im"),
    )

    def columns_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r, c, t = int(row.r), int(row.c), int(row.t)
                m = np.zeros((r, t), dtype=complex)
                for t1, re, im in zip(row.p_t1, row.p_re, row.p_im):
                    m[t1 * t : (t1 + 1) * t] = (np.asarray(re) + 1j * np.asarray(im)).reshape(t, t)
                y = np.fft.ifft(m, axis=0).real
                idx = np.arange(r)[:, None] * c + (row.t2 * t + np.arange(t))[None, :]
                ok = idx < row.n_samples
                yield pd.DataFrame(
                    {"session_id": row.session_id, "channel_id": row.channel_id, "sample_idx": idx[ok], "v": y[ok]}
                )

    return final.mapInPandas(columns_back, "session_id bigint, channel_id string, sample_idx bigint, v double")


def envelope(signal: DataFrame, meta: DataFrame) -> DataFrame:
    """Magnitude of the analytic signal."""
    im = hilbert(signal, meta).withColumnRenamed("v", "_h")
    return signal.join(im, [*CHANNEL, "sample_idx"]).select(
        *CHANNEL, "sample_idx", F.hypot("v", "_h").alias("v")
    )


# ---- the whole chain ---------------------------------------------------------


def band_power(signal: DataFrame, meta: DataFrame, fs: float, cfg: dict) -> DataFrame:
    """Band-pass, envelope and smoothing as the config asks."""
    lfp = cfg.get("lfp", {})
    band = lfp.get("bandpass_hz")
    if band:
        signal = materialize(filtfilt(signal, meta, *band_filter(band, fs)))
    if lfp.get("extract_band_power"):
        signal = envelope(signal, meta)
        width = int(np.floor((lfp.get("power_smoothing_ms") or 0) * fs / 1000 + 0.5))
        if width > 1:
            signal = box_filtfilt(materialize(signal), meta, width)
    return signal


def bin_signal(signal: DataFrame, meta: DataFrame, sizes: DataFrame, dt: float, fs: float, cfg: dict) -> DataFrame:
    """Binned, normalised channels (session, channel, bin, v), zeros left out first.

    Chain: band power, linear resampling on the grid, normalisation. Rows are
    dense because normalising moves zero bins too.
    """
    from echogrid.operators.grid import grid
    from echogrid.operators.smooth import normalize, resample_linear

    power = band_power(signal, meta, fs, cfg)
    binned = resample_linear(power, meta, sizes, dt, CHANNEL)
    channels = signal.select(*CHANNEL).distinct()
    dense = (
        grid(sizes, dt, per=channels).drop("t")
        .join(binned, [*CHANNEL, "bin"], "left")
        .select(*CHANNEL, "bin", F.coalesce("v", F.lit(0.0)).alias("v"))
    )
    mode = cfg.get("lfp", {}).get("normalize") or "zscore"
    return normalize(dense, sizes.withColumnRenamed("n_bins", "n_rows"), CHANNEL, mode)


def remove_drift(binned: DataFrame, sizes: DataFrame, dt: float, cut_hz: float = 0.1, order: int = 3) -> DataFrame:
    """Zero-phase high-pass of dense binned channels."""
    b, a = butterworth(order, cut_hz / (0.5 / dt), "high")
    meta = sizes.withColumnRenamed("n_bins", "n_samples")
    out = filtfilt(binned.withColumnRenamed("bin", "sample_idx"), meta, b, a)
    return out.withColumnRenamed("sample_idx", "bin")
