"""Importance resampling towards a target distribution, ranked by regular sampling.

Hashed n-gram counts of the raw and of the target texts give each bucket a gain.
A document's weight is the sum of an array of gains at its features' buckets;
Gumbel noise from its id makes drawing by weight a ranking.

The ranking is a parallel sort by regular sampling: runs are sorted where they
lie, each names keys at regular steps, from these come regular splitters, the
segments between two splitters are exchanged and merged, and the segments'
counts before give exact ranks. Segments that start beyond the last drawn rank
are not exchanged at all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import portions, shuffle_partitions, stored, text_or_empty

BUCKETS = 10_000
ORDER = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
# Rows of a sorted run, and keys that all runs together name to the driver (at least one a run).
RUN_ROWS = 1 << 20
MOST_SAMPLES = 1 << 17
# Letters that a task looks at together.
PORTION = 1 << 21

# A-Z as a-z; what isn't a letter, a digit or outside ASCII parts words.
_WORDS = bytes(
    b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0x20
    for b in range(256)
)
_CRC_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


def _after_zero_byte(crc: np.ndarray) -> np.ndarray:
    """What a checksum contributes to that of a text one byte longer; linear in the checksum's bits."""
    # crc32(b) mixes in the fixed start value; the difference to that of byte 0 doesn't.
    return (crc >> np.uint32(8)) ^ _CRC_BYTE[crc & np.uint32(255)] ^ _CRC_BYTE[0]


def _shift_tables(count: int, doubling: bool) -> np.ndarray:
    """For each step 4 x 256 values: the shift of each byte of a checksum by 0, 1, 2, ... or by 64, 128, 256, ... bytes."""
    out = np.zeros((count, 4, 256), np.uint32)
    at = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    if doubling:
        for _ in range(64):
            at = _after_zero_byte(at)
    for k in range(count):
        out[k] = at
        at = _shift_by(at, out, np.full(at.shape, k)) if doubling else _after_zero_byte(at)
    return out


def _shift_by(crc: np.ndarray, tables: np.ndarray, step: np.ndarray) -> np.ndarray:
    flat = tables.reshape(-1)
    base = step.astype(np.int64) * 1024
    out = flat[base + (crc & np.uint32(255))]
    for k in range(1, 4):
        out = out ^ flat[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


_SHORT = _shift_tables(64, doubling=False)
_LONG = _shift_tables(26, doubling=True)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two texts in a row from the checksums of both and the second's length in bytes."""
    out = _shift_by(first, _SHORT, length & 63)
    rest, k = length >> 6, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _shift_by(out[odd], _LONG, np.full(len(odd), k))
        rest, k = rest >> 1, k + 1
    return out ^ second


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def feature_buckets(texts: list[str], buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and for 1 to ``order`` words the buckets of the runs that start at each word.

    Runs that would leave a text have bucket -1.
    """
    found = [words(t) for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    total = int(sizes.sum())
    crc = np.fromiter((zlib.crc32(w) for ws in found for w in ws), np.uint32, total)
    length = np.fromiter((len(w) for ws in found for w in ws), np.int64, total)
    # Words that follow in the same text, for each word.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total) - 1
    out, run = [], crc
    for k in range(order):
        if k:
            one = np.ones(max(total - k, 0), np.int64)
            spaced = joined_crc(run[: total - k], np.full(len(one), _SPACE), one)
            run = joined_crc(spaced, crc[k:], length[k:])
        bucket = np.full(total, -1, np.int64)
        bucket[: len(run)] = np.where(left[: len(run)] >= k, run.astype(np.int64) % buckets, -1)
        out.append(bucket)
    return sizes, out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all ``texts(text)`` in each bucket. A task adds up its own, so ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in portions(batch.column(0).to_pylist(), PORTION):
                for x in feature_buckets(texts, buckets, order)[1]:
                    total += np.bincount(x[x >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's smoothed shares in the target and in the raw texts."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    more = float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``docs(doc_id, text)``."""
    # One more for runs that leave their text.
    table = np.append(gain, 0)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for texts in portions(batch.column(1).to_pylist(), PORTION):
                sizes, found = feature_buckets(texts, len(gain), order)
                each = np.zeros(int(sizes.sum()) + 1, np.int64)
                for x in found:
                    each[1:] += table[x]
                ends = np.cumsum(sizes)
                upto = np.cumsum(each)
                n_words.append(sizes)
                sums.append(upto[ends] - upto[ends - sizes])
            sizes = np.concatenate(n_words)
            n_features = sum(np.maximum(sizes - k, 0) for k in range(order))
            columns = [batch.column(0), pa.array(sizes), pa.array(n_features), pa.array(np.concatenate(sums))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise, fixed by the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# Sorting key: highest score, then smallest id (null before all), then the row's own number.
_KEY = ("up", "id", "row")


def sorted_runs(rows: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Sort what lies together, in runs of at most ``run_rows``; adds ``run`` (number of its first row), ``idx``, ``n``."""
    names = rows.columns
    schema = rows.selectExpr("*", "0L AS run", "0L AS idx", "0L AS n").schema

    def flush(held: list[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        whole = whole.sort_by([(k, "ascending") for k in _KEY])
        n = len(whole)
        for name, values in (("run", np.full(n, run)), ("idx", np.arange(n)), ("n", np.full(n, n))):
            whole = whole.append_column(name, pa.array(values, pa.int64()))
        yield from whole.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seq, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch.select(names))
            if sum(map(len, held)) >= run_rows:
                yield from flush(held, base + seq)
                held, seq = [], seq + 1
        if any(map(len, held)):
            yield from flush(held, base + seq)

    return rows.mapInArrow(run, schema)


def splitters(runs: DataFrame, segments: int, most: int = MOST_SAMPLES) -> list[tuple]:
    """Up to ``segments - 1`` keys that part all runs into segments of about the same size.

    Each run names ``segments`` keys at regular steps, fewer if all together were more than ``most``.
    """
    n_runs = runs.filter("idx = 0").count()
    if not n_runs or segments < 2:
        return []
    each = max(1, min(segments, most // n_runs))
    step = F.ceil(F.col("n") / each)
    named = sorted(tuple(r) for r in runs.filter(F.col("idx") % step == 0).select(*_KEY).collect())
    return [named[i * len(named) // segments] for i in range(1, segments)] if len(named) >= segments else named[1:]


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """Add ``rank``: 1, 2, 3, ... for the ``drawn`` first of ``rows(up, id, row, ...)`` by that key, null for the others."""
    spark = rows.sparkSession
    columns = rows.columns
    runs = stored(sorted_runs(rows), "psrs-runs")
    cuts = splitters(runs, shuffle_partitions(spark))
    schema = runs.select(*columns, F.lit(0).cast("int").alias("segment")).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in _KEY), strict=True)
            segment = pa.array([bisect_right(cuts, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), segment], names=[*columns, "segment"])

    dealt = stored(runs.select(*columns).mapInArrow(deal, schema), "psrs-dealt")
    # As many rows as there are segments; their sums are the ranks before each.
    sizes = sorted((r.segment, r["count"]) for r in dealt.groupBy("segment").count().collect())
    before, starts = 0, []
    for segment, n in sizes:
        if before < drawn:
            starts.append((segment, before))
        before += n
    last = starts[-1][0] if starts else -1
    prefix = spark.createDataFrame(starts, "segment int, before long")
    w = Window.partitionBy("segment").orderBy(*_KEY)
    place = F.col("before") + F.col("in_segment")
    merged = (
        dealt.filter(F.col("segment") <= last)
        .withColumn("in_segment", F.row_number().over(w))
        .join(prefix, "segment")
        .select(*columns, F.when(place <= drawn, place).alias("rank"))
    )
    beyond = dealt.filter(F.col("segment") > last).select(*columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(beyond)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words, without replacement, by importance for ``target(text)``.

    One row per input row: ``doc_id, n_features, weight, score, rank``. Null
    text counts as empty and has weight 0; it never has words enough to be
    drawn. A null doc_id's noise is that of the empty id, in ties it comes
    first. Repeated rows are drawn each by its own, with ranks of their own. An
    empty target makes all gains follow the raw counts alone. Other columns are
    ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    raw = bucket_counts(texts.select("text"), buckets)
    gain = gains(raw, bucket_counts(target.select(text_or_empty().alias("text")), buckets))
    found = weights(texts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "importance")
    enough = F.col("n_words") >= least_words
    eligible = found.filter(enough).withColumn("up", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    drawn = percent * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    others = found.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked(eligible, drawn).select(*out).unionByName(others.select(*out))
