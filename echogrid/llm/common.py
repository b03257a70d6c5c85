"""Shared helpers: table access, word pattern, stored tables, connected components, maximal segments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.runtime import materialize

# White space and words as every contract of this package defines them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one by one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
# Unrelated odd factors, one for each place of a shingle.
_PLACE = np.random.default_rng(2).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


@cache
def _powers(bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(1 << bits, 0x9E3779B97F4A7C15, np.uint64))


# Bytes up to which a text's letters are weighted by their place in the text, and powers that take its words' starts back.
SHORT = 1 << 16
_LETTER_OR_NONE = np.where(_IS_WORD, _LETTER, np.uint64(0))
_BACK = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(SHORT - 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z: random numbers of its bytes, weighted by place, summed and scrambled."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    marked = np.zeros(len(data) + 2, bool)
    inside = marked[1:-1]
    inside[:] = _IS_WORD[data]
    edges = np.flatnonzero(marked[1:] != marked[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts = edges[::2]
    sizes = edges[1::2] - starts
    if len(data) <= SHORT:
        # The weight at a place of the text is that of the word's start times that within the word.
        sums = np.add.reduceat(_LETTER_OR_NONE[data] * _powers(SHORT.bit_length() - 1)[: len(data)], starts) * _BACK[starts]
        return mixed(sums + sizes.astype(np.uint64))
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    weights = _powers(int(sizes.max()).bit_length())
    sums = np.add.reduceat(_LETTER[data[inside]] * weights[place], first)
    return mixed(sums + sizes.astype(np.uint64))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hash of the shingle that starts at each word, in order; fewer words than a shingle make one of their own.

    A shingle has at most 64 words.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(len(h), words)
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += h[k : n + k] * _PLACE[k]
    return mixed(total)


def portions(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Cut a list of texts into lists of about ``chars`` letters; a longer text is one of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the session's shared folder and read it back.

    For wide intermediate results, which a checkpoint would keep uncompressed,
    and for rounds of a loop: a stored table has its real size for the planner.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        materialize(spark.range(0))  # sets the folder where nothing is configured (local runs only)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest node of each connected part to all others of it."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        of_x, of_y = label[x], label[y]
        if (of_x == of_y).all():
            # A node with an edge to itself only keeps that.
            other = np.flatnonzero((label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes))[label] == 1))
            return nodes[label[other]], nodes[other]
        np.minimum.at(label, np.maximum(of_x, of_y), np.minimum(of_x, of_y))
        while (label[label] != label).any():
            label = label[label]


# Edges that are thinned at once.
THIN = 1 << 19


def thinned(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect the same nodes; each run of ``THIN`` edges keeps fewer than it has nodes."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= THIN:
                a, b = _connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)
                held, size = [], 0
        if size:
            a, b = _connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of undirected ``edges(a, b)``: the smallest node that can be reached.

    What a task reads is thinned first, so a group with many links among its
    nodes doesn't send them all along in each round.

    Smallest labels travel along edges and then jump to their own label, so
    rounds grow with the logarithm of a path. Each round is stored: a checkpoint
    would hand on the planner's guess of its size, which joins multiply, so its
    digits double with every round until they fill the driver.
    """
    kept = stored(thinned(edges), "thinned")
    both = stored(kept.union(kept.select("b", "a")).distinct(), "edges")
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        ).withColumnRenamed("a", "node")
        lower = labels.join(heard, "node").select("node", F.least("comp", "least").alias("mid"), "comp")
        lower = stored(lower, "lower")
        up = lower.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        jumped = stored(lower.join(up, "mid").select("node", F.col("top").alias("comp"), F.col("comp").alias("was")), "jumped")
        labels = jumped.select("node", "comp")
        if jumped.filter("comp <> was").isEmpty():
            return labels


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in one pass over the scores.

    A candidate keeps the sums before and up to its end. A new one is joined
    with the last candidate that starts lower and ends lower than it.
    """
    kept: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low, high = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, i + 1, low, high))
    return [(s, e, high - low) for s, e, low, high in kept]
