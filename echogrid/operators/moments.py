"""Sufficient statistics of design blocks, per model and fold.

Tasks add up small dense matrices for the blocks they hold and emit one packed
vector per (model, fold); Spark adds the vectors up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.operators.basis import ColumnMap
from echogrid.operators.features import block_matrix, fold_of

FLUSH_KEYS = 64
SUM_LANES = 64


def packed_size(p: int) -> int:
    return p * (p + 1) // 2


def pack_sym(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(m.shape[0])]


def unpack_sym(v: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = v
    return m + np.triu(m, 1).T


class VectorSums:
    """Sums per key inside a task, flushed when many keys are open."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.sums: dict[tuple, np.ndarray] = {}

    def add(self, key: tuple, vec: np.ndarray) -> None:
        have = self.sums.get(key)
        self.sums[key] = vec if have is None else have + vec

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame(list(self.sums), columns=self.keys)
        out["vec"] = list(self.sums.values())
        self.sums = {}
        return out


def _fold_sum(vectors: Column) -> Column:
    """Element-wise sum of an array of equally long vectors."""
    rest = F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0)))
    return F.aggregate(rest, vectors[0], lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))


def sum_vectors(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of ``vec`` per key: (keys, vec).

    A task emits a key once or twice (design blocks are sorted by model), so a
    key has about as many vectors as there are tasks. They are added in two
    steps, first by task number, so no step gathers them all.
    """
    some = (
        partials.withColumn("_lane", F.spark_partition_id() % F.lit(SUM_LANES))
        .groupBy(*keys, "_lane")
        .agg(F.collect_list("vec").alias("_v"))
        .select(*keys, _fold_sum(F.col("_v")).alias("vec"))
    )
    return some.groupBy(*keys).agg(F.collect_list("vec").alias("_v")).select(
        *keys, _fold_sum(F.col("_v")).alias("vec")
    )


# Layout of a moment vector: n, sum y, sum y*y, sum x (p), X'y (p), X'X upper.


def moment_length(p: int) -> int:
    return 3 + 2 * p + packed_size(p)


def split_moments(vec: np.ndarray, p: int) -> tuple[float, float, float, np.ndarray, np.ndarray, np.ndarray]:
    v = np.asarray(vec, dtype=float)
    return v[0], v[1], v[2], v[3 : 3 + p], v[3 + p : 3 + 2 * p], unpack_sym(v[3 + 2 * p :], p)


def fold_moments(blocks: DataFrame, colmap: ColumnMap) -> DataFrame:
    """(session_id, model_id, fold, vec) over all design blocks."""
    keys = ["session_id", "model_id", "fold"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = VectorSums(keys)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y, rows = block_matrix(row, colmap)
                folds = fold_of(rows, row.n_rows, row.k)
                for f in np.unique(folds):
                    m = folds == f
                    xf, yf = x[m], y[m]
                    vec = np.concatenate(
                        [[m.sum(), yf.sum(), yf @ yf], xf.sum(axis=0), xf.T @ yf, pack_sym(xf.T @ xf)]
                    )
                    acc.add((row.session_id, row.model_id, int(f)), vec)
                if len(acc.sums) >= FLUSH_KEYS:
                    yield acc.flush()
        if acc.sums:
            yield acc.flush()

    schema = "session_id bigint, model_id string, fold int, vec array<double>"
    return sum_vectors(blocks.mapInPandas(run, schema), keys)


def gram_entries(coo: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, g), i <= j: X'X from the long form, row by row.

    The cells of one design row (at most one per column) are gathered first,
    so pairs are formed within a row of bounded width.
    """
    rows = coo.groupBy(*keys, "bin").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("r"))
    return (
        rows.select(*keys, "r", F.posexplode("r").alias("a", "x"))
        .select(*keys, "x", F.explode(F.expr("slice(r, a + 1, size(r))")).alias("z"))
        .groupBy(*keys, F.col("x.col").alias("i"), F.col("z.col").alias("j"))
        .agg(F.sum(F.col("x.val") * F.col("z.val")).alias("g"))
    )


def cross_entries(coo: DataFrame, response: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, xty): X'y from the long form."""
    return (
        coo.join(response.select(*keys, "bin", "y"), [*keys, "bin"])
        .groupBy(*keys, "col")
        .agg(F.sum(F.col("val") * F.col("y")).alias("xty"))
    )


def standardized_gram(gram: DataFrame, stats: DataFrame, n_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, g), i <= j: Gram of (x - mean) / std without forming it.

    ``stats`` has (keys, col, mean, std). Pairs with no common bin still get
    their share of the means; there are at most p x p pairs per key.
    """
    a = stats.select(*keys, F.col("col").alias("i"), F.col("mean").alias("_mi"), F.col("std").alias("_si"))
    b = stats.select(*keys, F.col("col").alias("j"), F.col("mean").alias("_mj"), F.col("std").alias("_sj"))
    pairs = a.join(b, keys).filter("i <= j").join(n_rows, keys)
    g = F.coalesce("g", F.lit(0.0)) - F.col("n_rows") * F.col("_mi") * F.col("_mj")
    return pairs.join(gram, [*keys, "i", "j"], "left").select(
        *keys, "i", "j", (g / (F.col("_si") * F.col("_sj"))).alias("g")
    )
