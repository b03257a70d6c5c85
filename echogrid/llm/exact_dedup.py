"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks. Distinct blocks are sorted (in hash shards)
and numbered; then adjacent numbers are paired, distinct pairs sorted and
numbered, until one number is left. Two texts of equal length get the same number exactly when they
are equal, so no decision rests on a hash.

Rows that share neither (length, 64-bit hash) with another row cannot have an
equal; they skip the naming. Hash matches only select what is named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import SPACES, text_or_empty
from echogrid.runtime import materialize

BLOCK_BYTES = 4096


def normalised(column: str = "text"):
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of distinct keys: hash shard, then rank in the sorted shard. The checkpoint fixes them.

    A global sort would sample whole blocks to the driver.
    """
    return materialize(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Name every text of ``texts(doc_id, sha, norm)``: one row per (doc_id, sha) with ``n_bytes, name``.

    Names are comparable between texts of equal ``n_bytes`` only. Repeated rows
    give one row. An empty text is one empty block.
    """
    data = texts.select("doc_id", "sha", F.encode("norm", "UTF-8").alias("data")).withColumn(
        "n_bytes", F.octet_length("data").cast("long")
    )
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int")
    cut = data.withColumn("n", n_blocks).select(
        "doc_id",
        "sha",
        "n_bytes",
        "n",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 1),
                lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)),
            )
        ).alias("idx", "block"),
    )
    names = _numbered(cut.select("block").distinct(), ["block"])
    level = materialize(cut.join(names, "block").select("doc_id", "sha", "n_bytes", "n", "idx", "name"))
    done = []
    while True:
        done.append(level.filter("n = 1").select("doc_id", "sha", "n_bytes", "name").distinct())
        open_rows = level.filter("n > 1")
        if open_rows.isEmpty():
            break
        pairs = open_rows.groupBy(
            "doc_id", "sha", "n_bytes", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("idx") / 2).cast("int").alias("idx")
        ).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        level = materialize(
            pairs.join(names, ["left", "right"]).select("doc_id", "sha", "n_bytes", "n", "idx", "name")
        )
    return reduce(DataFrame.union, done)


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, so all empty and null rows are one group. The
    smallest doc_id of a group stays; of repeated rows of that doc_id just one.
    A null doc_id never wins against another. Other columns are ignored. An
    empty table gives an empty result.
    """
    norm = docs.select("doc_id", normalised().alias("norm"))
    keys = materialize(
        norm.select(
            "doc_id",
            F.octet_length("norm").cast("long").alias("n_bytes"),
            F.xxhash64("norm").alias("h"),
            F.sha2("norm", 256).alias("sha"),
        )
        .groupBy("doc_id", "n_bytes", "h", "sha")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    shared = materialize(keys.groupBy("n_bytes", "h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    suspects = keys.join(shared, ["n_bytes", "h"], "left_semi").select("doc_id", F.col("sha"))
    texts = (
        norm.alias("t")
        .join(suspects.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")))
        .filter(F.sha2("t.norm", 256) == F.col("s.sha"))
        .select("t.doc_id", "s.sha", "t.norm")
    )
    named = materialize(block_names(materialize(texts), block_bytes))
    sized = named.alias("m").join(
        keys.alias("k"), F.col("m.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("m.sha") == F.col("k.sha"))
    )
    groups = materialize(
        sized.groupBy("m.n_bytes", "m.name").agg(
            F.min("m.doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
        )
    )
    settled = named.join(groups, ["n_bytes", "name"]).select("doc_id", "sha", "keep_id", "group_size")
    every = (
        keys.alias("k")
        .join(
            settled.alias("g"),
            F.col("k.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("k.sha") == F.col("g.sha")),
            "left",
        )
        .select(
            "k.doc_id",
            F.when(F.col("g.sha").isNull(), F.col("k.doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
            F.coalesce("g.group_size", "k.copies").cast("long").alias("group_size"),
            F.col("k.sha").alias("text_sha256"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("k.copies"))).alias("copy"),
        )
    )
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    kept = exact_dedup(docs.select("doc_id", "text")).filter("kept").select("doc_id", "text_sha256")
    rows = docs.withColumn("__sha", F.sha2(normalised(), 256)).alias("d")
    joined = rows.join(
        kept.alias("k"),
        F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__sha") == F.col("k.text_sha256")),
        "left_semi",
    )
    return joined.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
