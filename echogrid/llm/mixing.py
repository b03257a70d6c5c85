"""Mixing sources to target weights, in DataFrame operations only.

Every source is a stream of words, packed into blocks of fixed length. Output
shards draw how many slots each source fills: the whole part of its share is
fixed, the rest is drawn multinomially. The slots of a source run through a
pseudorandom permutation of its block numbers, once round before any block
comes again, and blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import SPACES, WORD, shuffle_partitions, text_or_empty
from echogrid.runtime import materialize

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
ROUNDS = 12
# Rows are laid out in buckets of about this many rows.
BUCKET_ROWS = 1024


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: weights by code point order, null last.

    A source takes ``min(weight * level, most * size)``; the level at which the
    targets sum up to the whole is found by running sums in the order in which
    sources reach their limit. One row per source is all that meets here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("w", w)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
    )
    by_limit = Window.orderBy((F.col("limit") / F.col("w")).asc(), "rank")
    so_far = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = (
        ranked.withColumn("whole", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("whole") - F.coalesce(F.sum("limit").over(so_far), F.lit(0.0))) / F.sum("w").over(rest))
        # The first source in this order that doesn't reach its limit sets the level of all.
        .withColumn("open", F.col("w") * F.col("level") < F.col("limit"))
        .withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("limit") / F.col("w"))).over(every))
    )
    return levels.select(
        "source",
        "source_size",
        "rank",
        F.coalesce(F.least("limit", F.col("w") * F.col("level")), "limit").alias("target"),
    )


def permuted(index: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a pseudorandom permutation of 0 .. n-1 for any n."""

    def step(x: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(k, seed), n) - x, n)
        swap = F.pmod(F.xxhash64(F.greatest(x, other), k, seed), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their place ``start`` in their source's stream of words, and the targets.

    Rows are ordered by (bucket, doc_id, text hash). Buckets follow the number
    of all rows, so no window or join key holds a whole source.
    """
    sized = materialize(
        docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(text_or_empty()).alias("mark"))
    )
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = materialize(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = materialize(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .alias("o")
        .join(targets.alias("t"), _same_source("o", "t"))
        .select("o.source", "o.bucket", "o.offset", "t.source_size", "t.target")
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("doc_id", "mark")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        bucketed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .alias("d")
        .join(offsets.alias("o"), _same_source("d", "o") & (F.col("d.bucket") == F.col("o.bucket")))
        .select(
            "d.doc_id",
            "d.source",
            "d.mark",
            "d.size",
            "o.source_size",
            "o.target",
            (F.col("o.offset") + F.col("d.inner")).alias("start"),
        )
    )
    return materialize(placed), targets


def slot_counts(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """How many slots each source fills in each output shard: ``source, shard, n``.

    The number of shards follows the total. Each shard gives a source the whole
    part of its share; the slots left over are drawn one by one, each a uniform
    number looked up in the running sum of the shares.
    """
    every = Window.partitionBy()
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        targets.withColumn("whole", F.sum("target").over(every))
        .filter("target > 0")
        .withColumn("slots", F.greatest(F.lit(1), F.round(F.col("whole") / block)).cast("long"))
        .withColumn("shards", F.ceil(F.col("slots") / shard_slots))
        .withColumn("expected", F.col("slots") * F.col("target") / F.col("whole") / F.col("shards"))
        .withColumn("fixed", F.floor("expected"))
        .withColumn("part", F.col("expected") - F.col("fixed"))
        .withColumn("upto", F.sum("part").over(running))
        .withColumn("parts", F.sum("part").over(every))
        .withColumn("low", F.col("upto") - F.col("part"))
    )
    shares = materialize(shares.select("source", "rank", "shards", "fixed", "upto", "parts"))
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    # One row per source and shard, and one per slot left over (fewer than sources).
    grid = shares.select("source", "rank", "fixed", shards)
    whole = shares.agg(
        F.max("shards").alias("shards"),
        F.max("parts").alias("parts"),
        F.sort_array(F.collect_list(F.struct("upto", "rank"))).alias("cuts"),
    ).filter("round(parts) >= 1")
    draws = whole.select("parts", "cuts", shards).select(
        "cuts", "shard", "parts", F.explode(F.sequence(F.lit(1), F.round("parts").cast("int"))).alias("draw")
    )
    u = F.pmod(F.xxhash64("shard", "draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * F.col("parts")
    hit = F.filter("cuts", lambda c: c["upto"] > F.col("u"))
    drawn = (
        draws.withColumn("u", u)
        .select("shard", F.coalesce(F.get(hit, 0), F.element_at("cuts", -1))["rank"].alias("rank"))
        .groupBy("rank", "shard")
        .agg(F.count(F.lit(1)).alias("more"))
    )
    return (
        grid.join(drawn, ["rank", "shard"], "left")
        .select("source", "shard", (F.col("fixed") + F.coalesce("more", F.lit(0))).alias("n"))
    )


def block_uses(
    targets: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = 7
) -> DataFrame:
    """How often the mix takes each block: ``source, block, uses``, used blocks only.

    Slots beyond ``most`` rounds over a source are not filled, so no word is
    taken more often than that.
    """
    counts = slot_counts(targets, block, shard_slots, seed)
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")
    # Few rows that stand for many slots: spread them before the slots are made.
    first = first.repartition(shuffle_partitions(targets.sparkSession), "source", "shard")
    blocks = F.ceil(F.col("source_size") / block)
    slots = (
        first.alias("c")
        .join(targets.alias("t"), _same_source("c", "t"))
        .select(
            "c.source",
            "t.rank",
            blocks.alias("blocks"),
            F.explode(F.sequence(F.col("c.first"), F.col("c.first") + F.col("c.n") - 1)).alias("slot"),
        )
        .filter(F.col("slot") < F.col("blocks") * most)
    )
    # One seed per source, the same in every round: a round meets each block once.
    taken = slots.select(
        "source", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("rank") + F.lit(seed)).alias("block")
    )
    return taken.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))


def _cells(placed: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    """One row per (row of the input, used block): ``at`` and ``n`` are the words of the row in it."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cells = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("c.start"), F.col("c.block") * block)
    high = F.least(F.col("c.start") + F.col("c.size"), (F.col("c.block") + 1) * block)
    return (
        cells.alias("c")
        .join(uses.alias("u"), _same_source("c", "u") & (F.col("c.block") == F.col("u.block")))
        .select("c.*", "u.uses", (low - F.col("c.start")).alias("at"), (high - low).alias("n"))
    )


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Null text has no words; null is a source of its own, the last in order.
    Repeated rows each count and get a place of their own. A row without words
    takes none. Other columns are ignored; an empty table gives an empty result.
    """
    placed, targets = _placed(docs)
    uses = block_uses(targets, block)
    taken = (
        _cells(placed, uses, block)
        .groupBy("source", "start")
        .agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    )
    # (source, start) is unique among rows with words.
    return (
        placed.alias("d")
        .join(
            taken.alias("x"),
            _same_source("d", "x") & (F.col("d.start") == F.col("x.start")) & (F.col("d.size") > 0),
            "left",
        )
        .select(
            "d.doc_id",
            "d.size",
            F.col("d.source_size").cast("long").alias("source_size"),
            F.col("d.target").cast("double").alias("target"),
            F.coalesce("x.taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, with the columns of ``docs(doc_id, source, text, n_chars, ...)``.

    A row comes out once for each round in which words of it are taken: whole if
    all are, else the taken words joined by single spaces. Rows without words
    have nothing to take. Repeated input rows come out once.
    """
    placed, targets = _placed(docs)
    cells = _cells(placed, block_uses(targets, block), block).withColumn(
        "round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))
    )
    parts = cells.groupBy("doc_id", "source", "mark", "size", "round").agg(
        F.sum("n").alias("words"), F.sort_array(F.collect_set(F.struct("at", "n"))).alias("parts")
    )
    rows = docs.withColumn("__mark", F.xxhash64(text_or_empty()))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    some = F.array_join(
        F.flatten(F.transform("p.parts", lambda x: F.slice(words, (x["at"] + 1).cast("int"), x["n"].cast("int")))), " "
    )
    text = F.when(F.col("p.words") >= F.col("p.size"), F.col("d.text")).otherwise(some)
    joined = (
        rows.dropDuplicates(["doc_id", "source", "__mark"])
        .alias("d")
        .join(
            parts.alias("p"),
            F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
            & _same_source("d", "p")
            & (F.col("d.__mark") == F.col("p.mark")),
        )
        .withColumn("__text", text)
    )
    own = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return joined.select(*[own.get(c, F.col(f"d.{c}")).alias(c) for c in docs.columns])
