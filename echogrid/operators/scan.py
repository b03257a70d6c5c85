"""Ordered scans cut into time chunks.

One session may hold a large share of all rows, so no window here is
partitioned by session alone. Rows are hashed by (session, time chunk); a row
that can matter to a bounded span of other chunks is also emitted to those, so
every answer is found inside one chunk and one shuffle is enough. ``reach``
ranges are exact supersets of the span in which a row can be the answer. What
has no bounded span (how far earlier intervals run, the last row before a
chunk) is one summary row per chunk, carried on over the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_S = 120.0
SLACK_S = 1e-6


def chunk_of(t: Column, chunk_s: float) -> Column:
    return F.floor(t / F.lit(float(chunk_s)))


def emit_to_chunks(df: DataFrame, lo: Column, hi: Column, chunk_s: float) -> DataFrame:
    """Row copies for every chunk touched by [lo, hi] (a little slack each side)."""
    first = chunk_of(lo - F.lit(SLACK_S), chunk_s)
    last = chunk_of(F.greatest(lo, hi) + F.lit(SLACK_S), chunk_s)
    return df.withColumn("chunk", F.explode(F.sequence(first, last)))


def carried(chunks: DataFrame, keys: list[str], value: str, latest: bool = False) -> DataFrame:
    """``value`` of each (keys, chunk) row replaced by that of the chunks before: their maximum, or the latest one.

    One row per chunk in use comes in, so the window over a session is as long
    as its chunks, not as its rows. Chunks with nothing before them are left out.
    """
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(value, ignorenulls=True).over(w) if latest else F.max(value).over(w)
    return chunks.withColumn(value, before).filter(F.col(value).isNotNull())


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_key: Column,
    right_key: Column,
    payload: list[str],
    reach: tuple[Column, Column] | None,
    out: str = "match",
    direction: str = "backward",
    strict: bool = False,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Each left row with the nearest right row before (or after) it.

    ``backward`` takes the last right row with right_key <= left_key (< when
    strict), ``forward`` the first with right_key >= left_key (> when strict).
    The caller passes right rows that are unique per (keys, right_key) and the
    range of left keys each of them can answer; without a range (backward only)
    the last right row of the chunks before is carried into each chunk. Adds
    struct column ``out``, null when there is no match.
    """
    backward = direction == "backward"
    if reach is None and not backward:
        raise ValueError("a forward match needs a reach")
    lhs = left.select(
        *keys,
        chunk_of(left_key, chunk_s).alias("chunk"),
        left_key.alias("_k"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
    )
    placed = right.withColumn("chunk", chunk_of(right_key, chunk_s)) if reach is None else emit_to_chunks(right, *reach, chunk_s)
    rhs = placed.select(
        *keys,
        "chunk",
        right_key.alias("_k"),
        F.lit(2 if strict else 0).alias("_side"),
        F.struct(*[F.col(c) for c in payload]).alias("_r"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    if reach is None:
        # The carried row has no key and so comes before all others of its chunk.
        last = F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_k"))).alias("_r")
        before = carried(both.groupBy(*keys, "chunk").agg(last), keys, "_r", latest=True)
        both = both.unionByName(before.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = F.col("_k").asc_nulls_first() if backward else F.col("_k").desc()
    w = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(order, F.col("_side").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn(out, F.last("_r", ignorenulls=True).over(w))
        .filter(F.col("_l").isNotNull())
        .select("_l.*", out)
    )


def merge_islands(
    spans: DataFrame,
    keys: list[str],
    gap: float,
    start: str = "t_on",
    end: str = "t_off",
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Gaps-and-islands against the running end: (keys, start, end) per island.

    A span opens a new island when ``start - running_end > gap``. A span lies in
    the chunk of its start, whatever its length; how far the spans of earlier
    chunks run is one carried row. Islands are built inside chunks; only those
    that open or close a chunk (at most two per chunk) go through a window over
    the whole session.
    """
    spans = spans.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    spans = spans.withColumn("chunk", chunk_of(F.col("_s"), chunk_s))
    before = carried(spans.groupBy(*keys, "chunk").agg(F.max("_e").alias("_e")), keys, "_e")
    # The carried row has no start and so comes first.
    pieces = spans.withColumn("_own", F.lit(True)).unionByName(
        before.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys, "chunk").orderBy("_s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = F.max("_e").over(before)
    opens = F.col("_own") & (prior.isNull() | (F.col("_s") - prior > F.lit(float(gap))))
    local = (
        pieces.withColumn("_new", opens.cast("int"))
        .withColumn("_n", F.sum("_new").over(upto))
        .groupBy(*keys, "chunk", "_n")
        .agg(F.min(F.when(F.col("_own"), F.col("_s"))).alias("_s"), F.max("_e").alias("_e"))
        .withColumn("_last", F.col("_n") == F.max("_n").over(Window.partitionBy(*keys, "chunk")))
    )
    edge = local.filter((F.col("_n") == 0) | F.col("_last"))
    w_sess = (
        Window.partitionBy(*keys)
        .orderBy("chunk", "_n")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = (
        edge.withColumn("_id", F.sum((F.col("_n") > 0).cast("long")).over(w_sess))
        .groupBy(*keys, "_id")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .drop("_id")
    )
    inner = local.filter((F.col("_n") > 0) & ~F.col("_last")).select(*keys, "_s", "_e")
    return joined.unionByName(inner).select(
        *keys, F.col("_s").alias(start), F.col("_e").alias(end)
    )


def prefix_rank(df: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """0-based dense position of each row within its key, counted per block.

    ``block`` must rise with ``order``; the window inside a block never sees
    more than one block and the session-wide prefix runs over block counts.
    """
    tagged = df.withColumn("_blk", block)
    counts = tagged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_blk", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off")
    )
    local = tagged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order)) - 1
    )
    return (
        local.join(offsets, [*keys, "_blk"])
        .withColumn("row_idx", (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_blk", "_off", "_rn")
    )


def reach_closure(seeds: DataFrame, links: DataFrame, keys: list[str], materialize) -> DataFrame:
    """Nodes reachable from ``seeds`` (keys, node) over ``links`` (keys, node, nxt).

    Each node has at most one successor, so jumping twice as far every round
    needs log2(longest chain) rounds.
    """
    reached = materialize(seeds.select(*keys, "node"))
    jumps = materialize(links.select(*keys, "node", "nxt"))
    while True:
        found = reached.join(jumps, [*keys, "node"]).select(*keys, F.col("nxt").alias("node"))
        grown = materialize(reached.unionByName(found).distinct())
        hop = jumps.select(*keys, F.col("node").alias("nxt"), F.col("nxt").alias("_n2"))
        further = materialize(jumps.join(hop, [*keys, "nxt"]).select(*keys, "node", F.col("_n2").alias("nxt")))
        reached, jumps = grown, further
        if jumps.isEmpty():
            return reached


def chain_ends(nodes: DataFrame, links: DataFrame, keys: list[str], materialize) -> DataFrame:
    """Largest ``end`` along each node's chain: (keys, node, end).

    ``nodes`` has (keys, node, end), ``links`` (keys, node, nxt). Pointer
    jumping over linked nodes only: after round i every open pointer spans
    2**i links. Nodes without a link keep their own end.
    """
    after = nodes.select(*keys, F.col("node").alias("nxt"), F.col("end").alias("_end2"))
    table = materialize(
        links.join(nodes, [*keys, "node"])
        .join(after, [*keys, "nxt"])
        .select(*keys, "node", "nxt", F.greatest("end", "_end2").alias("end"))
    )
    while not table.filter(F.col("nxt").isNotNull()).isEmpty():
        target = table.select(
            *keys,
            F.col("node").alias("nxt"),
            F.col("nxt").alias("_nxt2"),
            F.col("end").alias("_end2"),
        )
        open_ = table.filter(F.col("nxt").isNotNull())
        jumped = open_.join(target, [*keys, "nxt"], "left").select(
            *keys,
            "node",
            F.col("_nxt2").alias("nxt"),
            F.greatest("end", "_end2").alias("end"),
        )
        table = materialize(table.filter(F.col("nxt").isNull()).unionByName(jumped))
    far = table.select(*keys, "node", F.col("end").alias("_far"))
    return nodes.join(far, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("_far", "end").alias("end")
    )
