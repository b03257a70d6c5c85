"""Conversation states from reply chains between heard and produced calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echogrid.config import BACK_CHAIN_HOP_S, TIME_TOL_S
from echogrid.functions import numeric as N
from echogrid.operators import events as E
from echogrid.operators import grid as G
from echogrid.operators.scan import DEFAULT_CHUNK_S, asof_join, chain_ends, merge_islands
from echogrid.runtime import materialize, spread
from echogrid.schema import HEARD, PRODUCED

KEYS = ["session_id"]


def produced_sequences(
    events: DataFrame, max_gap_s: float, chunk_s: float = DEFAULT_CHUNK_S
) -> DataFrame:
    """(session_id, p_on, p_off): produced calls no more than a gap apart."""
    spans = E.select_kind(events, PRODUCED).select("session_id", "t_on", "t_off")
    return (
        merge_islands(spans, KEYS, max_gap_s, chunk_s=chunk_s)
        .filter(F.col("t_off") > F.col("t_on"))
        .select("session_id", F.col("t_on").alias("p_on"), F.col("t_off").alias("p_off"))
    )


def heard_instants(events: DataFrame) -> DataFrame:
    """(session_id, h_on, h_off) per heard onset; the lowest ordinal gives h_off."""
    return (
        E.select_kind(events, HEARD)
        .groupBy("session_id", F.col("t_on").alias("h_on"))
        .agg(F.min_by("t_off", "ev_ord").alias("h_off"))
    )


def heard_chains(
    heard: DataFrame, hop_s: float = BACK_CHAIN_HOP_S, chunk_s: float = DEFAULT_CHUNK_S
) -> DataFrame:
    """(session_id, c_on, c_last): runs of heard onsets at most a hop apart."""
    points = heard.select("session_id", F.col("h_on").alias("t_on"), F.col("h_on").alias("t_off"))
    return merge_islands(points, KEYS, hop_s + TIME_TOL_S, chunk_s=chunk_s).select(
        "session_id", F.col("t_on").alias("c_on"), F.col("t_off").alias("c_last")
    )


def chain_starts(
    sequences: DataFrame,
    heard: DataFrame,
    response_s: float,
    hop_s: float = BACK_CHAIN_HOP_S,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Sequences that answer a heard call: adds c_on, the start of its chain.

    The heard call is the latest onset in [p_on - response, p_on]; its chain
    may begin before that window.
    """
    tol = F.lit(TIME_TOL_S)
    w_s = F.lit(float(response_s))
    seeds = asof_join(
        sequences,
        heard,
        KEYS,
        left_key=F.col("p_on") + tol,
        right_key=F.col("h_on"),
        payload=["h_on"],
        reach=(F.col("h_on"), F.col("h_on") + w_s),
        chunk_s=chunk_s,
    ).filter(F.col("match.h_on") >= F.col("p_on") - w_s - tol)
    seeds = seeds.select("session_id", "p_on", "p_off", F.col("match.h_on").alias("h_on"))
    chains = heard_chains(heard, hop_s, chunk_s)
    return asof_join(
        seeds,
        chains,
        KEYS,
        left_key=F.col("h_on"),
        right_key=F.col("c_on"),
        payload=["c_on"],
        reach=None,
        chunk_s=chunk_s,
    ).select("session_id", "p_on", "p_off", F.col("match.c_on").alias("c_on"))


def reply_links(
    sequences: DataFrame, heard: DataFrame, response_s: float, chunk_s: float = DEFAULT_CHUNK_S
) -> DataFrame:
    """(session_id, p_on, nxt): the sequence that continues the conversation.

    Next heard onset in (p_off, p_off + response], then the next sequence
    starting in (h_off, h_off + response]. Rows without a successor are left out.
    """
    tol = F.lit(TIME_TOL_S)
    w_s = F.lit(float(response_s))
    replied = asof_join(
        sequences,
        heard,
        KEYS,
        left_key=F.col("p_off") + tol,
        right_key=F.col("h_on"),
        payload=["h_on", "h_off"],
        reach=(F.col("h_on") - w_s - 2 * tol, F.col("h_on")),
        direction="forward",
        strict=True,
        chunk_s=chunk_s,
    ).filter(F.col("match.h_on") <= F.col("p_off") + w_s + tol)
    replied = replied.select("session_id", "p_on", F.col("match.h_off").alias("h_off"))
    target = sequences.select("session_id", F.col("p_on").alias("nxt"))
    return (
        asof_join(
            replied,
            target,
            KEYS,
            left_key=F.col("h_off") + tol,
            right_key=F.col("nxt"),
            payload=["nxt"],
            reach=(F.col("nxt") - w_s - 2 * tol, F.col("nxt")),
            direction="forward",
            strict=True,
            chunk_s=chunk_s,
        )
        .filter(F.col("match.nxt") <= F.col("h_off") + w_s + tol)
        .select("session_id", "p_on", F.col("match.nxt").alias("nxt"))
    )


def conversation_intervals(
    events: DataFrame,
    response_s: float,
    max_gap_s: float,
    hop_s: float = BACK_CHAIN_HOP_S,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Unmerged (session_id, t_on, t_off), one per sequence that answers a call."""
    sequences = materialize(produced_sequences(events, max_gap_s, chunk_s))
    heard = heard_instants(events)
    seeds = chain_starts(sequences, heard, response_s, hop_s, chunk_s)
    links = reply_links(sequences, heard, response_s, chunk_s)
    nodes = sequences.select("session_id", F.col("p_on").alias("node"), F.col("p_off").alias("end"))
    ends = chain_ends(nodes, links.withColumnRenamed("p_on", "node"), KEYS, materialize)
    return seeds.join(ends, (seeds.session_id == ends.session_id) & (seeds.p_on == ends.node)).select(
        seeds.session_id, F.col("c_on").alias("t_on"), F.col("end").alias("t_off")
    )


def merge_intervals(
    intervals: DataFrame, tol_s: float = TIME_TOL_S, chunk_s: float = DEFAULT_CHUNK_S
) -> DataFrame:
    """Overlapping or touching intervals merged."""
    return merge_islands(intervals, KEYS, tol_s, chunk_s=chunk_s)


def conversation_bins(
    events: DataFrame,
    sizes: DataFrame,
    dt: float,
    response_s: float,
    max_gap_s: float,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """(session_id, first_bin, last_bin) of merged conversations on the grid."""
    raw = materialize(conversation_intervals(events, response_s, max_gap_s, chunk_s=chunk_s))
    return materialize(G.interval_bins(merge_intervals(raw, chunk_s=chunk_s), sizes, dt))


def compute_states(convo_spans: DataFrame, sizes: DataFrame, dt: float, bad: DataFrame | None = None) -> DataFrame:
    """(session_id, bin, convo, spon) on the full grid, gated by the mask.

    Blocks of the grid meet the spans that reach them before bins are laid out,
    so no bin is shuffled.
    """
    G.check_dt(dt)
    b = F.lit(G.BLOCK_BINS)
    reach = F.sequence(F.floor(F.col("first_bin") / b), F.floor(F.col("last_bin") / b))
    spans = (
        convo_spans.select("session_id", F.explode(reach).alias("blk"), F.struct("first_bin", "last_bin").alias("_s"))
        .groupBy("session_id", "blk")
        .agg(F.collect_set("_s").alias("_spans"))
    )
    blocks = spread(G.grid_blocks(sizes).join(spans, ["session_id", "blk"], "left"), "session_id", "blk")
    covered = F.transform(
        F.sequence("first_bin", "last_bin"),
        lambda x: F.struct(
            x.alias("bin"),
            F.coalesce(F.exists("_spans", lambda s: (s["first_bin"] <= x) & (x <= s["last_bin"])), F.lit(False)).alias("raw"),
        ),
    )
    cells = G.with_mask(blocks.select("session_id", F.inline(covered)), bad)
    return cells.select(
        "session_id",
        "bin",
        (F.col("raw") & F.col("good")).alias("convo"),
        (~F.col("raw") & F.col("good")).alias("spon"),
    )


def merge_bin_spans(spans: DataFrame, keys: list[str], chunk_bins: int = G.BLOCK_BINS) -> DataFrame:
    """Touching or overlapping bin spans merged."""
    half_open = spans.select(
        *keys,
        F.col("first_bin").cast("double").alias("a"),
        (F.col("last_bin") + 1).cast("double").alias("b"),
    )
    return merge_islands(half_open, keys, 0.0, "a", "b", float(chunk_bins)).select(
        *keys,
        F.col("a").cast("long").alias("first_bin"),
        (F.col("b") - 1).cast("long").alias("last_bin"),
    )


def run_length_segments(labelled: DataFrame, dt: float) -> DataFrame:
    """Segments of equal consecutive labels from (session_id, bin, state) rows.

    Bins without a row break runs. Bins are gathered as words of 64 bits, whose
    runs are merged: a word is added up before it moves.
    """
    words = (
        labelled.filter(F.col("state").isNotNull())
        .groupBy("session_id", "state", F.floor(F.col("bin") / F.lit(64)).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(bin, 64) as int)))").alias("m"))
    )
    places = "filter(sequence(0, 63), i -> bit_get(m & ~{}(m, 1), i) = 1)"
    runs = words.select(
        "session_id",
        "state",
        "word",
        F.explode(F.arrays_zip(F.expr(places.format("shiftleft")).alias("a"), F.expr(places.format("shiftrightunsigned")).alias("z"))).alias("r"),
    ).select(
        "session_id",
        "state",
        (F.col("word") * 64 + F.col("r.a")).alias("first_bin"),
        (F.col("word") * 64 + F.col("r.z")).alias("last_bin"),
    )
    return segment_times(merge_bin_spans(runs, ["session_id", "state"]), dt)


def complement_spans(spans: DataFrame, sizes: DataFrame, block_bins: int = G.BLOCK_BINS) -> DataFrame:
    """Bin spans of the grid not covered by ``spans`` (block by block, then merged)."""
    b = F.lit(block_bins)
    blocks = G.grid_blocks(sizes, block_bins)
    cover = spans.withColumn(
        "blk", F.explode(F.sequence(F.floor(F.col("first_bin") / b), F.floor(F.col("last_bin") / b)))
    ).select(
        "session_id",
        "blk",
        F.greatest(F.col("first_bin"), F.col("blk") * b).alias("lo"),
        F.least(F.col("last_bin"), (F.col("blk") + 1) * b - 1).alias("hi"),
    )
    # A sentinel just past the block closes its last gap.
    ends = blocks.select(
        "session_id", "blk", (F.col("last_bin") + 1).alias("lo"), (F.col("last_bin") + 1).alias("hi")
    )
    w = Window.partitionBy("session_id", "blk").orderBy("lo", "hi")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = (
        cover.unionByName(ends)
        .withColumn("first_bin", F.coalesce(reached + 1, F.col("blk") * b))
        .withColumn("last_bin", F.col("lo") - 1)
        .filter(F.col("first_bin") <= F.col("last_bin"))
    )
    return merge_bin_spans(gaps.select("session_id", "first_bin", "last_bin"), KEYS, block_bins)


def segment_times(spans: DataFrame, dt: float) -> DataFrame:
    """Bin spans as time segments [first*dt, last*dt + dt]."""
    d = F.lit(float(dt))
    return spans.select(
        "session_id",
        "state",
        (F.col("first_bin") * d).alias("t_on"),
        (F.col("last_bin") * d + d).alias("t_off"),
        "first_bin",
        "last_bin",
    )


def state_segments(convo_spans: DataFrame, sizes: DataFrame, dt: float) -> DataFrame:
    """convo/spon segments straight from bin spans, without expanding bins."""
    convo = merge_bin_spans(convo_spans, KEYS)
    spon = complement_spans(convo_spans, sizes)
    both = convo.withColumn("state", F.lit("convo")).unionByName(
        spon.withColumn("state", F.lit("spon"))
    )
    return segment_times(both, dt)


def state_spans_from_segments(segments: DataFrame) -> DataFrame:
    return segments.select("session_id", F.col("state").alias("stream"), "first_bin", "last_bin")
