"""Event normalisation, filtering, collapsing and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.config import CONTEXT_LOOKBACK_S
from echogrid.functions import labels as L
from echogrid.functions import numeric as N
from echogrid.operators.scan import (
    DEFAULT_CHUNK_S,
    asof_join,
    carried,
    chunk_of,
    emit_to_chunks,
    reach_closure,
)
from echogrid.runtime import materialize
from echogrid.schema import HEARD, PRODUCED

# Kept bout records sort after other events at the same onset.
BOUT_ORD_SHIFT = 1 << 52


def normalize_records(df: DataFrame, default_kind: str | None = None) -> DataFrame:
    """(kind, onset, offset, label) records as events."""
    kind = L.clean_kind(F.col("kind"))
    if default_kind is not None:
        kind = F.coalesce(kind, F.lit(default_kind))
    keep = [c for c in ("session_id", "ev_ord") if c in df.columns]
    return df.select(
        *keep,
        kind.alias("kind"),
        F.col("onset").cast("double").alias("t_on"),
        F.col("offset").cast("double").alias("t_off"),
        L.clean_label(F.col("label")).alias("label"),
    )


def concat_events(heard: DataFrame, produced: DataFrame) -> DataFrame:
    """Heard then produced; heard ordinals stay below produced ones."""
    shift = F.lit(1 << 50)
    return heard.unionByName(produced.withColumn("ev_ord", F.col("ev_ord") + shift))


def select_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("kind") == kind)


def finite_onsets(events: DataFrame) -> DataFrame:
    return events.filter(N.is_finite(F.col("t_on")))


def repaired_stop(t_on: Column, t_off: Column) -> Column:
    """Stop of an interval; a non-finite stop falls back to the start."""
    return F.when(N.is_finite(t_off), t_off).otherwise(t_on)


def within_recording(events: DataFrame, t_end: float | Column) -> DataFrame:
    """Keep events that start by the end of the recording."""
    return events.filter(F.col("t_on") <= (F.lit(t_end) if isinstance(t_end, float) else t_end))


def overlap_class(t0: Column, t_end: Column) -> Column:
    """Position of an event relative to the recording [t0, t_end]."""
    return (
        F.when(F.col("t_off") < t0, "before")
        .when(F.col("t_on") > t_end, "after")
        .when((F.col("t_on") >= t0) & (F.col("t_off") <= t_end), "within")
        .otherwise("partial")
    )


def kind_composition(events: DataFrame) -> DataFrame:
    """Count and percentage per kind."""
    counts = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # One row per kind: the whole-set window holds a handful of rows.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("kind", "n", (100.0 * F.col("n") / total).alias("pct"))


def instants(events: DataFrame) -> DataFrame:
    """One row per (session, onset): what later operators need to know of it.

    Aggregating first makes ties harmless and lets a hot session or onset
    shrink on the map side before any shuffle.
    """
    produced = F.col("kind") == PRODUCED
    heard = F.col("kind") == HEARD
    stop = repaired_stop(F.col("t_on"), F.col("t_off"))
    raster = ~(N.is_finite(F.col("t_off")) & (F.col("t_off") <= F.col("t_on")))
    return (
        finite_onsets(events)
        .filter(produced | heard)
        .groupBy("session_id", "t_on")
        .agg(
            F.min_by("kind", "ev_ord").alias("first_kind"),
            F.count_if(produced).alias("n_produced"),
            F.count_if(heard).alias("n_heard"),
            F.min(F.when(produced, F.least(F.col("t_on"), stop))).alias("p_lo"),
            F.max(F.when(produced, F.greatest(F.col("t_on"), stop))).alias("p_hi"),
            F.coalesce(F.bool_or(produced & raster), F.lit(False)).alias("p_raster"),
            F.coalesce(F.bool_or(heard & raster), F.lit(False)).alias("h_raster"),
        )
    )


def produced_context(
    points: DataFrame,
    lookback_s: float = CONTEXT_LOOKBACK_S,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Instants holding produced events, with the context category.

    The category follows the kind of the latest strictly earlier onset no more
    than ``lookback_s`` back (lowest ordinal among equal onsets).
    """
    t = F.col("t_on")
    wide = emit_to_chunks(points, t, t + F.lit(float(lookback_s)), chunk_s)
    w = Window.partitionBy("session_id", "chunk").orderBy("t_on")
    near = F.lag("t_on").over(w) >= t - F.lit(float(lookback_s))
    return (
        wide.withColumn("_prev", F.when(near, F.lag("first_kind").over(w)))
        .filter((F.col("n_produced") > 0) & (F.col("chunk") == chunk_of(t, chunk_s)))
        .withColumn(
            "stream",
            F.when(F.col("_prev") == HEARD, "produced_after_heard")
            .when(F.col("_prev") == PRODUCED, "produced_after_produced")
            .otherwise("produced_spontaneous"),
        )
        .drop("_prev", "chunk")
    )


def heard_proximity(
    points: DataFrame,
    addressed_s: float = 4.0,
    silence_s: float = 5.0,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Instants holding heard events, classed by distance to produced intervals.

    addressed within ``addressed_s``, overheard at ``silence_s`` or farther,
    otherwise neither (null). A produced interval visits the chunk of its start
    and those in reach before it; how far the intervals of earlier chunks run is
    one carried row per chunk, so an interval's length makes no copies.
    """
    t = F.col("t_on")
    reach = F.lit(float(max(addressed_s, silence_s)))
    # An interval that starts before its onset (repaired, inverted) is keyed by
    # its low end and so becomes its own row.
    parts = points.select(
        "*",
        F.explode(
            F.when(
                (F.col("n_produced") > 0) & (F.col("p_lo") < t) & (F.col("n_heard") > 0),
                F.array(F.lit("p"), F.lit("h")),
            )
            .when((F.col("n_produced") > 0) & (F.col("p_lo") < t), F.array(F.lit("p")))
            .when(F.col("n_produced") > 0, F.array(F.lit("b")))
            .otherwise(F.array(F.lit("h")))
        ).alias("_part"),
    )
    is_p = F.col("_part") != "h"
    is_h = (F.col("n_heard") > 0) & (F.col("_part") != "p")
    parts = parts.withColumn("p_key", F.when(is_p, F.col("p_lo")).otherwise(t))
    ends = parts.groupBy("session_id", chunk_of(F.col("p_key"), chunk_s).alias("chunk")).agg(
        F.max(F.when(is_p, F.col("p_hi"))).alias("p_hi")
    )
    wide = emit_to_chunks(parts, F.when(is_p, F.col("p_key") - reach).otherwise(t), F.col("p_key"), chunk_s)
    # The carried row has no key and so comes before all others of its chunk.
    tagged = wide.unionByName(
        carried(ends, ["session_id"], "p_hi").withColumn("_part", F.lit("c")), allowMissingColumns=True
    )
    w = Window.partitionBy("session_id", "chunk")
    upto = w.orderBy("p_key", "t_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = w.orderBy(F.desc("p_key"), F.desc("t_on")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    prev_end = F.max(F.when(is_p, F.col("p_hi"))).over(upto)
    next_start = F.min(F.when(is_p, F.col("p_lo"))).over(down)
    after = F.when(F.col("_end").isNotNull(), F.greatest(t - F.col("_end"), F.lit(0.0)))
    before = F.when(F.col("_start").isNotNull(), F.greatest(F.col("_start") - t, F.lit(0.0)))
    dist = F.least(after, before)
    return (
        tagged.withColumn("_end", prev_end)
        .withColumn("_start", next_start)
        .filter(is_h & (F.col("chunk") == chunk_of(t, chunk_s)))
        .withColumn(
            "stream",
            F.when(dist <= F.lit(float(addressed_s)), "heard_addressed").when(
                dist.isNull() | (dist >= F.lit(float(silence_s))), "heard_overheard"
            ),
        )
        .drop("_part", "p_key", "_end", "_start", "chunk")
    )


def label_events(events: DataFrame, classed: DataFrame, kind: str) -> DataFrame:
    """Events of one kind with their instant's class in ``stream``."""
    return select_kind(events, kind).join(
        classed.select("session_id", "t_on", "stream"), ["session_id", "t_on"], "left"
    )


def collapse_bouts(
    events: DataFrame, window_s: float = 1.5, chunk_s: float = DEFAULT_CHUNK_S
) -> DataFrame:
    """Keep the first syllable of each produced bout; other events pass through.

    A bout runs from its first onset; the next target onset more than
    ``window_s`` after that start opens a new one. Onsets whose predecessor is
    farther than the window always open a bout; from those the bout starts are
    found by following "first onset beyond start + window" links, doubling the
    jump every round.
    """
    w_s = F.lit(float(window_s))
    t = F.col("t_on")
    target = (F.lower(F.col("kind")) == PRODUCED) & L.is_bout_label(F.col("label"))
    hits = finite_onsets(events.filter(target))
    onsets = materialize(hits.select("session_id", "t_on").distinct())
    w = Window.partitionBy("session_id", "chunk").orderBy("t_on")
    heads = (
        emit_to_chunks(onsets, t, t + w_s, chunk_s)
        .withColumn("_p", F.lag("t_on").over(w))
        .filter(F.col("chunk") == chunk_of(t, chunk_s))
        .filter(F.col("_p").isNull() | (t > F.col("_p") + w_s))
        .select("session_id", t.alias("node"))
    )
    links = (
        asof_join(
            onsets,
            onsets.withColumnRenamed("t_on", "r_on"),
            ["session_id"],
            left_key=t + w_s,
            right_key=F.col("r_on"),
            payload=["r_on"],
            reach=(F.col("r_on") - w_s, F.col("r_on")),
            direction="forward",
            strict=True,
            chunk_s=chunk_s,
        )
        # A successor beyond the reach has its predecessor more than a window
        # away, so it is one of the heads already.
        .filter(F.col("match").isNotNull())
        .select("session_id", t.alias("node"), F.col("match.r_on").alias("nxt"))
    )
    starts = reach_closure(heads, links, ["session_id"], materialize)
    kept = (
        hits.groupBy("session_id", "t_on")
        .agg(F.min_by(F.struct(*[F.col(c) for c in events.columns]), "ev_ord").alias("_e"))
        .join(starts.withColumnRenamed("node", "t_on"), ["session_id", "t_on"], "left_semi")
        .select("_e.*")
        .withColumn("ev_ord", F.col("ev_ord") + F.lit(BOUT_ORD_SHIFT))
    )
    return events.filter(~F.coalesce(target, F.lit(False))).unionByName(kept)


def mark_addressed(events: DataFrame, window_s: float = 10.0, chunk_s: float = DEFAULT_CHUNK_S) -> DataFrame:
    """Heard events with ``addressed``: a produced onset within the next window."""
    w_s = F.lit(float(window_s))
    made = finite_onsets(select_kind(events, PRODUCED)).select(
        "session_id", F.col("t_on").alias("r_on")
    ).distinct()
    out = asof_join(
        finite_onsets(select_kind(events, HEARD)),
        made,
        ["session_id"],
        left_key=F.col("t_on"),
        right_key=F.col("r_on"),
        payload=["r_on"],
        reach=(F.col("r_on") - w_s, F.col("r_on")),
        direction="forward",
        chunk_s=chunk_s,
    )
    near = F.col("match.r_on") <= F.col("t_on") + w_s
    return out.withColumn("addressed", F.coalesce(near, F.lit(False))).drop("match")
