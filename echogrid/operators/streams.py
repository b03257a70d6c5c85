"""Heard and produced onset streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echogrid import config as C
from echogrid.functions import labels as L
from echogrid.functions import numeric as N
from echogrid.operators import events as E
from echogrid.operators.grid import rasterize_onsets
from echogrid.operators.scan import DEFAULT_CHUNK_S
from echogrid.schema import BASE_CALL_TYPES, CONTEXT_STREAMS, PRODUCED


def call_type_names(events: DataFrame) -> list[str]:
    """Base call-type streams, then other observed ones in first-seen order.

    Each type becomes a block of design columns, so the names belong to the
    driver's layout. ``call_types`` in the config gives them without a scan.
    """
    base = ["produced_" + t for t in BASE_CALL_TYPES]
    seen = (
        E.select_kind(events, PRODUCED)
        .groupBy(L.call_type_stream(F.col("label")).alias("stream"))
        .agg(F.min(F.struct("session_id", "ev_ord")).alias("first"))
        .filter(~F.col("stream").isin(base))
        .orderBy("first")
    )
    return base + [r["stream"] for r in seen.collect()]


def produced_names(events: DataFrame, cfg: dict) -> list[str]:
    if C.split_mode(cfg) == "context":
        return list(CONTEXT_STREAMS)
    given = cfg.get("call_types")
    if given is not None:
        return ["produced_" + t for t in dict.fromkeys([*BASE_CALL_TYPES, *given])]
    return call_type_names(events)


def stream_onsets(events: DataFrame, cfg: dict, chunk_s: float = DEFAULT_CHUNK_S) -> DataFrame:
    """(session_id, stream, t_on) of every rasterisable onset, totals included."""
    points = E.instants(events)
    heard = E.heard_proximity(
        points,
        C.window_width(cfg, "perceived_addressed_window_s", 4.0),
        C.window_width(cfg, "perceived_overheard_silence_s", 5.0),
        chunk_s,
    ).filter("h_raster")
    out = heard.select(
        "session_id",
        "t_on",
        F.explode(F.array_compact(F.array(F.lit("heard_any"), F.col("stream")))).alias("stream"),
    )
    if C.split_mode(cfg) == "context":
        made = E.produced_context(points, chunk_s=chunk_s).filter("p_raster")
    else:
        raster = ~(N.is_finite(F.col("t_off")) & (F.col("t_off") <= F.col("t_on")))
        made = (
            E.finite_onsets(E.select_kind(events, PRODUCED))
            .filter(raster)
            .withColumn("stream", L.call_type_stream(F.col("label")))
        )
    made = made.select(
        "session_id",
        "t_on",
        F.explode(F.array(F.lit("produced_any"), F.col("stream"))).alias("stream"),
    )
    return out.unionByName(made)


def build_streams(
    events: DataFrame,
    dt: float,
    cfg: dict,
    sizes: DataFrame | None = None,
    chunk_s: float = DEFAULT_CHUNK_S,
) -> DataFrame:
    """Distinct impulses (session_id, stream, bin) of all streams."""
    return rasterize_onsets(stream_onsets(events, cfg, chunk_s), dt, sizes)


def event_counts(impulses: DataFrame) -> DataFrame:
    """Occupied bins per (session_id, stream)."""
    return impulses.groupBy("session_id", "stream").agg(F.count(F.lit(1)).alias("n"))


def nth_event(events: DataFrame, kind: str = PRODUCED, n: int = 5, chunk_s: float = DEFAULT_CHUNK_S) -> DataFrame:
    """The n-th event of a kind per session, by row order.

    Each block of ordinals keeps only its n lowest rows before the session-wide
    ranking, so the ranking sees at most n rows per block.
    """
    some = events.filter(F.lower(F.col("kind")) == kind)
    blk = F.floor(F.col("ev_ord") / F.lit(100_000))
    local = Window.partitionBy("session_id", blk).orderBy("ev_ord")
    top = some.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
    w = Window.partitionBy("session_id").orderBy("ev_ord")
    return top.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == n).drop("_r")
