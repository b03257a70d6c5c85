"""Queries over events, streams and states, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from echogrid.functions import labels as L
from echogrid.functions import numeric as N
from echogrid.operators import events as E
from echogrid.operators import grid as G
from echogrid.operators import states as ST
from echogrid.operators import streams as S
from echogrid.operators import validate as V
from echogrid.plans import tables as T

QUERIES = {}
ORACLES = {}

DT = 1.0
# No link reaches farther than a few model seconds, and a month of table time
# is 720 of them.
CHUNK = 120.0


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def with_events(body: str) -> str:
    return "WITH RECURSIVE " + T.SQL_EVENTS.strip() + body


SQL_GRID = """,
ext AS (
  SELECT session_id, greatest(0.0, max(t)) AS extent FROM (
    SELECT session_id, t_off AS t FROM ev UNION ALL SELECT session_id, t FROM sp) GROUP BY 1
),
sizes AS (SELECT session_id, CAST(floor(extent / 1.0 + 0.5) AS BIGINT) + 1 AS n_bins FROM ext)
"""


def sizes(spark, sf):
    return G.grid_sizes(G.session_extent(T.events(spark, sf), T.spikes(spark, sf)), DT)


@query(with_events(SQL_GRID + "SELECT session_id, round(extent, 6) AS extent, n_bins FROM ext JOIN sizes USING (session_id)"))
def timebase_extent(spark, sf):
    ext = G.session_extent(T.events(spark, sf), T.spikes(spark, sf))
    return ext.select(
        "session_id", F.round("extent", 6).alias("extent"), N.n_grid_bins(F.col("extent"), DT).alias("n_bins")
    )


@query(with_events(SQL_GRID + """
SELECT session_id, count(*) AS n_bins, sum(bin) AS bin_sum, max(bin) * 1.0 AS t_last
FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes) GROUP BY 1"""))
def grid_cells(spark, sf):
    return G.grid(sizes(spark, sf), DT).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("bin").alias("bin_sum"), F.max("t").alias("t_last")
    )


@query(with_events(SQL_GRID + """
SELECT session_id, neuron_id, CAST(floor(t / 1.0) AS BIGINT) AS bin, count(*) AS n
FROM sp JOIN sizes USING (session_id) WHERE floor(t / 1.0) < n_bins GROUP BY 1, 2, 3"""))
def spike_bin_counts(spark, sf):
    return G.spike_counts(T.spikes(spark, sf), sizes(spark, sf), DT)


@query("""
WITH t AS (SELECT l_orderkey AS session_id, l_quantity / 10.0::DOUBLE AS t FROM lineitem),
b AS (SELECT session_id, t, floor(t / 0.1::DOUBLE) AS b0 FROM t),
c AS (SELECT session_id, t, CASE WHEN t < b0 * 0.1::DOUBLE THEN b0 - 1 WHEN t >= (b0 + 1) * 0.1::DOUBLE THEN b0 + 1 ELSE b0 END AS b FROM b)
SELECT CAST(b AS BIGINT) AS bin, count(*) AS n, count(DISTINCT session_id) AS sessions
FROM c WHERE b >= 0 AND b < 1000 GROUP BY 1""")
def spike_edge_rule(spark, sf):
    """Quantities in tenths fall on bin edges, where plain floor goes wrong."""
    li = T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_quantity") / F.lit(10.0)).alias("t")
    )
    binned = li.withColumn("bin", N.edge_bin(F.col("t"), 0.1, F.lit(1000))).filter("bin is not null")
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions")
    )


@query(with_events("""
SELECT session_id, count(*) AS n_events,
  sum(CASE WHEN t_off < t_on THEN 1 ELSE 0 END)::BIGINT AS n_inverted,
  sum(CASE WHEN t_on < -1.0 OR t_off > 701.0 THEN 1 ELSE 0 END)::BIGINT AS n_out_of_bounds
FROM ev GROUP BY 1"""))
def validate_events(spark, sf):
    return V.event_report(T.events(spark, sf), session_duration=700.0, buffer=1.0).select(
        "session_id", "n_events", "n_inverted", "n_out_of_bounds"
    )


@query(with_events("""
, o AS (SELECT session_id, t, lag(t) OVER (PARTITION BY session_id ORDER BY t DESC) AS p FROM sp)
SELECT session_id, count(*) AS n, sum(CASE WHEN p > t THEN 1 ELSE 0 END)::BIGINT AS n_unsorted FROM o GROUP BY 1"""))
def validate_spike_order(spark, sf):
    """Row order taken as descending time: every step is a violation."""
    sp = T.spikes(spark, sf).withColumn("ord", -F.col("t"))
    return V.spike_report(sp, order="ord", chunk=F.floor(F.col("t") / 50.0) * -1).select("session_id", "n", "n_unsorted")


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(lower(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), '[_\-\s]', '', 'g') AS s FROM documents),
k AS (SELECT doc_id, CASE WHEN contains(s, 'trillphee') THEN 'trillphee' WHEN contains(s, 'trill') THEN 'trill'
  WHEN contains(s, 'twitter') THEN 'twitter' WHEN contains(s, 'phee') THEN 'phee'
  WHEN regexp_replace(s, '[0-9]+$', '') <> '' THEN regexp_replace(s, '[0-9]+$', '')
  WHEN s <> '' THEN s ELSE 'unknown' END AS call_type FROM c)
SELECT doc_id, call_type, 'produced_' || coalesce(nullif(regexp_replace(lower(trim(call_type, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), '[^a-z0-9]', '', 'g'), ''), 'unknown') AS stream
FROM k""")
def call_type_canonical(spark, sf):
    docs = T.read(spark, sf, "documents")
    return docs.select(
        "doc_id",
        L.call_type(F.col("text")).alias("call_type"),
        L.call_type_stream(F.col("text")).alias("stream"),
    )


@query(with_events("""
, h AS (SELECT *, t_on + 1.5::DOUBLE AS lim FROM ev WHERE kind = 'produced' AND label = 'purchase'),
d AS (SELECT DISTINCT session_id, t_on FROM h),
n AS (SELECT a.session_id, a.t_on, (SELECT min(b.t_on) FROM d b WHERE b.session_id = a.session_id AND b.t_on > a.t_on + 1.5::DOUBLE) AS nxt FROM d a),
r AS (
  SELECT session_id, min(t_on) AS t_on FROM d GROUP BY 1
  UNION ALL
  SELECT n.session_id, n.nxt FROM r JOIN n ON n.session_id = r.session_id AND n.t_on = r.t_on WHERE n.nxt IS NOT NULL
)
SELECT session_id, min(h.ev_ord) AS ev_ord, round(t_on, 6) AS t_on, round(arg_min(h.t_off, h.ev_ord), 6) AS t_off, TRUE AS is_bout
FROM h JOIN r USING (session_id, t_on) GROUP BY session_id, t_on
UNION ALL
SELECT session_id, ev_ord, round(t_on, 6), round(t_off, 6), FALSE FROM ev WHERE NOT (kind = 'produced' AND label = 'purchase')"""))
def bout_collapse(spark, sf):
    """First syllable of each bout and all other events as they are; purchases play the bout calls."""
    ev = T.events(spark, sf).withColumn(
        "label", F.when(F.col("label") == "purchase", "Twitter_A").otherwise(F.col("label"))
    )
    bout = L.is_bout_label(F.col("label"))
    return E.collapse_bouts(ev, 1.5, CHUNK).select(
        "session_id",
        F.when(bout, F.col("ev_ord") - F.lit(E.BOUT_ORD_SHIFT)).otherwise(F.col("ev_ord")).alias("ev_ord"),
        F.round("t_on", 6).alias("t_on"),
        F.round("t_off", 6).alias("t_off"),
        bout.alias("is_bout"),
    )


SQL_HEARD = """,
hp AS (
  SELECT session_id, ev_ord, t_on, t_off, kind,
    max(CASE WHEN kind = 'produced' THEN t_off END) OVER (PARTITION BY session_id ORDER BY t_on RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e,
    min(CASE WHEN kind = 'produced' THEN t_on END) OVER (PARTITION BY session_id ORDER BY t_on RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
  FROM ev
),
hc AS (
  SELECT session_id, ev_ord, t_on, t_off,
    least(CASE WHEN e IS NOT NULL THEN greatest(t_on - e, 0.0) END, CASE WHEN s IS NOT NULL THEN greatest(s - t_on, 0.0) END) AS d
  FROM hp WHERE kind = 'perceived'
),
hk AS (
  SELECT session_id, ev_ord, t_on, t_off,
    CASE WHEN d <= 4.0 THEN 'heard_addressed' WHEN d IS NULL OR d >= 5.0 THEN 'heard_overheard' END AS stream FROM hc
)
"""

SQL_CONTEXT = """,
pc AS (
  SELECT a.session_id, a.ev_ord, a.t_on, a.t_off,
    (SELECT arg_max(b.kind, (b.t_on, -b.ev_ord)) FROM ev b WHERE b.session_id = a.session_id AND b.t_on < a.t_on AND b.t_on >= a.t_on - 5.0) AS prev
  FROM ev a WHERE a.kind = 'produced'
),
pk AS (
  SELECT session_id, ev_ord, t_on, t_off,
    CASE prev WHEN 'perceived' THEN 'produced_after_heard' WHEN 'produced' THEN 'produced_after_produced' ELSE 'produced_spontaneous' END AS stream
  FROM pc
)
"""


@query(with_events(SQL_HEARD + "SELECT session_id, ev_ord, stream FROM hk"))
def heard_proximity(spark, sf):
    ev = T.events(spark, sf)
    classed = E.heard_proximity(E.instants(ev), chunk_s=CHUNK)
    return E.label_events(ev, classed, "perceived").select("session_id", "ev_ord", "stream")


@query(with_events(SQL_CONTEXT + "SELECT session_id, ev_ord, stream FROM pk"))
def produced_context(spark, sf):
    ev = T.events(spark, sf)
    classed = E.produced_context(E.instants(ev), chunk_s=CHUNK)
    return E.label_events(ev, classed, "produced").select("session_id", "ev_ord", "stream")


@query(with_events(SQL_CONTEXT + "SELECT stream, count(*) AS n, count(DISTINCT session_id) AS sessions FROM pk GROUP BY 1"))
def produced_context_counts(spark, sf):
    """Class sizes straight from the onset aggregate, without going back to events."""
    classed = E.produced_context(E.instants(T.events(spark, sf)), chunk_s=CHUNK)
    return classed.groupBy("stream").agg(
        F.sum("n_produced").alias("n"), F.count_distinct("session_id").alias("sessions")
    )


@query(with_events("""
SELECT kind, cls, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS pct FROM (
  SELECT kind, CASE WHEN t_off < 100.0 THEN 'before' WHEN t_on > 600.0 THEN 'after'
    WHEN t_on >= 100.0 AND t_off <= 600.0 THEN 'within' ELSE 'partial' END AS cls FROM ev) GROUP BY 1, 2"""))
def event_overlap_classes(spark, sf):
    from pyspark.sql import Window

    cls = T.events(spark, sf).select("kind", E.overlap_class(F.lit(100.0), F.lit(600.0)).alias("cls"))
    counts = cls.groupBy("kind", "cls").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    return counts.select("kind", "cls", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"))


@query(with_events("SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ev GROUP BY 1"))
def kind_composition(spark, sf):
    return E.kind_composition(T.events(spark, sf)).select("kind", "n", F.round("pct", 6).alias("pct"))


@query(with_events("SELECT session_id, ev_ord, kind, round(t_on, 6) AS t_on FROM ev WHERE t_on <= 360.5"))
def recording_window(spark, sf):
    return E.within_recording(T.events(spark, sf), 360.5).select(
        "session_id", "ev_ord", "kind", F.round("t_on", 6).alias("t_on")
    )


SQL_STREAMS = SQL_HEARD + SQL_CONTEXT + """,
st AS (
  SELECT DISTINCT session_id, stream, CAST(floor(t_on + 1e-9::DOUBLE) AS BIGINT) AS bin FROM (
    SELECT session_id, t_on, t_off, stream FROM hk WHERE stream IS NOT NULL
    UNION ALL SELECT session_id, t_on, t_off, 'heard_any' FROM hk
    UNION ALL SELECT session_id, t_on, t_off, stream FROM pk
    UNION ALL SELECT session_id, t_on, t_off, 'produced_any' FROM pk) WHERE t_off > t_on
)
"""


@query(with_events(SQL_STREAMS + "SELECT session_id, stream, bin FROM st"))
def onset_streams(spark, sf):
    return S.build_streams(T.events(spark, sf), DT, {}, chunk_s=CHUNK)


@query(with_events("""
SELECT DISTINCT session_id, s AS stream, CAST(floor(t_on + 1e-9::DOUBLE) AS BIGINT) AS bin
FROM (SELECT session_id, t_on, unnest(['produced_any', 'produced_' || label]) AS s FROM ev WHERE kind = 'produced' AND t_off > t_on)"""))
def call_type_streams(spark, sf):
    imp = S.build_streams(T.events(spark, sf), DT, {"produced_split_mode": "call_type"}, chunk_s=CHUNK)
    return imp.filter(F.col("stream").startswith("produced_"))


@query(with_events(SQL_STREAMS + "SELECT session_id, stream, count(*) AS n FROM st GROUP BY 1, 2"))
def event_counts(spark, sf):
    return S.event_counts(S.build_streams(T.events(spark, sf), DT, {}, chunk_s=CHUNK))


@query(with_events("""
SELECT session_id, ev_ord, round(t_on, 6) AS t_on FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ev_ord) AS r FROM ev WHERE kind = 'produced') WHERE r = 5"""))
def nth_produced_event(spark, sf):
    return S.nth_event(T.events(spark, sf)).select("session_id", "ev_ord", F.round("t_on", 6).alias("t_on"))


SQL_SEQ = """,
q1 AS (
  SELECT session_id, t_on, t_off,
    max(t_off) OVER (PARTITION BY session_id ORDER BY t_on, ev_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM ev WHERE kind = 'produced'
),
q2 AS (
  SELECT *, sum(CASE WHEN m IS NULL OR t_on - m > 5.0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_on, t_off ROWS UNBOUNDED PRECEDING) AS g FROM q1
),
sq AS (SELECT session_id, min(t_on) AS p_on, max(t_off) AS p_off FROM q2 GROUP BY session_id, g HAVING max(t_off) > min(t_on))
"""

SQL_CHAIN = """,
hd AS (SELECT session_id, t_on AS h_on, arg_min(t_off, ev_ord) AS h_off FROM ev WHERE kind = 'perceived' GROUP BY 1, 2),
h1 AS (SELECT *, lag(h_on) OVER (PARTITION BY session_id ORDER BY h_on) AS p FROM hd),
h2 AS (SELECT *, sum(CASE WHEN p IS NULL OR h_on - p > 0.5 + 1e-9::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY h_on ROWS UNBOUNDED PRECEDING) AS g FROM h1),
h3 AS (SELECT session_id, h_on, h_off, min(h_on) OVER (PARTITION BY session_id, g) AS c_on, max(h_on) OVER (PARTITION BY session_id, g) AS c_last FROM h2)
"""

SQL_REPLY = """,
seed AS (
  SELECT s.session_id, s.p_on, arg_max(h.c_on, h.h_on) AS c_on FROM sq s JOIN h3 h
  ON h.session_id = s.session_id AND h.h_on <= s.p_on + 1e-9::DOUBLE AND h.h_on >= s.p_on - 5.0 - 1e-9::DOUBLE GROUP BY 1, 2
),
f1 AS (
  SELECT s.session_id, s.p_on, arg_min(h.h_off, h.h_on) AS h_off FROM sq s JOIN hd h
  ON h.session_id = s.session_id AND h.h_on > s.p_off + 1e-9::DOUBLE AND h.h_on <= s.p_off + 5.0 + 1e-9::DOUBLE GROUP BY 1, 2
),
link AS (
  SELECT f.session_id, f.p_on, min(s.p_on) AS nxt FROM f1 f JOIN sq s
  ON s.session_id = f.session_id AND s.p_on > f.h_off + 1e-9::DOUBLE AND s.p_on <= f.h_off + 5.0 + 1e-9::DOUBLE GROUP BY 1, 2
),
walk AS (
  SELECT seed.session_id, seed.p_on AS root, seed.p_on AS at, seed.c_on FROM seed
  UNION ALL
  SELECT w.session_id, w.root, l.nxt, w.c_on FROM walk w JOIN link l ON l.session_id = w.session_id AND l.p_on = w.at
),
iv AS (
  SELECT w.session_id, w.c_on AS t_on, max(s.p_off) AS t_off FROM walk w JOIN sq s ON s.session_id = w.session_id AND s.p_on = w.at
  GROUP BY w.session_id, w.root, w.c_on
),
m1 AS (SELECT *, max(t_off) OVER (PARTITION BY session_id ORDER BY t_on, t_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv),
m2 AS (SELECT *, sum(CASE WHEN m IS NULL OR t_on > m + 1e-9::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t_on, t_off ROWS UNBOUNDED PRECEDING) AS g FROM m1),
mi AS (SELECT session_id, min(t_on) AS t_on, max(t_off) AS t_off FROM m2 GROUP BY session_id, g)
"""

SQL_STATES = SQL_GRID + SQL_SEQ + SQL_CHAIN + SQL_REPLY + """,
cb AS (
  SELECT DISTINCT session_id, unnest(range(CAST(floor(t_on) AS BIGINT), CAST(ceil(t_off - 1e-13::DOUBLE) AS BIGINT))) AS bin FROM mi
),
cells AS (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes),
sb AS (
  SELECT c.session_id, c.bin, b.bin IS NOT NULL AS convo, b.bin IS NULL AS spon
  FROM cells c LEFT JOIN cb b ON b.session_id = c.session_id AND b.bin = c.bin
),
rl AS (
  SELECT session_id, CASE WHEN convo THEN 'convo' ELSE 'spon' END AS state, bin,
    bin - row_number() OVER (PARTITION BY session_id, convo ORDER BY bin) AS g FROM sb
),
sg AS (SELECT session_id, state, min(bin) AS first_bin, max(bin) AS last_bin, min(bin) * 1.0 AS t_on, max(bin) * 1.0 + 1.0 AS t_off FROM rl GROUP BY session_id, state, g)
"""


@query(with_events(SQL_SEQ + "SELECT session_id, round(p_on, 6) AS p_on, round(p_off, 6) AS p_off FROM sq"))
def produced_sequences(spark, sf):
    seq = ST.produced_sequences(T.events(spark, sf), 5.0, CHUNK)
    return seq.select("session_id", F.round("p_on", 6).alias("p_on"), F.round("p_off", 6).alias("p_off"))


@query(with_events(SQL_CHAIN + "SELECT DISTINCT session_id, round(c_on, 6) AS c_on, round(c_last, 6) AS c_last FROM h3"))
def heard_chain_islands(spark, sf):
    chains = ST.heard_chains(ST.heard_instants(T.events(spark, sf)), chunk_s=CHUNK)
    return chains.select("session_id", F.round("c_on", 6).alias("c_on"), F.round("c_last", 6).alias("c_last"))


@query(with_events(SQL_SEQ + SQL_CHAIN + SQL_REPLY + "SELECT session_id, round(p_on, 6) AS p_on, round(c_on, 6) AS c_on FROM seed"))
def produced_lookback(spark, sf):
    ev = T.events(spark, sf)
    seq = ST.produced_sequences(ev, 5.0, CHUNK)
    seeds = ST.chain_starts(seq, ST.heard_instants(ev), 5.0, chunk_s=CHUNK)
    return seeds.select("session_id", F.round("p_on", 6).alias("p_on"), F.round("c_on", 6).alias("c_on"))


@query(with_events(SQL_SEQ + SQL_CHAIN + SQL_REPLY + "SELECT session_id, round(p_on, 6) AS p_on, round(nxt, 6) AS nxt FROM link"))
def reply_links(spark, sf):
    ev = T.events(spark, sf)
    links = ST.reply_links(ST.produced_sequences(ev, 5.0, CHUNK), ST.heard_instants(ev), 5.0, CHUNK)
    return links.select("session_id", F.round("p_on", 6).alias("p_on"), F.round("nxt", 6).alias("nxt"))


@query(with_events(SQL_SEQ + SQL_CHAIN + SQL_REPLY + "SELECT session_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off FROM iv"))
def reply_chain(spark, sf):
    iv = ST.conversation_intervals(T.events(spark, sf), 5.0, 5.0, chunk_s=CHUNK)
    return iv.select("session_id", F.round("t_on", 6).alias("t_on"), F.round("t_off", 6).alias("t_off"))


@query(with_events(SQL_SEQ + SQL_CHAIN + SQL_REPLY + "SELECT session_id, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off FROM mi"))
def interval_merge(spark, sf):
    iv = ST.conversation_intervals(T.events(spark, sf), 5.0, 5.0, chunk_s=CHUNK)
    return ST.merge_intervals(iv, chunk_s=CHUNK).select(
        "session_id", F.round("t_on", 6).alias("t_on"), F.round("t_off", 6).alias("t_off")
    )


@query(with_events(SQL_STATES + "SELECT session_id, bin, convo, spon FROM sb"))
def state_bins(spark, sf):
    n = sizes(spark, sf)
    spans = ST.conversation_bins(T.events(spark, sf), n, DT, 5.0, 5.0, CHUNK)
    return ST.compute_states(spans, n, DT)


@query(with_events(SQL_STATES + "SELECT session_id, state, first_bin, last_bin, t_on, t_off FROM sg"))
def state_segments(spark, sf):
    n = sizes(spark, sf)
    spans = ST.conversation_bins(T.events(spark, sf), n, DT, 5.0, 5.0, CHUNK)
    return ST.state_segments(spans, n, DT)


@query(with_events(SQL_STATES + "SELECT session_id, state, first_bin, last_bin, t_on, t_off FROM sg"))
def state_run_lengths(spark, sf):
    """The same segments from per-bin labels, the form that honours a mask."""
    cells = state_bins(spark, sf).withColumn("state", F.when(F.col("convo"), "convo").when(F.col("spon"), "spon"))
    return ST.run_length_segments(cells, DT)


@query(with_events(SQL_STATES + "SELECT session_id, printf('%.6f\t%.6f\t%s', t_on, t_off, state) AS line FROM sg".replace("\t", "\\t").replace("\\t", "\t")))
def label_track_lines(spark, sf):
    seg = state_segments(spark, sf)
    return seg.select("session_id", L.track_line(F.col("t_on"), F.col("t_off"), F.col("state")).alias("line"))


@query(with_events("""
SELECT a.session_id, a.ev_ord, EXISTS (SELECT 1 FROM ev b WHERE b.session_id = a.session_id AND b.kind = 'produced'
  AND b.t_on >= a.t_on AND b.t_on <= a.t_on + 10.0) AS addressed FROM ev a WHERE a.kind = 'perceived'"""))
def generator_addressed(spark, sf):
    from echogrid.operators.events import mark_addressed

    return mark_addressed(T.events(spark, sf), 10.0, CHUNK).select("session_id", "ev_ord", "addressed")


@query(with_events("""
SELECT session_id, ev_ord, CASE WHEN label = 'view' THEN 'perceived' ELSE 'produced' END AS kind, round(t_on, 6) AS t_on, round(t_off, 6) AS t_off,
  CASE WHEN label = 'view' THEN 'Perceived' ELSE label END AS label FROM ev"""))
def label_text_scan(spark, sf):
    """Events written as track lines and parsed back; views carry a kind as label."""
    from echogrid.sources.labels import parse_lines

    ev = T.events(spark, sf)
    label = F.when(F.col("label") == "view", "Perceived").otherwise(F.col("label"))
    lines = ev.select("session_id", "ev_ord", L.track_line(F.col("t_on"), F.col("t_off"), label).alias("line"))
    out = parse_lines(lines, "produced")
    return out.withColumn("t_on", F.round("t_on", 6)).withColumn("t_off", F.round("t_off", 6))


@query(r"""
SELECT page_id, 's' || coalesce(nullif(regexp_extract(upper(url), 'S(\d+)', 1), ''), nullif(regexp_extract(url, 'S(\d+)', 1), ''), '000') AS slug FROM pages""")
def session_slug(spark, sf):
    pages = T.read(spark, sf, "pages")
    return pages.select("page_id", L.session_slug(F.upper("url"), F.lit(None).cast("string"), F.col("url")).alias("slug"))


@query("""
WITH ev AS (SELECT conv_id AS session_id, turn AS ev_ord, CASE role WHEN 'user' THEN 'perceived' ELSE 'produced' END AS kind,
  turn * 1.0::DOUBLE AS t_on, turn + 0.5::DOUBLE AS t_off FROM conversations),
h AS (SELECT session_id, max(t_on) AS t FROM ev WHERE kind = 'perceived' GROUP BY 1)
SELECT session_id, count(*) FILTER (WHERE kind = 'perceived') AS n_heard, count(*) FILTER (WHERE kind = 'produced') AS n_produced,
  max(CASE WHEN kind = 'produced' THEN t_off END) AS last_reply FROM ev GROUP BY 1""")
def turn_taking_counts(spark, sf):
    """Chat turns as heard and produced calls."""
    ev = conversation_events(spark, sf)
    made = F.col("kind") == "produced"
    return ev.groupBy("session_id").agg(
        F.count_if(~made).alias("n_heard"), F.count_if(made).alias("n_produced"), F.max(F.when(made, F.col("t_off"))).alias("last_reply")
    )


def conversation_events(spark, sf):
    return T.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("ev_ord"),
        F.when(F.col("role") == "user", "perceived").otherwise("produced").alias("kind"),
        F.col("turn").cast("double").alias("t_on"),
        (F.col("turn") + F.lit(0.5)).alias("t_off"),
        F.col("role").alias("label"),
    )


@query("""
WITH RECURSIVE ev AS (SELECT conv_id AS session_id, turn AS ev_ord, CASE role WHEN 'user' THEN 'perceived' ELSE 'produced' END AS kind,
  turn * 1.0::DOUBLE AS t_on, turn + 0.5::DOUBLE AS t_off FROM conversations)""" + SQL_SEQ.replace("> 5.0", "> 0.4").replace("WITH", "") + SQL_CHAIN
  + SQL_REPLY.replace("5.0", "2.0") + "SELECT session_id, t_on, t_off FROM mi")
def turn_taking_conversations(spark, sf):
    """Long reply chains: every answered turn links to the next."""
    iv = ST.conversation_intervals(conversation_events(spark, sf), 2.0, 0.4, chunk_s=16.0)
    return ST.merge_intervals(iv, chunk_s=16.0)
