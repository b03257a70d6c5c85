"""Queries over features, statistics, fits, metrics, histograms and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from echogrid import config as C
from echogrid.operators import basis as B
from echogrid.operators import dsp as D
from echogrid.operators import evaluate as EV
from echogrid.operators import events as E
from echogrid.operators import features as X
from echogrid.operators import fit as FT
from echogrid.operators import grid as G
from echogrid.operators import infer as I
from echogrid.operators import moments as M
from echogrid.operators import objective as O
from echogrid.operators import psth as P
from echogrid.operators import scan
from echogrid.operators import smooth as SM
from echogrid.operators import states as ST
from echogrid.operators import streams as S
from echogrid.plans import plotdata as PD
from echogrid.plans import tables as T
from echogrid.plans.event_queries import CHUNK, DT, SQL_CONTEXT, SQL_GRID, SQL_STATES, SQL_STREAMS, sizes, with_events
from echogrid.runtime import materialize
from echogrid.schema import CONTEXT_STREAMS

QUERIES = {}
ORACLES = {}

CFG = C.merge(
    C.DEFAULTS,
    {
        "dt": DT,
        "heard_window_s": [0, 3],
        "produced_window_s": [-2, 2],
        "history_window_s": [1, 3],
        "heard_basis": {"n_basis": 3},
        "produced_basis": {"n_basis": 3},
        "lfp": {"history_window_s": [1, 3]},
    },
)
LAMBDAS = CFG["cv"]["lambdas"]
KF = CFG["cv"]["k"]
COLMAP = B.column_map(CFG, CONTEXT_STREAMS)
KEYS = ["session_id", "model_id"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def impulses(spark, sf):
    return S.build_streams(T.events(spark, sf), DT, CFG, chunk_s=CHUNK)


def response(spark, sf):
    """Spike counts as the response (session_id, model_id, bin, y)."""
    return G.spike_counts(T.spikes(spark, sf), sizes(spark, sf), DT).select(
        "session_id", F.col("neuron_id").alias("model_id"), "bin", F.col("n").cast("double").alias("y")
    )


def coo(spark, sf):
    return X.design_coo(impulses(spark, sf), response(spark, sf), sizes(spark, sf), COLMAP, parts=T.partitions(spark, sf))


def blocks(spark, sf, k=KF):
    return X.design_blocks(impulses(spark, sf), response(spark, sf), sizes(spark, sf), COLMAP, k)


SQL_COUNTS = """,
yy AS (
  SELECT session_id, CAST(floor(t) AS BIGINT) AS bin, count(*)::DOUBLE AS y
  FROM sp JOIN sizes USING (session_id) WHERE floor(t) < n_bins GROUP BY 1, 2
)
"""

SQL_COO = SQL_GRID + SQL_STREAMS + SQL_COUNTS + """,
hb0 AS (SELECT lag, k, CASE WHEN abs((lag - k * 1.5) / 1.5) <= 1 THEN 0.5 * (cos(pi() * (lag - k * 1.5) / 1.5) + 1) ELSE 0 END AS phi
  FROM (SELECT unnest(range(0, 4)) AS lag), (SELECT unnest(range(0, 3)) AS k)),
pb0 AS (SELECT lag, k, CASE WHEN abs((lag - (k * 2.0 - 2)) / 2.0) <= 1 THEN 0.5 * (cos(pi() * (lag - (k * 2.0 - 2)) / 2.0) + 1) ELSE 0 END AS phi
  FROM (SELECT unnest(range(-2, 3)) AS lag), (SELECT unnest(range(0, 3)) AS k)),
base(stream, first, side) AS (VALUES ('heard_addressed', 0, 'h'), ('heard_overheard', 3, 'h'), ('produced_spontaneous', 6, 'p'),
  ('produced_after_heard', 9, 'p'), ('produced_after_produced', 12, 'p')),
taps AS (
  SELECT stream, lag, first + k AS col, phi FROM base JOIN (
    SELECT 'h' AS side, lag, k, phi / sum(phi) OVER (PARTITION BY k) AS phi FROM hb0
    UNION ALL SELECT 'p', lag, k, phi / sum(phi) OVER (PARTITION BY k) FROM pb0) USING (side) WHERE phi <> 0
),
cell0 AS (
  SELECT session_id, bin + lag AS bin, col, sum(phi) AS val FROM st JOIN taps USING (stream) GROUP BY 1, 2, 3
  UNION ALL
  SELECT session_id, bin + lag, 14 + lag, y FROM yy, (SELECT unnest(range(1, 4)) AS lag)
),
cell AS (SELECT session_id, bin, CAST(col AS INTEGER) AS col, val FROM cell0 JOIN sizes USING (session_id) WHERE bin >= 0 AND bin < n_bins)
"""

# Weights for the fixed-weight queries, as a rule on the column number.
W_SQL = "(((col * 7) % 5) - 2) * 0.1"
SQL_ETA = SQL_COO + f""",
eta AS (SELECT session_id, bin, sum(val * ({W_SQL})) AS eta FROM cell GROUP BY 1, 2),
rows_ AS (
  SELECT session_id, bin, coalesce(eta, 0.0) AS eta, coalesce(y, 0.0) AS y
  FROM eta FULL JOIN yy USING (session_id, bin)
)
"""


def fixed_weight():
    return ((F.col("col") * 7) % 5 - 2) * F.lit(0.1)


def cells_at_w(spark, sf, cells=None):
    """Predictor and response by bin; pass ``cells`` where they are read again, so that both read one shuffle."""
    cells = coo(spark, sf) if cells is None else cells
    return O.with_response(O.linear_predictor(cells, weight=fixed_weight()), response(spark, sf))


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places) + F.lit(0.0))
    return df


# ---- features ----------------------------------------------------------------


def _lagged(spark, sf, stream, lo, hi):
    z = impulses(spark, sf).filter(F.col("stream") == stream).withColumn("val", F.lit(1.0))
    out = X.lag_block(z, lo, hi, ["session_id"]).join(sizes(spark, sf), "session_id")
    return out.filter(F.col("bin") < F.col("n_bins")).select("session_id", "bin", "lag", "val")


def _lag_sql(stream, lo, hi):
    return with_events(SQL_GRID + SQL_STREAMS + f"""
SELECT session_id, bin + lag AS bin, CAST(lag AS INTEGER) AS lag, 1.0::DOUBLE AS val
FROM st JOIN sizes USING (session_id), (SELECT unnest(range({lo}, {hi} + 1)) AS lag)
WHERE stream = '{stream}' AND bin + lag >= 0 AND bin + lag < n_bins""")


@query(_lag_sql("heard_any", 0, 3))
def lag_block_causal(spark, sf):
    return _lagged(spark, sf, "heard_any", 0, 3)


@query(_lag_sql("produced_any", -2, 2))
def lag_block_symmetric(spark, sf):
    return _lagged(spark, sf, "produced_any", -2, 2)


@query(with_events(SQL_GRID + SQL_COUNTS + """
SELECT session_id, bin + lag AS bin, CAST(lag AS INTEGER) AS lag, y AS val
FROM yy JOIN sizes USING (session_id), (SELECT unnest(range(1, 4)) AS lag) WHERE bin + lag < n_bins"""))
def history_block(spark, sf):
    n = sizes(spark, sf)
    lo, hi = C.lag_range([1, 3], DT, "history")
    out = X.lag_block(response(spark, sf).withColumn("val", F.col("y")), lo, hi, ["session_id"])
    return out.join(n, "session_id").filter(F.col("bin") < F.col("n_bins")).select("session_id", "bin", "lag", "val")


@query(with_events(SQL_COO + "SELECT session_id, bin, col, round(val, 6) AS val FROM cell"))
def basis_projection(spark, sf):
    return rounded(coo(spark, sf).drop("model_id"), "val")


@query(with_events(SQL_COO + """
, s AS (SELECT session_id, col, sum(val) AS s, sum(val * val) AS q FROM cell GROUP BY 1, 2),
m AS (SELECT session_id, col, s / n_bins AS mean, sqrt(greatest((q - n_bins * (s / n_bins) * (s / n_bins)) / (n_bins - 1), 0.0)) AS sd
  FROM s JOIN sizes USING (session_id))
SELECT session_id, col, round(mean, 6) AS mean, round(CASE WHEN sd < 1e-10::DOUBLE THEN 1.0 ELSE sd END, 6) AS std FROM m"""))
def design_column_stats(spark, sf):
    n = sizes(spark, sf).withColumnRenamed("n_bins", "n_rows")
    return rounded(X.column_stats(coo(spark, sf).drop("model_id"), n, ["session_id"]), "mean", "std")


@query(with_events(SQL_GRID + SQL_STREAMS + """
, g AS (SELECT session_id, stream, unnest(range(n_bins)) AS bin FROM (SELECT DISTINCT session_id, stream FROM st) JOIN sizes USING (session_id)),
c AS (SELECT g.session_id, g.stream, g.bin, count(st.bin) AS n FROM g LEFT JOIN st ON st.session_id = g.session_id AND st.stream = g.stream AND st.bin = g.bin
  GROUP BY 1, 2, 3)
SELECT session_id, stream, bin, d2 FROM (SELECT session_id, stream, bin, n + lead(n, 1) OVER w + lead(n, 2) OVER w AS hit,
    (n - 2 * lead(n, 1) OVER w + lead(n, 2) OVER w)::DOUBLE AS d2
  FROM c WINDOW w AS (PARTITION BY session_id, stream ORDER BY bin)) WHERE hit > 0"""))
def second_difference(spark, sf):
    """Curvature of each stream's occupancy over the grid; bins without an impulse count as zero."""
    c = impulses(spark, sf).withColumn("n", F.lit(1.0)).join(sizes(spark, sf), "session_id")
    return O.second_difference(c, ["session_id", "stream"], "bin", "n", F.col("n_bins"))


# Raw kernels of eight lags: a block per stream, each with its own lambda.
RAW_LAGS = 8
RAW_MAP = B.ColumnMap(
    [B.Block("intercept", "intercept", 0, 1)]
    + [B.Block(name, "lagged", 1 + RAW_LAGS * i, RAW_LAGS, 0, RAW_LAGS - 1) for i, name in enumerate(["heard_addressed", "heard_overheard", "heard_any", *CONTEXT_STREAMS])],
    DT,
    "spikes",
)
RAW_LAMBDA = {"heard": 4.0, "produced": 0.25}


@query(with_events(SQL_GRID + SQL_STREAMS + SQL_COUNTS + """,
h AS (SELECT session_id, stream, yy.bin - st.bin AS lag, sum(y) AS w FROM st JOIN yy USING (session_id)
  WHERE yy.bin - st.bin BETWEEN 0 AND 7 AND stream <> 'produced_any' GROUP BY 1, 2, 3),
k AS (SELECT e.session_id, e.stream, l.lag, coalesce(w, 0.0) AS w FROM (SELECT DISTINCT session_id, stream FROM h) e
  CROSS JOIN (SELECT unnest(range(8)) AS lag) l LEFT JOIN h ON h.session_id = e.session_id AND h.stream = e.stream AND h.lag = l.lag)
SELECT session_id, stream AS block, round(sum(CASE WHEN stream LIKE 'heard%' THEN 4.0 ELSE 0.25 END * d * d), 6) AS energy FROM (
  SELECT session_id, stream, w - 2 * lead(w, 1) OVER v + lead(w, 2) OVER v AS d
  FROM k WINDOW v AS (PARTITION BY session_id, stream ORDER BY lag)) WHERE d IS NOT NULL GROUP BY 1, 2"""))
def penalty_rows(spark, sf):
    """Smoothness penalty of each session's raw event-to-spike kernels, block by block."""
    z = impulses(spark, sf).filter(F.col("stream").isin([b.name for b in RAW_MAP.lagged])).withColumn("val", F.lit(1.0))
    hits = X.lag_block(z, 0, RAW_LAGS - 1, ["session_id", "stream"]).join(response(spark, sf), ["session_id", "bin"])
    first = F.create_map(*[x for b in RAW_MAP.lagged for x in (F.lit(b.name), F.lit(b.first))])
    w = hits.groupBy(*KEYS, (F.element_at(first, F.col("stream")) + F.col("lag")).alias("col")).agg(F.sum("y").alias("w"))
    energy = O.penalty_energy(w, B.penalty_rows(spark, RAW_MAP, None, RAW_LAMBDA))
    return rounded(energy.select("session_id", "block", "energy"), "energy")


# ---- statistics --------------------------------------------------------------

_GRAM_SQL = with_events(SQL_COO + """
SELECT a.session_id, a.col AS i, b.col AS j, round(sum(a.val * b.val), 6) AS g FROM cell a
JOIN cell b ON a.session_id = b.session_id AND a.bin = b.bin AND a.col <= b.col GROUP BY 1, 2, 3""")


@query(_GRAM_SQL)
def gram_matrix(spark, sf):
    return rounded(M.gram_entries(coo(spark, sf), KEYS).select("session_id", "i", "j", "g"), "g")


def _upper(vec, p):
    """Packed upper triangle as (i, j) pairs."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    return F.arrays_zip(
        F.array(*[F.lit(i) for i, _ in pairs]).alias("i"),
        F.array(*[F.lit(j) for _, j in pairs]).alias("j"),
        vec.alias("g"),
    )


@query(with_events(SQL_COO + """,
f AS (SELECT session_id, bin, CAST(ntile(""" + str(KF) + """) OVER (PARTITION BY session_id ORDER BY bin) - 1 AS INTEGER) AS fold
  FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes))
SELECT a.session_id, f.fold, a.col AS i, b.col AS j, round(sum(a.val * b.val), 6) AS g FROM cell a
JOIN cell b ON a.session_id = b.session_id AND a.bin = b.bin AND a.col <= b.col
JOIN f ON f.session_id = a.session_id AND f.bin = a.bin GROUP BY 1, 2, 3, 4 HAVING abs(sum(a.val * b.val)) > 1e-9"""))
def fold_gram_blocks(spark, sf):
    """Gram per fold from design blocks, the statistic every Gaussian fit reads."""
    p = COLMAP.p
    mom = M.fold_moments(blocks(spark, sf), COLMAP)
    tri = F.slice("vec", 4 + 2 * p, M.packed_size(p))
    each = mom.select("session_id", "fold", F.explode(_upper(tri, p)).alias("c"))
    return rounded(each.select("session_id", "fold", "c.i", "c.j", "c.g").filter(F.abs("g") > 1e-9), "g")


FULL_MAP = B.column_map(C.merge(CFG, {"exclude_predictors": []}), CONTEXT_STREAMS)


@query(with_events(SQL_COO + SQL_STATES.removeprefix(SQL_GRID) + """,
bins AS (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes),
kept AS (SELECT session_id, bin, CAST(ntile(""" + str(KF) + """) OVER (PARTITION BY session_id ORDER BY bin) - 1 AS INTEGER) AS fold
  FROM bins ANTI JOIN (SELECT session_id, bin FROM st WHERE stream = 'produced_any') USING (session_id, bin)),
wide AS (
  SELECT session_id, bin, CASE WHEN col < 15 THEN col + 1 ELSE col + 3 END AS col, val FROM cell
  UNION ALL SELECT session_id, bin, 0, 1.0 FROM bins
  UNION ALL SELECT session_id, bin, CASE WHEN convo THEN 16 ELSE 17 END, 1.0 FROM sb),
w AS (SELECT session_id, fold, bin, CAST(col AS INTEGER) AS col, val FROM wide JOIN kept USING (session_id, bin))
SELECT a.session_id, a.fold, a.col AS i, b.col AS j, round(sum(a.val * b.val), 6) AS g FROM w a
JOIN w b ON a.session_id = b.session_id AND a.bin = b.bin AND a.col <= b.col
WHERE a.session_id IN (SELECT session_id FROM yy) GROUP BY 1, 2, 3, 4 HAVING abs(sum(a.val * b.val)) > 1e-9"""))
def masked_fold_gram(spark, sf):
    """Gram per fold of the whole layout, intercept and states too, over retained bins; bins with a produced onset play the masked ones."""
    n, z, p = sizes(spark, sf), impulses(spark, sf), FULL_MAP.p
    bad = z.filter("stream = 'produced_any'").select("session_id", "bin")
    spans = ST.conversation_bins(T.events(spark, sf), n, DT, 5.0, 5.0, CHUNK)
    blk = X.design_blocks(z, response(spark, sf), n, FULL_MAP, KF, spans, bad)
    tri = F.slice("vec", 4 + 2 * p, M.packed_size(p))
    each = M.fold_moments(blk, FULL_MAP).select("session_id", "fold", F.explode(_upper(tri, p)).alias("c"))
    return rounded(each.select("session_id", "fold", "c.i", "c.j", "c.g").filter(F.abs("g") > 1e-9), "g")


@query(with_events(SQL_COO + """
, s AS (SELECT session_id, col, sum(val) / any_value(n_bins) AS m, any_value(n_bins) AS n,
    sqrt((sum(val * val) - sum(val) * sum(val) / any_value(n_bins)) / (any_value(n_bins) - 1)) AS sd
  FROM cell JOIN sizes USING (session_id) GROUP BY 1, 2),
gg AS (SELECT a.session_id, a.col AS i, b.col AS j, sum(a.val * b.val) AS g FROM cell a
  JOIN cell b ON a.session_id = b.session_id AND a.bin = b.bin AND a.col <= b.col GROUP BY 1, 2, 3)
SELECT a.session_id, a.col AS i, b.col AS j, round((coalesce(g, 0.0) - a.n * a.m * b.m) / (a.sd * b.sd), 6) AS g
FROM s a JOIN s b ON a.session_id = b.session_id AND a.col <= b.col LEFT JOIN gg ON gg.session_id = a.session_id AND gg.i = a.col AND gg.j = b.col"""))
def standardized_gram(spark, sf):
    """Gram of z-scored columns from sums alone, so sparse columns stay sparse."""
    # One model a session; its column stays while cells are paired, as they are dealt by it.
    cells = coo(spark, sf)
    n = sizes(spark, sf).withColumnRenamed("n_bins", "n_rows")
    stats = X.column_stats(cells, n, KEYS).drop("model_id")
    gram = M.gram_entries(cells, KEYS).drop("model_id")
    return rounded(M.standardized_gram(gram, stats, n, ["session_id"]), "g")


@query(with_events(SQL_COO + """
SELECT session_id, col, round(sum(val * y), 6) AS xty FROM cell JOIN yy USING (session_id, bin) GROUP BY 1, 2"""))
def xty(spark, sf):
    return rounded(M.cross_entries(coo(spark, sf), response(spark, sf), KEYS).drop("model_id"), "xty")


@query(with_events(SQL_COO + """,
sh AS (SELECT session_id, n_bins, p AS perm, (p * 37 + 5) % n_bins + 1 AS k FROM sizes, (SELECT unnest(range(20)) AS p))
SELECT c.session_id, CAST(sh.perm AS INTEGER) AS perm, c.col, round(sum(c.val * yy.y), 6) AS xty FROM cell c JOIN sh ON sh.session_id = c.session_id
JOIN yy ON yy.session_id = c.session_id AND yy.bin = (c.bin - sh.k + sh.n_bins) % sh.n_bins GROUP BY 1, 2, 3 HAVING abs(sum(c.val * yy.y)) > 1e-6"""))
def shifted_xty(spark, sf):
    """X'y of responses under twenty circular shifts, as the permutation refits read it."""
    moved = I.all_shifted_cross(blocks(spark, sf), COLMAP, 20, lambda perm, n: (perm * 37 + 5) % n + 1)
    each = moved.select("session_id", "perm", F.posexplode("b").alias("col", "xty"))
    return rounded(each.filter(F.abs("xty") > 1e-6), "xty")


@query(with_events(SQL_GRID + """
SELECT session_id, bin, CAST(ntile(5) OVER (PARTITION BY session_id ORDER BY bin) - 1 AS INTEGER) AS fold
FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes)"""))
def fold_assignment(spark, sf):
    n = sizes(spark, sf)
    return G.grid(n, DT, per=n).select(
        "session_id", "bin", X.fold_expr(F.col("bin"), F.col("n_bins"), 5).alias("fold")
    )


@query(with_events(SQL_GRID + SQL_STREAMS + """
, kept AS (SELECT session_id, bin FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes)
  WHERE (session_id, bin) NOT IN (SELECT (session_id, bin) FROM st WHERE stream = 'heard_any'))
SELECT session_id, bin, row_number() OVER (PARTITION BY session_id ORDER BY bin) - 1 AS row_idx,
  CAST(ntile(5) OVER (PARTITION BY session_id ORDER BY bin) - 1 AS INTEGER) AS fold FROM kept"""))
def masked_fold_assignment(spark, sf):
    """Folds count retained rows; bins with a heard onset play the masked bins."""
    n = sizes(spark, sf)
    bad = impulses(spark, sf).filter("stream = 'heard_any'").select("session_id", "bin")
    kept = G.with_mask(G.grid(n, DT), bad).filter("good")
    ranked = scan.prefix_rank(kept, ["session_id"], "bin", F.floor(F.col("bin") / G.BLOCK_BINS))
    total = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(total, "session_id").select(
        "session_id", "bin", "row_idx", X.fold_expr(F.col("row_idx"), F.col("n"), 5).alias("fold")
    )


@query(with_events(SQL_ETA + """
SELECT session_id, round(sum(exp(eta) - y * eta) + any_value(n_bins) - count(*), 6) AS nll FROM rows_ JOIN sizes USING (session_id) GROUP BY 1"""))
def poisson_nll_at_w(spark, sf):
    return rounded(O.poisson_objective(cells_at_w(spark, sf), sizes(spark, sf)).drop("model_id"), "nll")


@query(with_events(SQL_ETA + """
SELECT session_id, col, round(sum(val * (exp(eta) - y)), 6) AS grad FROM cell JOIN rows_ USING (session_id, bin) GROUP BY 1, 2"""))
def poisson_grad_at_w(spark, sf):
    cells = coo(spark, sf)
    return rounded(O.gradient(cells, cells_at_w(spark, sf, cells)).drop("model_id"), "grad")


@query(with_events(SQL_ETA + """
SELECT a.session_id, a.col AS i, b.col AS j, round(sum(exp(eta) * a.val * b.val), 6) AS h FROM cell a
JOIN cell b ON a.session_id = b.session_id AND a.bin = b.bin AND a.col <= b.col
JOIN rows_ r ON r.session_id = a.session_id AND r.bin = a.bin GROUP BY 1, 2, 3"""))
def poisson_hessian_at_w(spark, sf):
    cells = coo(spark, sf)
    return rounded(O.weighted_gram(cells, cells_at_w(spark, sf, cells)).drop("model_id"), "h")


@query(with_events(SQL_ETA + """
SELECT session_id, round(sum(0.5 * (y - eta) * (y - eta)), 6) AS identity_nll,
  round(sum(0.5 * (y - exp(eta)) * (y - exp(eta))) + 0.5 * (any_value(n_bins) - count(*)), 6) AS log_nll
FROM rows_ JOIN sizes USING (session_id) GROUP BY 1"""))
def gaussian_obj_at_w(spark, sf):
    cells, n = cells_at_w(spark, sf), sizes(spark, sf)
    a = O.gaussian_objective(cells, n).withColumnRenamed("nll", "identity_nll")
    b = O.gaussian_objective(cells, n, "log").withColumnRenamed("nll", "log_nll")
    return rounded(a.join(b, KEYS).drop("model_id"), "identity_nll", "log_nll")


@query(with_events(SQL_ETA + """
SELECT session_id, col, round(sum(val * (exp(eta) - y) * exp(eta)), 6) AS grad FROM cell JOIN rows_ USING (session_id, bin) GROUP BY 1, 2"""))
def gaussian_log_grad_at_w(spark, sf):
    cells = coo(spark, sf)
    return rounded(O.gradient(cells, cells_at_w(spark, sf, cells), "gauss_log").drop("model_id"), "grad")


@query(with_events(SQL_ETA + """
SELECT c.session_id, c.bin, round(coalesce(eta, 0.0), 6) AS identity_mu, round(exp(coalesce(eta, 0.0)), 6) AS log_mu
FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes) c
LEFT JOIN eta e ON e.session_id = c.session_id AND e.bin = c.bin WHERE c.session_id IN (SELECT session_id FROM yy)"""))
def predict_signal_at_w(spark, sf):
    """Signals predicted from design blocks at given weights, with either link."""
    w = F.array(*[F.lit(((c * 7) % 5 - 2) * 0.1) for c in range(COLMAP.p)])
    blk = blocks(spark, sf)
    weights = blk.select(*KEYS).distinct().withColumn("w", w)
    each = [FT.predict(blk, weights, COLMAP, k).select("session_id", "bin", F.col("mu").alias(f"{k}_mu")) for k in ("identity", "log")]
    return rounded(each[0].join(each[1], ["session_id", "bin"]), "identity_mu", "log_mu")


@query(with_events(SQL_ETA + """
SELECT c.session_id, c.bin, round(exp(coalesce(eta, 0.0)), 6) AS mu FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes) c
LEFT JOIN eta e ON e.session_id = c.session_id AND e.bin = c.bin WHERE c.session_id IN (SELECT session_id FROM yy)"""))
def predict_rate_at_w(spark, sf):
    eta = O.linear_predictor(coo(spark, sf), weight=fixed_weight())
    models = response(spark, sf).select(*KEYS).distinct()
    return rounded(O.predict_bins(eta, G.grid(sizes(spark, sf), DT, per=models)).drop("model_id"), "mu")


@query(with_events(SQL_COO + """
, w AS (SELECT session_id, col, sum(val * y) AS w FROM cell JOIN yy USING (session_id, bin) GROUP BY 1, 2),
tp AS (SELECT stream, first, lag, k, phi FROM base JOIN (
    SELECT 'h' AS side, lag, k, phi / sum(phi) OVER (PARTITION BY k) AS phi FROM hb0
    UNION ALL SELECT 'p', lag, k, phi / sum(phi) OVER (PARTITION BY k) FROM pb0) USING (side))
SELECT s.session_id, t.stream AS block, CAST(t.lag AS INTEGER) AS lag_bin, round(sum(t.phi * coalesce(w.w, 0.0)), 6) AS weight
FROM (SELECT DISTINCT session_id FROM yy) s CROSS JOIN tp t LEFT JOIN w ON w.session_id = s.session_id AND w.col = t.first + t.k GROUP BY 1, 2, 3
UNION ALL
SELECT s.session_id, 'spike_history', CAST(l.lag AS INTEGER), round(coalesce(w.w, 0.0), 6) AS weight
FROM (SELECT DISTINCT session_id FROM yy) s CROSS JOIN (SELECT unnest(range(1, 4)) AS lag) l LEFT JOIN w ON w.session_id = s.session_id AND w.col = 14 + l.lag"""))
def unpack_kernel(spark, sf):
    """Kernels of the weights X'y, expanded from basis to lags."""
    p = COLMAP.p
    mom = M.fold_moments(blocks(spark, sf), COLMAP).select(*KEYS, F.slice("vec", 4 + p, p).alias("vec"))
    w = M.sum_vectors(mom, KEYS).withColumnRenamed("vec", "w")
    k = FT.unpack_kernels(w, COLMAP)
    return rounded(k.select("session_id", "block", "lag_bin", "weight"), "weight")


# ---- fits --------------------------------------------------------------------


def _gauss(spark, sf, standardize=True):
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    mom = materialize(M.fold_moments(blocks(spark, sf), COLMAP))
    return FT.gauss_cv_fit(mom, COLMAP, d, LAMBDAS, standardize), mom


def _poisson(spark, sf):
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    blk = materialize(blocks(spark, sf))
    mom = materialize(M.fold_moments(blk, COLMAP))
    return FT.poisson_cv_fit(blk, mom, COLMAP, d, LAMBDAS, CFG["optimizer"]), blk


_ZERO_SQL = with_events(SQL_GRID + SQL_COUNTS + """
SELECT session_id, CAST(col AS INTEGER) AS col, 0.0::DOUBLE AS residual
FROM (SELECT DISTINCT session_id FROM yy), (SELECT unnest(range(0, 18)) AS col)""")


def _penalty_rows(spark, w, lam_factor):
    """lam * factor * D'Dw per (session, col) from weights (session, lam, w)."""
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    dtd = d.T @ d
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in dtd])
    each = w.select("session_id", "lam", "w", F.posexplode(rows).alias("col", "_r"))
    return each.select("session_id", "col", (F.col("lam") * lam_factor * FT.dot("_r", "w")).alias("pen"))


@query(_ZERO_SQL)
def gauss_fit_residual(spark, sf):
    """Normal equations at the fitted weights, rebuilt from the long form: zero."""
    (fits, _), _ = _gauss(spark, sf, standardize=False)
    w = materialize(fits.select(*KEYS, F.col("best_lambda").alias("lam"), "w"))
    long = w.select(*KEYS, F.posexplode("w").alias("col", "w"))
    cells = coo(spark, sf)
    fitted = O.with_response(O.linear_predictor(cells, long), response(spark, sf))
    grad = O.gradient(cells, fitted, "identity")
    pen = _penalty_rows(spark, w, 1.0)
    out = pen.join(grad.drop("model_id"), ["session_id", "col"], "left")
    return out.select(
        "session_id", "col", (F.round(F.coalesce("grad", F.lit(0.0)) + F.col("pen"), 5) + F.lit(0.0)).alias("residual")
    )


def _scaled_slope(spark, sf, fits, family):
    """Penalised gradient at fitted weights by the long form, over that at the start."""
    w = materialize(fits.select(*KEYS, "lam", F.col("w_best").alias("w"), "g_start"))
    long = w.select(*KEYS, F.posexplode("w").alias("col", "w"))
    cells = coo(spark, sf)
    fitted = O.with_response(O.linear_predictor(cells, long), response(spark, sf))
    grad = O.gradient(cells, fitted, family)
    pen = _penalty_rows(spark, w, 2.0).join(w.select("session_id", "g_start"), "session_id")
    out = pen.join(grad.drop("model_id"), ["session_id", "col"], "left")
    slope = (F.coalesce("grad", F.lit(0.0)) + F.col("pen")) / (1 + F.col("g_start"))
    return out.select("session_id", "col", (F.round(slope, 4) + F.lit(0.0)).alias("residual"))


@query(_ZERO_SQL)
def poisson_fit_residual(spark, sf):
    """Penalised Poisson gradient at the fitted weights, relative to the start: zero."""
    (fits, _), _ = _poisson(spark, sf)
    return _scaled_slope(spark, sf, fits, "poisson")


@query()
def glm_fit_gauss(spark, sf):
    (fits, _), _ = _gauss(spark, sf)
    return fits.select(*KEYS, "n_rows", "best_lambda", F.round("nll", 6).alias("nll"), F.size("w").alias("n_params"))


@query()
def glm_cv_gauss(spark, sf):
    (_, cv), _ = _gauss(spark, sf)
    return cv


@query()
def glm_fit_poisson(spark, sf):
    (fits, _), _ = _poisson(spark, sf)
    return fits.select(*KEYS, "lam", F.round("f_best", 6).alias("nll"), "iters", "converged")


@query()
def glm_predictions(spark, sf):
    """Fitted rates and their metrics per model."""
    (fits, _), blk = _poisson(spark, sf)
    rows = FT.predict(blk, fits.select(*KEYS, F.col("w_best").alias("w")), COLMAP)
    return rounded(EV.poisson_metrics(rows, KEYS), "nll", "pseudoR2", "deviance_explained", places=5)


def _verdicts(p, intervals):
    """One row per block and lag: the block's p value and the interval of its null weights."""
    return rounded(p.join(intervals, [*KEYS, "block"]), "p_value", "ci_lower", "ci_upper")


@query()
def permutation_test_gauss(spark, sf):
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    blk = materialize(blocks(spark, sf))
    mom = materialize(M.fold_moments(blk, COLMAP))
    fits = materialize(FT.gauss_cv_fit(mom, COLMAP, d, LAMBDAS)[0])
    nulls = materialize(I.gauss_nulls(fits, I.all_shifted_cross(blk, COLMAP, C.N_PERMUTATIONS, I.seeded(CFG["seed"])), COLMAP, d))
    return _verdicts(*I.permutation_test(fits, nulls, COLMAP))


@query()
def permutation_test_poisson(spark, sf):
    """Null refits of the Poisson model, with how many of them met the tolerance."""
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    (fits, _), blk = _poisson(spark, sf)
    fits = materialize(fits.select(*KEYS, "lam", F.col("w_best").alias("w")))
    cross = I.all_shifted_cross(blk, COLMAP, C.N_PERMUTATIONS, I.seeded(CFG["seed"]))
    nulls = materialize(I.poisson_nulls(blk, cross, fits.drop("w"), COLMAP, d, CFG["optimizer"]))
    return _verdicts(*I.permutation_test(fits, nulls, COLMAP)).join(I.unsettled(nulls), KEYS)


# ---- evaluation and inference ------------------------------------------------


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber - 1 AS i, avg(m) AS mean FROM (
  SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT l_suppkey AS model_id, CAST(arg_min(i, (mean, i)) AS DOUBLE) AS best_lambda, round(min(mean), 6) AS mean_metric FROM m GROUP BY 1""")
def cv_choose_lambda(spark, sf):
    """Line numbers play the lambdas, return flags the folds."""
    cv = T.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.avg("l_discount").alias("metric"))
    cv = cv.select(
        F.col("l_suppkey").alias("model_id"), (F.col("l_linenumber") - 1).alias("lambda_idx"),
        (F.col("l_linenumber") - 1).cast("double").alias("lambda"), "metric",
    )
    return rounded(FT.choose_lambda(cv, ["model_id"]), "mean_metric")


@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber::DOUBLE AS y, greatest(l_quantity / 10.0::DOUBLE, 2.220446049250313e-16) AS mu FROM lineitem),
s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(y) AS sy, sum(mu - y * ln(mu) + lgamma(y + 1)) AS nll,
  sum(y * ln(mu) - mu) AS model, sum(y * ln(y) - y) AS sat FROM r GROUP BY 1, 2),
t AS (SELECT *, sy * ln(sy / n) - sy AS nul FROM s)
SELECT l_returnflag, l_linestatus, round(nll, 4) AS nll, round(1 - (sat - model) / (sat - nul), 6) AS "pseudoR2",
  round(1 - (2 * (sat - model)) / (2 * (sat - nul)), 6) AS deviance_explained FROM t""")
def poisson_metrics(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 10.0).alias("mu")
    )
    m = EV.poisson_metrics(rows, ["l_returnflag", "l_linestatus"])
    return rounded(m.withColumn("nll", F.round("nll", 4)), "pseudoR2", "deviance_explained")


_SIGNAL_SQL = """
WITH r AS (SELECT {k}, l_extendedprice / 10000.0::DOUBLE AS y, l_quantity / 10.0::DOUBLE AS p FROM lineitem),
s AS (SELECT {k}, count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_samp(y) AS vy, var_samp(y - p) AS vr, corr(y, p) AS c FROM r GROUP BY {k})
"""


@query(_SIGNAL_SQL.format(k="l_returnflag, l_linestatus") + """
SELECT l_returnflag, l_linestatus, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(1 - mse * n / (vy * (n - 1)), 6) AS r2,
  round(c, 6) AS correlation, round(mae, 6) AS mae, round(1 - vr / vy, 6) AS explained_variance FROM s""")
def signal_metrics(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 10000.0).alias("y"), (F.col("l_quantity") / 10.0).alias("mu")
    )
    m = EV.signal_metrics(rows, ["l_returnflag", "l_linestatus"])
    return rounded(m, "mse", "rmse", "r2", "correlation", "mae", "explained_variance")


@query(_SIGNAL_SQL.format(k="l_linestatus, l_suppkey") + """
, q AS (SELECT l_linestatus, 1 - mse * n / (vy * (n - 1)) AS r2 FROM s)
SELECT l_linestatus, count(*) AS n_channels, round(avg(r2), 6) AS mean_r2, round(quantile_cont(r2, 0.5), 6) AS median_r2 FROM q GROUP BY 1""")
def channel_r2_summary(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(
        "l_linestatus", "l_suppkey", (F.col("l_extendedprice") / 10000.0).alias("y"), (F.col("l_quantity") / 10.0).alias("mu")
    )
    m = EV.signal_metrics(rows, ["l_linestatus", "l_suppkey"])
    return rounded(EV.channel_r2_summary(m, ["l_linestatus"]), "mean_r2", "median_r2")


@query("""
WITH n AS (SELECT l_suppkey AS block, l_linenumber AS perm, max(abs(l_discount - 0.05)) AS peak FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_suppkey AS block, max(abs(l_tax - 0.03)) AS real_peak FROM lineitem GROUP BY 1)
SELECT block, round(avg(CASE WHEN peak >= real_peak THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM n JOIN r USING (block) GROUP BY 1""")
def perm_pvalue(spark, sf):
    li = T.read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "block")
    nulls = li.select("block", F.col("l_linenumber").alias("perm"), (F.col("l_discount") - 0.05).alias("weight"))
    real = li.select("block", (F.col("l_tax") - 0.03).alias("weight"))
    return rounded(I.permutation_p(real, I.null_peaks(nulls, ["block"]), ["block"]), "p_value")


@query("""
WITH g AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, v, len(v) AS n, least(greatest(len(v) * 0.025 + 0.5, 1.0), len(v))::DOUBLE AS a, least(greatest(len(v) * 0.975 + 0.5, 1.0), len(v))::DOUBLE AS b FROM g)
SELECT l_orderkey, round(v[floor(a)::INT] + (a - floor(a)) * (v[least(floor(a)::INT + 1, n)] - v[floor(a)::INT]), 6) AS ci_lower,
  round(v[floor(b)::INT] + (b - floor(b)) * (v[least(floor(b)::INT + 1, n)] - v[floor(b)::INT]), 6) AS ci_upper FROM r""")
def percentile_ci(spark, sf):
    ci = I.percentile_interval(T.read(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice")
    return rounded(ci, "ci_lower", "ci_upper")


SQL_PVALUES = """
WITH p AS (SELECT l_suppkey AS session_id, l_returnflag AS model_id, l_orderkey || '/' || l_linenumber AS block, l_discount AS p_value FROM lineitem)
, r AS (SELECT session_id, model_id, count(*) AS n_kernels, count(*) FILTER (WHERE p_value < 0.05) AS n_significant,
  coalesce(string_agg(block, ',' ORDER BY block) FILTER (WHERE p_value < 0.05), '') AS hits FROM p GROUP BY 1, 2)
"""


def _rollup(spark, sf):
    """Suppliers play the sessions, return flags the models, order lines the kernels."""
    p = T.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), F.col("l_returnflag").alias("model_id"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("block"), F.col("l_discount").alias("p_value"),
    )
    return EV.significance_rollup(p, KEYS)


@query(SQL_PVALUES + "SELECT * FROM r")
def significance_rollup(spark, sf):
    return _rollup(spark, sf).withColumn("hits", F.array_join("hits", ","))


@query(SQL_PVALUES + """
SELECT session_id, count(*) AS n_models, count(*) FILTER (WHERE n_significant > 0) AS n_models_hit,
  coalesce(string_agg(model_id, ',' ORDER BY model_id) FILTER (WHERE n_significant > 0), '') AS models_hit,
  CAST(sum(n_kernels) AS BIGINT) AS n_kernels, CAST(sum(n_significant) AS BIGINT) AS n_significant FROM r GROUP BY 1""")
def significance_totals(spark, sf):
    totals = EV.significance_totals(_rollup(spark, sf), ["session_id"])
    return totals.withColumn("models_hit", F.array_join("models_hit", ","))


@query(with_events(SQL_GRID + SQL_COUNTS + """
SELECT session_id, (bin + (session_id * 37 + 11) % n_bins + 1) % n_bins AS bin, y FROM yy JOIN sizes USING (session_id)"""))
def circular_shift(spark, sf):
    rows = response(spark, sf).join(sizes(spark, sf), "session_id")
    n = F.col("n_bins")
    out = I.circular_shift(rows, (F.col("session_id") * 37 + 11) % n + 1, n, "bin")
    return out.select("session_id", "bin", "y")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS weight_norm FROM embeddings")
def weight_norm(spark, sf):
    w = T.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    return rounded(EV.weight_norm(w, ["vec_id"]), "weight_norm")


# ---- peri-event histograms ---------------------------------------------------

WINDOW = (-3.0, 3.5)
BIN = 1.0

SQL_PSTH = """,
edges AS (SELECT i AS bin, -3.0 + i AS lo, least(-2.0 + i, 3.5) AS hi FROM (SELECT unnest(range(0, 7)) AS i)),
cnt AS (
  SELECT e.session_id, e.ev_ord, e.kind, b.bin, count(s.t) AS n FROM (SELECT * FROM ev WHERE session_id IN (SELECT session_id FROM sp)) e CROSS JOIN edges b
  LEFT JOIN sp s ON s.session_id = e.session_id AND s.t - e.t_on >= b.lo AND s.t - e.t_on < b.hi GROUP BY 1, 2, 3, 4
)
"""


def peri_counts(spark, sf):
    return P.align_spikes(T.spikes(spark, sf), T.events(spark, sf), WINDOW, BIN, ["kind"], CHUNK, T.partitions(spark, sf))


@query(with_events(SQL_PSTH + "SELECT session_id, ev_ord, kind, CAST(bin AS INTEGER) AS bin, n FROM cnt"))
def psth_counts(spark, sf):
    return peri_counts(spark, sf).drop("neuron_id")


_PSTH_MEAN = "SELECT kind, CAST(bin AS INTEGER) AS bin, count(*) AS n_trials, avg({v}) AS mean, coalesce(stddev_samp({v}) / sqrt(count(*)), 0.0) AS sem FROM {t} GROUP BY 1, 2"


@query(with_events(SQL_PSTH + "SELECT kind, bin, n_trials, round(mean, 6) AS mean, round(sem, 6) AS sem FROM (" + _PSTH_MEAN.format(v="n / 1.0", t="cnt") + ")"))
def psth_mean_sem(spark, sf):
    return rounded(P.psth(peri_counts(spark, sf), BIN, ["kind"]), "mean", "sem")


@query(with_events(SQL_PSTH + """
, z AS (SELECT kind, bin, CASE WHEN coalesce(stddev_samp(n) OVER w, 0) = 0 THEN 0.0 ELSE (n - avg(n) OVER w) / stddev_samp(n) OVER w END AS z
  FROM cnt WINDOW w AS (PARTITION BY session_id, ev_ord))
SELECT kind, bin, n_trials, round(mean, 6) AS mean, round(sem, 6) AS sem FROM (""" + _PSTH_MEAN.format(v="z", t="z") + ")"))
def psth_zscore(spark, sf):
    return rounded(P.psth(peri_counts(spark, sf), BIN, ["kind"], zscore=True), "mean", "sem")


@query(with_events(SQL_PSTH + ", m AS (" + _PSTH_MEAN.format(v="n / 1.0", t="cnt") + """)
SELECT kind, bin, round(avg(mean) OVER w, 6) AS mean_plot, round(avg(sem) OVER w, 6) AS sem_plot FROM m
WINDOW w AS (PARTITION BY kind ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def moving_mean(spark, sf):
    s = P.smoothed_psth(P.psth(peri_counts(spark, sf), BIN, ["kind"]), ["kind"])
    return rounded(s.select("kind", "bin", "mean_plot", "sem_plot"), "mean_plot", "sem_plot")


@query(with_events(SQL_CONTEXT + """
, k AS (SELECT session_id, ev_ord, stream FROM pk UNION ALL SELECT session_id, ev_ord, 'heard' FROM ev WHERE kind = 'perceived')
""" + SQL_PSTH + ", j AS (SELECT k.stream AS kind, c.bin, c.n FROM cnt c JOIN k USING (session_id, ev_ord)) SELECT kind AS panel, bin, n_trials, round(mean, 6) AS mean, round(sem, 6) AS sem FROM (" + _PSTH_MEAN.format(v="n / 1.0", t="j") + ")"))
def psth_panels(spark, sf):
    """One panel per produced category plus all heard events."""
    ev = T.events(spark, sf)
    cls = E.label_events(ev, E.produced_context(E.instants(ev), chunk_s=CHUNK), "produced")
    heard = E.select_kind(ev, "perceived").withColumn("stream", F.lit("heard"))
    tagged = heard.unionByName(cls).withColumnRenamed("stream", "panel")
    c = P.align_spikes(T.spikes(spark, sf), tagged, WINDOW, BIN, ["panel"], CHUNK, T.partitions(spark, sf))
    return rounded(P.psth(c, BIN, ["panel"]), "mean", "sem")


@query(with_events(SQL_GRID + SQL_COUNTS + """
, g AS (SELECT i - 6 AS o, exp(-0.5 * power((i - 6) / 2.0, 2)) AS g FROM (SELECT unnest(range(0, 13)) AS i)),
gn AS (SELECT o, g / (SELECT sum(g) FROM g) AS g FROM g),
c AS (SELECT session_id, unnest(range(6, n_bins - 6, 5)) AS bin FROM sizes WHERE n_bins > 12)
SELECT c.session_id, c.bin, round(sum(y * g), 6) AS y FROM c JOIN yy ON yy.session_id = c.session_id AND abs(yy.bin - c.bin) <= 6
JOIN gn ON gn.o = yy.bin - c.bin GROUP BY 1, 2"""))
def rate_smooth_decimate(spark, sf):
    out = SM.smooth_decimate(response(spark, sf), sizes(spark, sf), DT, ["session_id"], ["y"], 2.0, 5.0)
    return rounded(out, "y")


# ---- signals -----------------------------------------------------------------

FS, T0, SIG_DT = 4.0, 0.5, 0.3

SQL_SIGNAL = """
WITH sg AS (SELECT label::BIGINT AS session_id, vec_id::VARCHAR AS channel_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
"""
SQL_RESAMPLED = SQL_SIGNAL + """,
nb AS (SELECT CAST(floor((0.5 + (max(i)) / 4.0) / 0.3 + 1e-9) AS BIGINT) + 1 AS n FROM sg),
gx AS (SELECT bin, (bin * 0.3::DOUBLE - 0.5) * 4.0 AS x FROM (SELECT unnest(range(0, (SELECT n FROM nb))) AS bin)),
rs AS (
  SELECT a.session_id, a.channel_id, g.bin, a.v + (g.x - floor(g.x)) * (coalesce(b.v, a.v) - a.v) AS v
  FROM gx g JOIN sg a ON a.i = floor(g.x) LEFT JOIN sg b ON b.session_id = a.session_id AND b.channel_id = a.channel_id AND b.i = a.i + 1
  WHERE g.x >= 0 AND g.x <= (SELECT max(i) FROM sg)
),
dn AS (
  SELECT c.session_id, c.channel_id, g.bin, coalesce(rs.v, 0.0) AS v
  FROM (SELECT DISTINCT session_id, channel_id FROM sg) c CROSS JOIN gx g
  LEFT JOIN rs ON rs.session_id = c.session_id AND rs.channel_id = c.channel_id AND rs.bin = g.bin
)
"""


def signal_meta(spark, sf):
    """Length and sampling of each session's channels."""
    from echogrid.sources.signal import signal_meta as meta

    return meta(T.signal(spark, sf), FS, T0)


def signal_sizes(spark, sf):
    """Bins up to the last sample of each session."""
    end = F.col("t0") + F.col("duration")
    return signal_meta(spark, sf).select("session_id", (F.floor(end / SIG_DT + 1e-9) + 1).cast("long").alias("n_bins"))


def on_grid(spark, sf, rows):
    """Rows whose bin lies on the session's grid."""
    return rows.join(signal_sizes(spark, sf), "session_id").filter(F.col("bin") < F.col("n_bins")).drop("n_bins")


def resampled(spark, sf):
    return SM.resample_linear(T.signal(spark, sf), signal_meta(spark, sf), signal_sizes(spark, sf), SIG_DT, D.CHANNEL)


def dense_binned(spark, sf, mode):
    cfg = {"lfp": {"normalize": mode}}
    return D.bin_signal(T.signal(spark, sf), signal_meta(spark, sf), signal_sizes(spark, sf), SIG_DT, FS, cfg)


@query(SQL_SIGNAL + "SELECT session_id, max(i) + 1 AS n_samples, count(DISTINCT channel_id) AS n_channels, 63 / 4.0 AS duration FROM sg GROUP BY 1")
def signal_meta_scan(spark, sf):
    return signal_meta(spark, sf).select("session_id", "n_samples", "n_channels", "duration")


@query(SQL_RESAMPLED + "SELECT session_id, channel_id, bin, round(v, 6) AS v FROM rs")
def resample_linear(spark, sf):
    return rounded(resampled(spark, sf), "v")


@query(SQL_RESAMPLED + """
SELECT session_id, channel_id, bin, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS v FROM dn
WINDOW w AS (PARTITION BY session_id, channel_id)""")
def normalize_zscore(spark, sf):
    return rounded(dense_binned(spark, sf, "zscore"), "v")


@query(SQL_RESAMPLED + """
SELECT session_id, channel_id, bin, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM dn
WINDOW w AS (PARTITION BY session_id, channel_id)""")
def normalize_minmax(spark, sf):
    return rounded(dense_binned(spark, sf, "minmax"), "v")


@query(SQL_RESAMPLED + """
SELECT session_id, channel_id, bin + lag AS bin, CAST(lag AS INTEGER) AS lag, round(v, 6) AS val
FROM rs, (SELECT unnest(range(1, 4)) AS lag) WHERE bin + lag < (SELECT n FROM nb)""")
def lfp_history(spark, sf):
    """Raw lags of a binned signal."""
    z = resampled(spark, sf).withColumnRenamed("v", "val")
    return rounded(on_grid(spark, sf, X.lag_block(z, 1, 3, D.CHANNEL)), "val")


@query(SQL_RESAMPLED + """
, b0 AS (SELECT lag, k, CASE WHEN abs(lag - (1 + k * 9.0 / 7)) <= 18.0 / 7 THEN 0.5 * (cos(pi() * (lag - (1 + k * 9.0 / 7)) / (18.0 / 7)) + 1) ELSE 0 END AS phi
  FROM (SELECT unnest(range(1, 11)) AS lag), (SELECT unnest(range(0, 8)) AS k)),
b AS (SELECT lag, k, phi / sum(phi) OVER (PARTITION BY k) AS phi FROM b0)
SELECT session_id, channel_id, bin + lag AS bin, CAST(k AS INTEGER) AS col, round(sum(v * phi), 6) AS val FROM rs, b
WHERE k < 7 AND bin + lag < (SELECT n FROM nb) GROUP BY 1, 2, 3, 4 HAVING abs(sum(v * phi)) > 1e-7""")
def lfp_history_basis(spark, sf):
    """Signal history on its own wide cosine basis (last column dropped)."""
    import numpy as np

    taps = B.signal_history_basis(np.arange(1, 11) * SIG_DT)
    blk = B.Block("lfp_history", "history", 0, taps.shape[1], 1, 10, taps)
    parts, n = T.partitions(spark, sf, "embeddings", 2_500), signal_sizes(spark, sf)
    z = SM.resample_linear(T.signal(spark, sf), signal_meta(spark, sf), n, SIG_DT, D.CHANNEL, parts)
    z = z.join(n, "session_id").withColumnRenamed("v", "val").withColumn("stream", F.lit("lfp_history"))
    out = X.project_basis(z, X.taps_frame(spark, [blk]), [*D.CHANNEL, "n_bins"], parts)
    return rounded(out.filter(F.col("bin") < F.col("n_bins")).drop("n_bins").filter(F.abs("val") > 1e-7), "val")


@query(SQL_RESAMPLED + "SELECT session_id, channel_id, round(stddev_samp(v), 6) AS std, round(max(abs(v)), 6) AS peak FROM rs GROUP BY 1, 2")
def dead_signal_guard(spark, sf):
    from echogrid.operators.validate import dead_signal_report

    return rounded(dead_signal_report(resampled(spark, sf)), "std", "peak")


@query(SQL_SIGNAL + """
SELECT a.session_id, a.channel_id, a.i AS sample_idx, round(sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.v * (2.0 / 64) / tan(pi() * (a.i - b.i) / 64.0) ELSE 0.0 END), 6) AS v
FROM sg a JOIN sg b ON a.session_id = b.session_id AND a.channel_id = b.channel_id GROUP BY 1, 2, 3""")
def hilbert_transform(spark, sf):
    """Imaginary part of the analytic signal, against direct circular convolution."""
    return rounded(D.hilbert(T.signal(spark, sf), signal_meta(spark, sf)), "v")


@query(SQL_SIGNAL + """,
e AS (
  SELECT session_id, channel_id, i + 12 AS j, v FROM sg
  UNION ALL SELECT a.session_id, a.channel_id, 12 - a.i, 2 * b.v - a.v FROM sg a JOIN sg b ON b.session_id = a.session_id AND b.channel_id = a.channel_id AND b.i = 0 WHERE a.i BETWEEN 1 AND 12
  UNION ALL SELECT a.session_id, a.channel_id, 12 + 126 - a.i, 2 * b.v - a.v FROM sg a JOIN sg b ON b.session_id = a.session_id AND b.channel_id = a.channel_id AND b.i = 63 WHERE a.i BETWEEN 51 AND 62
),
f AS (SELECT session_id, channel_id, j, (sum(v) OVER w + (5 - count(*) OVER w) * first_value(v) OVER (PARTITION BY session_id, channel_id ORDER BY j)) / 5 AS v FROM e
  WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY j ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
g AS (SELECT session_id, channel_id, j, (sum(v) OVER w + (5 - count(*) OVER w) * first_value(v) OVER (PARTITION BY session_id, channel_id ORDER BY j DESC)) / 5 AS v FROM f
  WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY j DESC ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT session_id, channel_id, j - 12 AS sample_idx, round(v, 6) AS v FROM g WHERE j BETWEEN 12 AND 75""")
def envelope_smoothing(spark, sf):
    """Forward-backward box of five samples with reflected ends."""
    return rounded(D.box_filtfilt(T.signal(spark, sf), signal_meta(spark, sf), 5), "v")


@query()
def band_power(spark, sf):
    """Band-pass, envelope and smoothing of every channel."""
    cfg = {"lfp": {"bandpass_hz": [0.4, 1.2], "extract_band_power": True, "power_smoothing_ms": 1250}}
    return rounded(D.band_power(T.signal(spark, sf), signal_meta(spark, sf), FS, cfg), "v")


@query()
def drift_removal(spark, sf):
    return rounded(D.remove_drift(dense_binned(spark, sf, "zscore"), signal_sizes(spark, sf), SIG_DT), "v")


# ---- figure data -------------------------------------------------------------


@query(with_events(SQL_COO + """
SELECT session_id, bin, col, round(val, 6) AS val,
  CASE WHEN col >= 15 THEN 'spike_history lag ' || (col - 14) || '.000s'
    ELSE (SELECT any_value(stream) FROM base WHERE col >= first AND col < first + 3) || ' basis ' || (col % 3 + 1) END AS label FROM cell"""))
def design_preview(spark, sf):
    return rounded(PD.design_preview(coo(spark, sf), COLMAP).drop("model_id"), "val")


@query("""
SELECT l_suppkey AS model_id, l_linenumber - 1 AS lambda_idx, round(avg(m), 6) AS mean_metric, round(min(m), 6) AS lo, round(max(m), 6) AS hi
FROM (SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def cv_curve(spark, sf):
    cv = T.read(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.avg("l_discount").alias("metric"))
    cv = cv.select(
        F.lit(0).alias("session_id"), F.col("l_suppkey").alias("model_id"), (F.col("l_linenumber") - 1).alias("lambda_idx"),
        F.col("l_linenumber").cast("double").alias("lambda"), "metric",
    )
    return rounded(PD.cv_curve(cv).drop("session_id", "lambda"), "mean_metric", "lo", "hi")


@query(with_events(SQL_ETA + """
SELECT c.session_id, c.bin * 1.0 AS t, coalesce(y, 0.0) AS observed_hz, round(exp(coalesce(eta, 0.0)), 6) AS predicted_hz
FROM (SELECT session_id, unnest(range(n_bins)) AS bin FROM sizes) c LEFT JOIN rows_ r ON r.session_id = c.session_id AND r.bin = c.bin
WHERE c.session_id IN (SELECT session_id FROM yy) AND c.bin >= 100 AND c.bin <= 220"""))
def prediction_window(spark, sf):
    resp = response(spark, sf)
    cells = G.grid(sizes(spark, sf), DT, per=resp.select(*KEYS).distinct())
    mu = O.predict_bins(O.linear_predictor(coo(spark, sf), weight=fixed_weight()), cells)
    rates = mu.join(resp, [*KEYS, "bin"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return rounded(PD.prediction_window(rates, DT, 100.0, 120.0).drop("model_id"), "predicted_hz")


@query(with_events("""
SELECT session_id, ev_ord, kind, round(greatest(t_on, 100.0), 6) AS t_on, round(least(t_off, 220.0), 6) AS t_off
FROM ev WHERE t_off >= 100.0 AND t_on <= 220.0 AND least(t_off, 220.0) > greatest(t_on, 100.0)"""))
def event_boxes(spark, sf):
    boxes = PD.event_boxes(T.events(spark, sf), 100.0, 120.0)
    return rounded(boxes.select("session_id", "ev_ord", "kind", "t_on", "t_off"), "t_on", "t_off")


@query()
def kernel_panels(spark, sf):
    """Gaussian kernels of every session with titles, ready to draw."""
    (fits, _), _ = _gauss(spark, sf)
    return rounded(PD.kernel_panels(FT.unpack_kernels(fits, COLMAP)), "weight")


def _log_link(spark, sf):
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    blk = materialize(blocks(spark, sf))
    fits, _ = FT.log_link_cv_fit(blk, materialize(M.fold_moments(blk, COLMAP)), COLMAP, d, LAMBDAS, CFG["optimizer"])
    return fits, blk


@query()
def glm_fit_log_link(spark, sf):
    """Gaussian fit with a log link by damped Newton steps."""
    fits, _ = _log_link(spark, sf)
    return fits.select(*KEYS, "lam", F.round("f_best", 4).alias("nll"), "iters", "converged")


@query(_ZERO_SQL)
def log_fit_residual(spark, sf):
    """Penalised gradient of the log-link fit at its weights, relative to the start: zero."""
    fits, _ = _log_link(spark, sf)
    return _scaled_slope(spark, sf, fits, "gauss_log")


@query()
def permutation_test_log_link(spark, sf):
    """Refits of shifted signals through the log link, with how many of them met the tolerance."""
    d, _ = B.smoothness_penalty(COLMAP, CFG)
    fits, blk = _log_link(spark, sf)
    fits = materialize(fits.select(*KEYS, "lam", F.col("w_best").alias("w")))
    nulls = materialize(I.log_link_nulls(blk, fits.drop("w"), COLMAP, d, C.N_PERMUTATIONS, CFG["seed"], CFG["optimizer"]))
    return _verdicts(*I.permutation_test(fits, nulls, COLMAP)).join(I.unsettled(nulls), KEYS)
