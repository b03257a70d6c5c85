from pyspark.sql import functions as F

from echogrid.operators import grid as G
from echogrid.operators import objective as O


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_meets_models_before_it_is_expanded(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 3), (None, 4)], "session_id bigint, n_bins bigint")
    models = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "session_id bigint, model_id string")
    cells = G.grid(sizes, 0.5, block_bins=2, per=models)
    got = sorted((r["session_id"], r["model_id"], r["bin"], r["t"]) for r in cells.collect())
    assert got == [(s, m, b, b * 0.5) for s, m, n in [(1, "a", 5), (1, "b", 5), (2, "a", 3)] for b in range(n)]
    eta = spark.createDataFrame([(1, "b", 4, 1.0)], "session_id bigint, model_id string, bin bigint, eta double")
    mu = O.predict_bins(eta, cells)
    assert {(r["session_id"], r["model_id"], r["bin"]): round(r["mu"], 6) for r in mu.collect()} == {
        (s, m, b): 2.718282 if (s, m, b) == (1, "b", 4) else 1.0 for s, m, b, _ in got
    }
    # No inner join may lie above the bins: its size would be taken from the blocks and the bins broadcast.
    for df in (cells, mu, G.grid(sizes, 1.0, per=sizes).select("bin", F.col("n_bins"))):
        lines = plan(df).splitlines()
        bins = next(i for i, s in enumerate(lines) if "Generate explode(sequence(first_bin" in s)
        assert all(i > bins for i, s in enumerate(lines) if "Join Inner" in s)
