import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, same

SF = "/root/testdata/sf0.001"
NAMES = [
    "timebase_extent", "spike_edge_rule", "call_type_canonical", "bout_collapse", "heard_proximity", "produced_context",
    "onset_streams", "state_segments", "basis_projection", "standardized_gram", "fold_gram_blocks", "poisson_grad_at_w",
    "unpack_kernel", "psth_counts", "rate_smooth_decimate", "hilbert_transform", "envelope_smoothing", "percentile_ci",
    "second_difference", "penalty_rows", "shifted_xty",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(want) > 0
    assert same(got, want) == ""
