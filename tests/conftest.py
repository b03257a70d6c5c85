import pytest

from echogrid.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "echogrid-tests")
    # Tiny inputs: a few partitions keep several tasks without 8 workers each.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from (kind letter, on, off[, label]) tuples; P heard, R produced."""

    def build(rows, session_id=1):
        kinds = {"P": "perceived", "R": "produced"}
        data = [
            (session_id, i, kinds.get(r[0], r[0]), float(r[1]), float(r[2]), r[3] if len(r) > 3 else "")
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, "session_id bigint, ev_ord bigint, kind string, t_on double, t_off double, label string"
        )

    return build
