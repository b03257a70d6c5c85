"""Row layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCED = "produced"
HEARD = "perceived"

EVENTS = "session_id bigint, ev_ord bigint, kind string, t_on double, t_off double, label string"
SPIKES = "session_id bigint, neuron_id string, t double"
SIGNAL = "session_id bigint, channel_id string, sample_idx bigint, v double"

HEARD_STREAMS = ["heard_addressed", "heard_overheard"]
CONTEXT_STREAMS = ["produced_spontaneous", "produced_after_heard", "produced_after_produced"]
BASE_CALL_TYPES = ["phee", "twitter", "trill", "trillphee"]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """Zero-row DataFrame with a full schema."""
    return spark.createDataFrame([], ddl)


class InputError(ValueError):
    """Input data failed a check; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def require_columns(df: DataFrame, names: list[str], code: str = "MissingField") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InputError(code, "missing columns " + ", ".join(missing))
