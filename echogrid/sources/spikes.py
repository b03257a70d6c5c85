"""Spike time datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.functions.numeric import is_finite
from echogrid.schema import InputError, require_columns


def load_spikes(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, neuron_id, t) from Parquet, one row per spike or array per neuron.

    Row order carries no meaning here, so unsorted input needs no repair.
    """
    df = spark.read.parquet(path)
    if "spike_times" in df.columns:
        require_columns(df, ["neuron_id", "session_id"], "InvalidSpikesStruct")
        df = df.select("session_id", "neuron_id", F.explode("spike_times").alias("t"))
    require_columns(df, ["session_id", "neuron_id", "t"], "InvalidSpikesStruct")
    if dict(df.dtypes)["t"] not in ("double", "float", "int", "bigint") and not dict(df.dtypes)["t"].startswith("decimal"):
        raise InputError("InvalidSpikeTimes", "spike times must be numeric")
    out = df.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("neuron_id").cast("string").alias("neuron_id"),
        F.col("t").cast("double").alias("t"),
    )
    if not out.filter(~F.coalesce(is_finite(F.col("t")), F.lit(False))).isEmpty():
        raise InputError("InvalidSpikeTimes", "spike times must be finite")
    return out
