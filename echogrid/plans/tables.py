"""The driver's tables read as events, spikes and signals.

One hour of table time stands for one second of model time, so the model's
window constants keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.runtime import parts_for

US_PER_UNIT = 3_600_000_000.0

# Same mapping for the SQL oracle.
SQL_EVENTS = """
us AS (
  SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us FROM events
),
ev AS (
  SELECT user_id AS session_id, event_id AS ev_ord,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'produced' ELSE 'perceived' END AS kind,
    us / 3600000000.0 AS t_on,
    (us + CAST(floor(value * 60000000.0) AS BIGINT)) / 3600000000.0 AS t_off,
    event_type AS label
  FROM us WHERE event_type IN ('purchase', 'signup', 'view', 'click')
),
sp AS (
  SELECT user_id AS session_id, 'n0' AS neuron_id, us / 3600000000.0 AS t
  FROM us WHERE event_type = 'error'
)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, sf_dir: str, name: str = "events", each: int = 50_000) -> int:
    """Partitions for rows expanded from a table; its rows are counted from the file footers."""
    return parts_for(spark, read(spark, sf_dir, name).count(), each)


def micros(ts: str) -> F.Column:
    """Microseconds since 2024-01-01 from calendar fields (no time zone involved)."""
    return F.expr(
        f"(unix_date(cast({ts} as date)) - unix_date(date'2024-01-01')) * 86400000000L"
        f" + hour({ts}) * 3600000000L + minute({ts}) * 60000000L"
        f" + cast(extract(second from {ts}) * 1000000 as bigint)"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros("ts")
    length = F.floor(F.col("value") * 60000000.0)
    return (
        read(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "signup", "view", "click"))
        .select(
            F.col("user_id").alias("session_id"),
            F.col("event_id").alias("ev_ord"),
            F.when(F.col("event_type").isin("purchase", "signup"), "produced")
            .otherwise("perceived")
            .alias("kind"),
            (us / F.lit(US_PER_UNIT)).alias("t_on"),
            ((us + length) / F.lit(US_PER_UNIT)).alias("t_off"),
            F.col("event_type").alias("label"),
        )
    )


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "events")
        .filter(F.col("event_type") == "error")
        .select(
            F.col("user_id").alias("session_id"),
            F.lit("n0").alias("neuron_id"),
            (micros("ts") / F.lit(US_PER_UNIT)).alias("t"),
        )
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as sampled channels: session = label, channel = vector."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("session_id"),
        F.col("vec_id").cast("string").alias("channel_id"),
        F.posexplode("embedding").alias("sample_idx", "v"),
    ).select(
        "session_id",
        "channel_id",
        F.col("sample_idx").cast("bigint").alias("sample_idx"),
        F.col("v").cast("double").alias("v"),
    )
