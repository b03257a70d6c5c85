"""Session helpers: lineage cuts, spreading of heavy rows, local sessions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder.

    A cluster names the folder in ``spark.checkpoint.dir``; only when that is
    unset (tests, local runs) a temporary one is taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="echogrid-checkpoint-")
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash rows into ``parts`` partitions, by default the session's full number of shuffle partitions.

    Compact rows that stand for much compute would otherwise be merged into a
    few tasks by size alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts or n, *keys)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions that get about ``each`` of ``rows`` rows, the session's number at least.

    What a task holds then stays the same as tables grow, whatever the session was set to.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def local_session(cpus: str = "8", app: str = "echogrid") -> SparkSession:
    """Session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
