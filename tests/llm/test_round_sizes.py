"""Loops hand real table sizes to the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from echogrid.llm.common import components


def test_size_guesses_do_not_grow_with_the_rounds(spark):
    path = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    once = components(path)
    again = components(once.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    assert {(r.node, r.comp) for r in once.collect()} == {(r.node, r.comp) for r in again.collect()} == {(i, 0) for i in range(40)}
    for found in (once, again):
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
