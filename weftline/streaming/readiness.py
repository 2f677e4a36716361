"""Readiness as a stream: steps become ready as completions of their parents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completions(done: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent of each completed step in the stream ``done`` (op): a stream-static join."""
    return done.join(edges.select(F.col("parent").alias("op"), "child"), "op").select("child", F.col("op").alias("parent"))


def ready(done: DataFrame, edges: DataFrame) -> DataFrame:
    """child, arrived, needed: for output mode ``update``; a step is ready when both are equal.

    A parent that completes twice counts once. State is one counter per waiting step.
    """
    needed = edges.select("parent", "child").distinct().groupBy("child").agg(F.count(F.lit(1)).alias("needed"))
    arrived = completions(done, edges).dropDuplicates(["child", "parent"]).join(needed, "child")
    return arrived.groupBy("child", "needed").agg(F.count(F.lit(1)).alias("arrived")).select("child", "arrived", "needed", (F.col("arrived") >= F.col("needed")).alias("ready"))
