"""Preparation of chat rows that needs neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_consecutive_tool_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content: runs of tool_call messages become one of the assistant. Returns
    conv_id, idx, role, content, n."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    tool = F.col("role") == "tool_call"
    goes_on = tool & F.coalesce(F.lag("role").over(order) == "tool_call", F.lit(False))
    runs = messages.withColumn("_new", (~goes_on).cast("int")).withColumn("_i", F.sum("_new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    g = runs.groupBy("conv_id", "_i").agg(F.first("role").alias("role"), parts.alias("p"), F.count("*").alias("n"))
    role = F.when(F.col("role") == "tool_call", "assistant").otherwise(F.col("role"))
    return g.select("conv_id", (F.col("_i") - 1).cast("long").alias("idx"), role.alias("role"), F.array_join("p.content", "").alias("content"), "n")
