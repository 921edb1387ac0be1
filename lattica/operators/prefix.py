"""Clusters by the first tokens of display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import prefix_key


def prefix_clusters(members: DataFrame, max_size: int, within: list[str] | None = None) -> DataFrame:
    """members (graph_id, alias, name) with cluster_name.

    A group of one first token that is too large is cut by two tokens, unless
    that makes every member a group of its own.  within: columns besides
    graph_id that groups don't cross.
    """
    own = ["graph_id", *(within or [])]
    shown = F.coalesce("name", "alias")
    rows = members.withColumn("__one", prefix_key(shown, F.col("alias"), 1)).withColumn("__two", prefix_key(shown, F.col("alias"), 2))
    group = Window.partitionBy(*own, "__one")
    rows = rows.withColumn("__rank", F.dense_rank().over(group.orderBy("__two")))
    buckets = F.max("__rank").over(group)
    n = F.count("*").over(group)
    finer = (n > max_size) & (buckets < n)
    return rows.withColumn("cluster_name", F.when(finer, F.col("__two")).otherwise(F.col("__one"))).drop("__one", "__two", "__rank")
