"""Edge accounting: every relation is internal, between clusters, or of a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import thickness
from lattica.session import by_node


def classify(relations: DataFrame, membership: DataFrame) -> DataFrame:
    """relations with from_cluster, to_cluster and edge_kind; an end in no cluster makes the relation a hub's.

    Hubs are in no cluster, so two equi-joins on the ends tell all three kinds.
    """
    own = membership.select("graph_id", "alias", "cluster_id")
    a = own.select("graph_id", F.col("alias").alias("source"), F.col("cluster_id").alias("from_cluster"))
    b = own.select("graph_id", F.col("alias").alias("target"), F.col("cluster_id").alias("to_cluster"))
    both = relations.join(by_node(a), ["graph_id", "source"], "left").join(by_node(b), ["graph_id", "target"], "left")
    kind = F.when(F.col("from_cluster").isNull() | F.col("to_cluster").isNull(), "hub").when(F.col("from_cluster") == F.col("to_cluster"), "internal").otherwise("inter")
    return both.withColumn("edge_kind", kind)


def summary(edges: DataFrame) -> DataFrame:
    """(graph_id, internal_edges, inter_cluster_edges, hub_edges, total_edges)."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("edge_kind") == k, 1)), F.lit(0)).cast("long")
    return edges.groupBy("graph_id").agg(n("internal").alias("internal_edges"), n("inter").alias("inter_cluster_edges"), n("hub").alias("hub_edges"), F.count("*").alias("total_edges"))


def cluster_stats(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(graph_id, cluster_id, cluster_name, size, internal_edges, external_edges); an edge between clusters is external to both."""
    inside = edges.where("edge_kind = 'internal'").select("graph_id", F.col("from_cluster").alias("cluster_id"), F.lit(1).alias("i"), F.lit(0).alias("x"))
    across = edges.where("edge_kind = 'inter'").select("graph_id", F.explode(F.array("from_cluster", "to_cluster")).alias("cluster_id"), F.lit(0).alias("i"), F.lit(1).alias("x"))
    sums = inside.unionByName(across).groupBy("graph_id", "cluster_id").agg(F.sum("i").alias("i"), F.sum("x").alias("x"))
    sizes = membership.groupBy("graph_id", "cluster_id", "cluster_name").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.join(sums, ["graph_id", "cluster_id"], "left").select("graph_id", "cluster_id", "cluster_name", "size", zero("i").alias("internal_edges"), zero("x").alias("external_edges"))


def pair_counts(edges: DataFrame) -> DataFrame:
    """(graph_id, from_cluster, to_cluster, n, thickness) of ordered pairs of different clusters."""
    counts = edges.where("edge_kind = 'inter'").groupBy("graph_id", "from_cluster", "to_cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("thickness", thickness(F.col("n"), F.max("n").over(Window.partitionBy("graph_id"))))


def cut_edges(adj: DataFrame, membership: DataFrame) -> DataFrame:
    """(graph_id, cut): pairs of neighbours in different clusters, each once."""
    own = membership.select("graph_id", "alias", "cluster_id")
    u = own.select("graph_id", F.col("alias").alias("u"), F.col("cluster_id").alias("cu"))
    v = own.select("graph_id", F.col("alias").alias("v"), F.col("cluster_id").alias("cv"))
    both = adj.where("u < v").join(by_node(u), ["graph_id", "u"]).join(by_node(v), ["graph_id", "v"])
    return both.groupBy("graph_id").agg(F.coalesce(F.sum(F.when(F.col("cu") != F.col("cv"), 1)), F.lit(0)).cast("long").alias("cut"))


def oversized(stats: DataFrame, max_size: int) -> DataFrame:
    """(graph_id, n_oversized, largest_name, largest_size) of graphs that have clusters above max_size; of equals the first in cluster order."""
    largest = F.min(F.struct((-F.col("size")).alias("s"), F.col("cluster_id"), F.col("cluster_name"), F.col("size")))
    return stats.where(F.col("size") > max_size).groupBy("graph_id").agg(F.count("*").alias("n_oversized"), largest.alias("m")).select("graph_id", "n_oversized", F.col("m.cluster_name").alias("largest_name"), F.col("m.size").alias("largest_size"))
