"""The graph of classes and relations: nodes, degrees, adjacency, top-k, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import small


def nodes(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, alias, in_degree, out_degree): declared aliases and all ends of relations; a self loop counts at both ends.

    One aggregation: every declaration and every end of a relation is a row
    with what it adds, so partial sums leave the map side.
    """
    ends = [
        classes.select("graph_id", "alias", F.lit(0).alias("i"), F.lit(0).alias("o")),
        relations.select("graph_id", F.col("source").alias("alias"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        relations.select("graph_id", F.col("target").alias("alias"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    ]
    return ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("graph_id", "alias").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def adjacency(relations: DataFrame) -> DataFrame:
    """(graph_id, u, v): who is next to whom, both ways, once, without self loops."""
    loose = relations.where("source <> target")
    both = F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"))))
    return loose.select("graph_id", both.alias("e")).select("graph_id", "e.u", "e.v").distinct()


def pairs(relations: DataFrame) -> DataFrame:
    """(graph_id, u, v): u < v for every relation that is no self loop, as often as there are relations."""
    return relations.where("source <> target").select("graph_id", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))


def both_ways(links: DataFrame) -> DataFrame:
    """The adjacency of pairs: both ways, once."""
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return links.select("graph_id", "u", "v").distinct().select("graph_id", both.alias("e")).select("graph_id", "e.u", "e.v")


def without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs of which neither end is in gone (graph_id, alias)."""
    gone = small(gone.select("graph_id", "alias").distinct())
    for c in ("u", "v"):
        links = links.join(gone.withColumnRenamed("alias", c), ["graph_id", c], "left_anti")
    return links.select("graph_id", "u", "v")


def neighbours(adj: DataFrame) -> DataFrame:
    """(graph_id, alias, neighbours): sorted lists."""
    return adj.groupBy("graph_id", F.col("u").alias("alias")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def top_by(degrees: DataFrame, column: str, n: int) -> DataFrame:
    """The n nodes of each graph with most of a degree, ties by alias."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc(column), "alias"))
    return degrees.withColumn("rank", rank).where(F.col("rank") <= max(0, n)).select("graph_id", "alias", F.col(column).alias("degree"), "rank")


def name_by_out_degree(membership: DataFrame, degrees: DataFrame, by: str) -> DataFrame:
    """(graph_id, by, cluster_name): in each group the member of highest out-degree in the whole graph, ties to the least alias."""
    joined = membership.join(degrees.select("graph_id", "alias", "out_degree"), ["graph_id", "alias"], "left")
    first = F.struct((-F.coalesce("out_degree", F.lit(0))).alias("d"), F.col("alias"))
    return joined.groupBy("graph_id", by).agg(F.min(first).alias("m")).select("graph_id", by, F.col("m.alias").alias("cluster_name"))
