"""Degrees and hubs of a graph whose relations arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(relations: DataFrame) -> DataFrame:
    """Running (graph_id, alias, in_degree, out_degree) of a stream of relations; for update or complete mode."""
    end = F.explode(F.array(F.struct(F.col("source").alias("alias"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("alias"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return relations.select("graph_id", end.alias("e")).groupBy("graph_id", "e.alias").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def windowed_degrees(relations: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """Degrees in tumbling windows of event time; rows later than `late` are dropped and closed windows' state is freed."""
    end = F.explode(F.array(F.struct(F.col("source").alias("alias"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("alias"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    timed = relations.withWatermark(ts, late).select("graph_id", F.col(ts).alias("ts"), end.alias("e"))
    return timed.groupBy("graph_id", F.window("ts", window).alias("window"), "e.alias").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
