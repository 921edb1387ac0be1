"""Graphs derived from ordinary tables: (classes, relations) of one graph each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica import schema
from lattica.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _alias(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _relations(graph_id: str, pairs: DataFrame) -> DataFrame:
    """pairs (source, target) as relations; they keep no order, so they have no number."""
    null = F.lit(None).cast("string")
    return pairs.select(F.lit(graph_id).alias("graph_id"), F.lit(0).alias("rel_id"), "source", F.lit("..>").alias("arrow"), "target", null.alias("label"), null.alias("src_mult"), null.alias("dst_mult"), F.concat_ws(" ..> ", "source", "target").alias("raw"))


def _classes(graph_id: str, names: DataFrame) -> DataFrame:
    null = F.lit(None)
    return names.select(F.lit(graph_id).alias("graph_id"), "alias", "name", F.lit("class").alias("kind"), null.cast("array<string>").alias("body"), null.cast("string").alias("package"), null.cast("string").alias("stereotype"), F.lit(0).alias("decl_line"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.CLASSES)


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier to part, a relation for each line; names are those of suppliers and parts that occur."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(_alias("S", "l_suppkey").alias("source"), _alias("P", "l_partkey").alias("target"))
    # Keys meet as numbers: names of all lines' ends cost several times as much.
    supplier = table(spark, sf_dir, "supplier").join(lines.select(F.col("l_suppkey").alias("s_suppkey")).distinct(), "s_suppkey", "left_semi")
    part = table(spark, sf_dir, "part").join(lines.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    s = supplier.select(_alias("S", "s_suppkey").alias("alias"), F.col("s_name").alias("name"))
    p = part.select(_alias("P", "p_partkey").alias("alias"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name"))
    return _classes("trade", s.unionByName(p)), _relations("trade", pairs)


def trade_counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """trade, and the degrees of its nodes: lines are counted once, by their keys as numbers, and what occurs is looked up in the counts."""
    lines = table(spark, sf_dir, "lineitem")
    parts = spark.sparkContext.defaultParallelism
    zero = F.lit(0).cast("long")

    def count(key: str, letter: str, in_degree: Column, out_degree: Column) -> DataFrame:
        # In few tasks, so that most lines of a key meet before anything is shuffled.
        return lines.select(key).coalesce(parts).groupBy(key).agg(F.count("*").alias("n")).select(_alias(letter, key).alias("alias"), in_degree.alias("in_degree"), out_degree.alias("out_degree"))

    counts = stored(count("l_suppkey", "S", zero, F.col("n")).unionByName(count("l_partkey", "P", F.col("n"), zero)), "counts")
    # Lines without a key on either side have one name, null.
    degrees = counts.groupBy(F.lit("trade").alias("graph_id"), "alias").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    classes = _trade_names(spark, sf_dir).join(counts.select("alias"), "alias", "left_semi")
    pairs = lines.select(_alias("S", "l_suppkey").alias("source"), _alias("P", "l_partkey").alias("target"))
    return _classes("trade", classes), _relations("trade", pairs), degrees


def _trade_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(_alias("S", "s_suppkey").alias("alias"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, sf_dir, "part").select(_alias("P", "p_partkey").alias("alias"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name")))


def coorder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of one order, by line number."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("na"), _alias("P", "l_partkey").alias("source"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("nb"), _alias("P", "l_partkey").alias("target"))
    return _none(spark), _relations("coorder", a.join(b, "l_orderkey").where("na < nb").select("source", "target"))


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Host of a page to what the page refers to."""
    pages = table(spark, sf_dir, "pages")
    host = F.concat(F.lit("H"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return _none(spark), _relations("links", pages.select(host.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")))


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order to customer."""
    return _none(spark), _relations("orders", table(spark, sf_dir, "orders").select(_alias("O", "o_orderkey").alias("source"), _alias("C", "o_custkey").alias("target")))


def geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers to nations, nations to regions."""
    c = table(spark, sf_dir, "customer").select(_alias("C", "c_custkey").alias("source"), _alias("N", "c_nationkey").alias("target"))
    s = table(spark, sf_dir, "supplier").select(_alias("S", "s_suppkey").alias("source"), _alias("N", "s_nationkey").alias("target"))
    n = table(spark, sf_dir, "nation").select(_alias("N", "n_nationkey").alias("source"), _alias("R", "n_regionkey").alias("target"))
    return _none(spark), _relations("geo", c.unionByName(s).unionByName(n))


def steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """From the user of a purchase to that of the next, each pair once.

    The events' order is one line, so purchases are first bucketed by hour; only
    the last purchase of each hour looks into the hours after it.
    """
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", "event_id", F.col("user_id").cast("string").alias("user"), F.date_trunc("hour", "ts").alias("hour"))
    within = rows.withColumn("next", F.lead("user").over(Window.partitionBy("hour").orderBy("ts", "event_id")))
    ends = rows.groupBy("hour").agg(F.min_by("user", F.struct("ts", "event_id")).alias("first"))
    after = ends.withColumn("after", F.lead("first").over(Window.orderBy("hour"))).select("hour", "after")
    pairs = within.join(after, "hour").select(F.concat(F.lit("U"), "user").alias("source"), F.concat(F.lit("U"), F.coalesce("next", "after")).alias("target"))
    return _none(spark), _relations("steps", pairs.where("target IS NOT NULL").distinct())


def diagram_text(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """(graph_id, content): declarations and relations as a diagram, in order of alias and of ends.

    One document is one row, so this is for graphs of a document's size.
    """
    from lattica.operators.render import declaration_line, relation_line

    d = classes.select("graph_id", F.struct(F.lit(1).alias("s"), F.col("alias").alias("a"), F.lit("").alias("b"), F.lit(0).alias("i"), declaration_line(F.col("kind"), F.col("name"), F.col("alias")).alias("line")).alias("x"))
    none = F.lit(None).cast("string")
    r = relations.select("graph_id", F.struct(F.lit(2).alias("s"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("rel_id").alias("i"), relation_line(F.col("source"), F.col("arrow"), F.col("target"), F.col("label"), F.col("src_mult"), F.col("dst_mult"), none, F.lit(None).cast("int")).alias("line")).alias("x"))
    body = d.unionByName(r).groupBy("graph_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return body.select("graph_id", F.concat(F.lit("@startuml "), "graph_id", F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n@enduml\n")).alias("content"))
