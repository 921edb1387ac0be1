"""Session helpers: checkpoints that survive lost executors, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; only where none is set, on a local master, a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint, so loops don't grow the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df read back from Parquet files beside the checkpoints: in columns and compressed, where a checkpoint takes a row's width."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def by_node(df: DataFrame) -> DataFrame:
    """df, of one row a node, marked to be the side that a shuffled join keeps in memory, so that the links it meets aren't sorted."""
    return df.hint("shuffle_hash")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the groups of a kernel over as many tasks as shuffles have: rows of many small groups are few, and would be put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is proven to have few rows; else by_node, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else by_node(df)
