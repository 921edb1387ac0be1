"""Connected components of links between ids, by contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links, 16 bytes each, up to which one task finds the components.
ONE_TASK = 1_000_000


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the least id that links reach, for every id that has one.

    links has a and b.  A table counted to have at most one_task links goes to
    one task; a larger one is contracted.
    """
    links = links.where("a <> b").select("a", "b")
    if links.count() > one_task:
        return contracted(links)
    return cut(links.groupBy(F.lit(0).alias("all")).applyInPandas(_united, "id long, component long"))


def _united(frame: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    ids = list(parent)
    return pd.DataFrame({"id": ids, "component": [find(x) for x in ids]}, dtype="int64")


def contracted(links: DataFrame) -> DataFrame:
    """The same by contraction, for any number of links.  In a round each id points at its least neighbour, the
    pointers are followed, and links between what they end at go on to the next
    round.  Every round at least halves the ids that still have links.  What is
    moved are pairs of longs; nothing but a count comes to the driver.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().select("id", F.col("id").alias("component")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("of"), F.least("a", "b").alias("to"))
        parent = cut(parent)
        while True:
            far = parent.select(F.col("of").alias("mid"), F.col("to").alias("next"))
            parent = cut(parent.join(far, F.col("to") == F.col("mid")).select("of", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            moved = not parent.where("moved").isEmpty()
            parent = parent.select("of", "to")
            if not moved:
                break
        labels = cut(labels.join(parent, F.col("component") == F.col("of"), "left").select("id", F.coalesce("to", "component").alias("component")))
        left = parent.select(F.col("of").alias("a"), F.col("to").alias("to_a"))
        right = parent.select(F.col("of").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = cut(edges)
    return labels
