"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import without
from lattica.session import cut, small, stored

#: Edges up to which a graph's components are found in one task; times FOREST, rows of its forest.
SMALL_GRAPH, FOREST = 200_000, 20
#: Links that a task takes up at once when it makes a forest of its own, rows of a forest that it holds meanwhile, and forests that become one.
STEP, HELD, JOINED = 1_000_000, 2_000_000, 8
_LINKS = "graph_id string, u string, v string"
_LABELS = "graph_id string, alias string, component string"


def coded(*columns: pa.ChunkedArray, ordered: bool = True) -> tuple[pa.Array, list[np.ndarray]]:
    """The names in columns, if ordered by their bytes, and each column as places among them; nulls are -1."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    found = whole.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy() if ordered else np.arange(len(found.dictionary))
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    codes = place[found.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
    return found.dictionary.take(pa.array(order)), np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order, by sorting in place; np.unique takes many times as long."""
    keys.sort()
    return keys[np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))] if len(keys) else keys


def least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least that it reaches: roots are hung below lower ones that they are next to, and pointers followed."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = a[apart], b[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(label, further := label[label]):
            label = further


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the same components, fewer than the nodes of a partition: each node with one that it reaches there.

    What has been found goes on with the links that follow, as long as a task can hold it.
    """

    def made(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        # By columns: fields of what comes in may be marked as never null, those of what was found aren't.
        table, out = pa.table({c: pa.chunked_array([b.column(c) for b in held]) for c in ("graph_id", "u", "v")}), []
        graphs = table["graph_id"].unique()
        for g in graphs:
            own = table.filter(pc.equal(table["graph_id"], g)) if len(graphs) > 1 else table
            names, (u, v) = coded(own["u"], own["v"], ordered=False)
            label = least(u, v, len(names))
            moved = np.flatnonzero(label != np.arange(len(names)))
            out.append(pa.RecordBatch.from_arrays([pa.repeat(g, len(moved)), names.take(pa.array(label[moved])), names.take(pa.array(moved))], ["graph_id", "u", "v"]))
        return out

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= STEP:
            held, rows = made(held), 0
            if sum(b.num_rows for b in held) > HELD:
                yield from held
                held = []
    if held:
        yield from made(held) if rows else held


def _in_one(table: pa.Table) -> pa.Table:
    """All components of a graph."""
    names, (u, v) = coded(table["u"], table["v"])
    return pa.table({"graph_id": pa.repeat(table["graph_id"][0], len(names)), "alias": names, "component": names.take(pa.array(least(u, v, len(names))))})


def _contract(edges: DataFrame) -> DataFrame:
    """(graph_id, alias, component) by contraction: each node points at its least neighbour, pointers are followed, and the links left go on."""
    edges = cut(edges)
    labels = cut(edges.select("graph_id", F.col("u").alias("alias")).distinct().withColumn("component", F.col("alias")))
    while not edges.isEmpty():
        parent = edges.groupBy("graph_id", "u").agg(F.min("v").alias("v")).select("graph_id", "u", F.least("u", "v").alias("to"))
        parent = cut(parent)
        while True:
            far = parent.select("graph_id", F.col("u").alias("to"), F.col("to").alias("next"))
            parent = cut(parent.join(far, ["graph_id", "to"]).select("graph_id", "u", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")))
            still = not parent.where("moved").isEmpty()
            parent = parent.select("graph_id", "u", "to")
            if not still:
                break
        step = parent.select("graph_id", F.col("u").alias("component"), "to")
        labels = cut(labels.join(step, ["graph_id", "component"], "left").select("graph_id", "alias", F.coalesce("to", "component").alias("component")))
        left, right = parent.select("graph_id", "u", F.col("to").alias("a")), parent.select("graph_id", F.col("u").alias("v"), F.col("to").alias("b"))
        edges = cut(edges.join(left, ["graph_id", "u"]).join(right, ["graph_id", "v"]).where("a <> b").select("graph_id", F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    return labels


def labelled(links: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(graph_id, alias, component) of the ends of links (u < v, repeats don't matter); a component is named by its least alias.

    Graphs of up to small_graph links take one task each.  The links of larger
    ones become a forest in every task first, whose rows go with the nodes, and
    forests are joined while that makes them fewer rows; one task a graph takes
    a forest of up to FOREST times as many rows, and others are labelled by
    contraction, some joins a round and no more than log2(nodes) rounds.
    """
    sizes = cut(links.groupBy("graph_id").agg(F.count("*").alias("n")))
    large = small(sizes.where(F.col("n") > small_graph).select("graph_id"))
    if large.isEmpty():
        return links.groupBy("graph_id").applyInArrow(_in_one, _LABELS)
    some = not sizes.where(F.col("n") <= small_graph).isEmpty()
    parts = links.sparkSession.sparkContext.defaultParallelism
    forest = stored((links.join(large, "graph_id", "left_semi") if some else links).select("graph_id", "u", "v").coalesce(parts).mapInArrow(_stars, _LINKS), "forest")
    rows = cut(forest.groupBy("graph_id").agg(F.count("*").alias("n")))
    while small_graph and parts > 1 and not rows.where(F.col("n") > FOREST * small_graph).isEmpty():
        before, parts = rows, -(-parts // JOINED)
        forest = stored(forest.coalesce(parts).mapInArrow(_stars, _LINKS), "forest")
        rows = cut(forest.groupBy("graph_id").agg(F.count("*").alias("n")))
        if before.agg(F.sum("n")).first()[0] < 2 * rows.agg(F.sum("n")).first()[0]:
            break
    fits = small(rows.where(F.col("n") <= FOREST * small_graph).select("graph_id"))
    rest = small(rows.where(F.col("n") > FOREST * small_graph).select("graph_id"))
    labels = forest.join(fits, "graph_id", "left_semi").groupBy("graph_id").applyInArrow(_in_one, _LABELS)
    if not rest.isEmpty():
        deep = forest.join(rest, "graph_id", "left_semi")
        labels = labels.unionByName(_contract(deep.union(deep.select("graph_id", "v", "u")).distinct()))
    if some:
        labels = labels.unionByName(links.join(large, "graph_id", "left_anti").groupBy("graph_id").applyInArrow(_in_one, _LABELS))
    return labels


def connected(nodes: DataFrame, adj: DataFrame, excluded: DataFrame | None = None, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """(graph_id, alias, component) of every node that isn't excluded; adj: pairs, or both ways."""
    links = adj.select("graph_id", "u", "v").where("u < v")
    if excluded is not None:
        nodes = nodes.join(excluded.select("graph_id", "alias").distinct(), ["graph_id", "alias"], "left_anti")
        links = without(links, excluded)
    labels = labelled(links, small_graph)
    return nodes.select("graph_id", "alias").join(labels, ["graph_id", "alias"], "left").select("graph_id", "alias", F.coalesce("component", "alias").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
