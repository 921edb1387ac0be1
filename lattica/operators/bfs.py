"""Distances from several seeds at once, and the nearest seed.

A component without more than ONE_TASK links is searched in one task, from 64
seeds at a time; larger ones by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import coded, distinct, labelled
from lattica.operators.graph import both_ways, without
from lattica.options import MISC
from lattica.session import by_node, cut, small

#: Links of a component up to which one task searches it; cells of a table that is in a task at once.
ONE_TASK, CELLS = 5_000_000, 50_000_000


def _near(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The names of a component in order, its links from both ends in order of the first, and its seeds: rows without v."""
    names, (u, v) = coded(table["u"], table["v"])
    seeds, linked = np.unique(u[v < 0]), v >= 0
    u, v, n = u[linked], v[linked], len(names)
    keys = distinct(np.concatenate([u * n + v, v * n + u]))
    return names, keys // n, keys % n, seeds


def _blocks(source: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted source, and where they begin."""
    begin = np.flatnonzero(np.diff(source, prepend=-1))
    return source[begin], begin


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances within a component: a bit a seed, 64 at a time."""
    table = pa.Table.from_batches(batches)
    names, source, target, seeds = _near(table)
    graph = table["graph_id"][0]
    own, begin = _blocks(source, len(names))
    for k in range(0, len(seeds), 64):
        block = seeds[k : k + 64]
        front = np.zeros(len(names), np.uint64)
        front[block] = np.uint64(1) << np.arange(len(block), dtype=np.uint64)
        seen, hops = front.copy(), 0
        while front.any():
            for bit, seed in enumerate(block):
                at = np.flatnonzero(front >> np.uint64(bit) & np.uint64(1))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.repeat(graph, len(at)), names.take(pa.array(np.repeat(seed, len(at)))), names.take(pa.array(at)), pa.array(np.full(len(at), hops, np.int32))], ["graph_id", "seed", "alias", "dist"])
            found = np.zeros(len(names), np.uint64)
            if len(own):
                found[own] = np.bitwise_or.reduceat(front[target], begin)
            front = found & ~seen
            seen |= front
            hops += 1


def nearest_places(source: np.ndarray, target: np.ndarray, seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest seed of each of n nodes, -1 for none, and its hops: levels of all seeds together, then for each seed that ties the neighbours a level nearer that it has reached.

    Links are there from both ends, in order of the first; seeds are in order.
    """
    level, hops = np.full(n, -1), 0
    level[seeds] = 0
    while (fresh := source[(level[target] == hops) & (level[source] < 0)]).size:
        hops += 1
        level[fresh] = hops
    down = level[source] == level[target] + 1
    source, target = source[down], target[down]
    steps = []
    for h in range(1, hops + 1):
        of = level[source] == h
        steps.append((target[of], *_blocks(source[of], n)))
    best, nearest = np.zeros(n, np.int64), np.full(n, -1)
    nearest[seeds] = seeds
    width = max(1, min(64, CELLS // max(1, len(source), n)))
    for k in range(0, len(seeds), width):
        block = seeds[k : k + width]
        ties = np.zeros((n, len(block)), bool)
        ties[block, np.arange(len(block))] = True
        for to, own, begin in steps:
            before = np.add.reduceat(ties[to], begin, axis=0, dtype=np.int32)
            ties[own] = before > 0
            # Seeds are in order, so the first of the most is the least.
            first = before.argmax(axis=1)
            most = before[np.arange(len(own)), first]
            more = most > best[own]
            best[own[more]], nearest[own[more]] = most[more], block[first[more]]
    return nearest, level


def _nearest(table: pa.Table) -> pa.Table:
    """The nearest seed within a component."""
    names, source, target, seeds = _near(table)
    nearest, level = nearest_places(source, target, seeds, len(names))
    at = np.flatnonzero(nearest >= 0)
    return pa.table({"graph_id": pa.repeat(table["graph_id"][0], len(at)), "alias": names.take(pa.array(at)), "seed": names.take(pa.array(nearest[at])), "dist": pa.array(level[at].astype(np.int32))})


def _by_component(links: DataFrame, starts: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and seeds of components that one task searches, as rows (graph_id, component, u, v) with seeds having no v; links and seeds of the others."""
    labels = cut(labelled(links))
    seeds = cut(starts.join(labels, ["graph_id", "alias"], "left").select("graph_id", F.coalesce("component", "alias").alias("component"), "alias"))
    ends = links.groupBy("graph_id", "u").agg(F.count("*").alias("n")).join(labels.withColumnRenamed("alias", "u"), ["graph_id", "u"])
    large = cut(ends.groupBy("graph_id", "component").agg(F.sum("n").alias("n")).where(F.col("n") > one_task).select("graph_id", "component"))
    wanted = labels.join(small(seeds.select("graph_id", "component").distinct()), ["graph_id", "component"], "left_semi")
    held = wanted.join(small(large), ["graph_id", "component"], "left_anti").select("graph_id", F.col("alias").alias("u"), "component")
    near = links.join(by_node(held), ["graph_id", "u"]).select("graph_id", "component", "u", "v")
    few = seeds.join(small(large), ["graph_id", "component"], "left_anti").select("graph_id", "component", F.col("alias").alias("u"), F.lit(None).cast("string").alias("v"))
    if large.isEmpty():
        return near.unionByName(few), links.limit(0), seeds.limit(0)
    wide = wanted.join(small(large), ["graph_id", "component"], "left_semi").select("graph_id", F.col("alias").alias("u"))
    return near.unionByName(few), links.join(by_node(wide), ["graph_id", "u"]).select("graph_id", "u", "v"), seeds.join(small(large), ["graph_id", "component"], "left_semi").select("graph_id", "alias")


def _open(adj: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """Pairs (u < v) without what touches a blocked alias."""
    links = adj.where("u < v").select("graph_id", "u", "v")
    return links if blocked is None else without(links, blocked)


def distances(adj: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(graph_id, seed, alias, dist): hops from each seed to all it reaches, through no blocked alias; adj: pairs, or both ways.

    A round over components that no one task should hold joins the frontier
    with the adjacency and drops what the seed has reached before; it ends with
    an empty frontier.
    """
    rows, wide, left = _by_component(_open(adj, blocked), seeds.select("graph_id", "alias").distinct(), one_task)
    found = rows.groupBy("graph_id", "component").applyInArrow(_search, "graph_id string, seed string, alias string, dist int")
    if left.isEmpty():
        return found
    adj = cut(both_ways(wide))
    frontier = cut(left.select("graph_id", F.col("alias").alias("seed"), "alias", F.lit(0).alias("dist")))
    reached, hops = frontier, 0
    while True:
        hops += 1
        step = frontier.select("graph_id", "seed", F.col("alias").alias("u")).join(adj, ["graph_id", "u"]).select("graph_id", "seed", F.col("v").alias("alias")).distinct()
        frontier = cut(step.join(reached, ["graph_id", "seed", "alias"], "left_anti").withColumn("dist", F.lit(hops)))
        if frontier.isEmpty():
            return found.unionByName(reached)
        reached = cut(reached.unionByName(frontier))


def nearest_seed(nodes: DataFrame, adj: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(graph_id, alias, seed, dist): the nearest seed; ties to the one that more neighbours a hop nearer have, then to the least alias.

    All seeds start at once and a node is reached once, by the seeds that tie
    at its least distance, each with the number of neighbours it came by: these
    have the same seed a hop nearer, or the node would be nearer itself.  So
    rows grow with the nodes, not with seeds times nodes.  What no seed reaches
    goes to `misc`, with no distance.
    """
    rows, wide, left = _by_component(_open(adj, blocked), seeds.select("graph_id", "alias").distinct(), one_task)
    best = rows.groupBy("graph_id", "component").applyInArrow(_nearest, "graph_id string, alias string, seed string, dist int")
    if not left.isEmpty():
        best = best.unionByName(_nearest_by_rounds(cut(both_ways(wide)), left))
    return nodes.select("graph_id", "alias").join(best, ["graph_id", "alias"], "left").select("graph_id", "alias", F.coalesce("seed", F.lit(MISC)).alias("seed"), "dist")


def _nearest_by_rounds(adj: DataFrame, starts: DataFrame) -> DataFrame:
    frontier = cut(starts.select("graph_id", "alias", F.col("alias").alias("seed"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("dist")))
    reached, hops = frontier, 0
    while True:
        hops += 1
        step = frontier.select("graph_id", "seed", F.col("alias").alias("u")).join(adj, ["graph_id", "u"])
        step = step.join(reached.select("graph_id", F.col("alias").alias("v")).distinct(), ["graph_id", "v"], "left_anti")
        frontier = cut(step.groupBy("graph_id", F.col("v").alias("alias"), "seed").agg(F.count("*").alias("before")).withColumn("dist", F.lit(hops)))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached.groupBy("graph_id", "alias").agg(F.min(F.struct("dist", (-F.col("before")).alias("b"), "seed")).alias("x")).select("graph_id", "alias", "x.seed", "x.dist")


def auto_seeds(degrees: DataFrame, hubs: DataFrame, threshold: int) -> DataFrame:
    """(graph_id, alias, out_degree) of nodes with enough relations out that are neither hubs nor named misc."""
    return degrees.join(hubs.select("graph_id", "alias"), ["graph_id", "alias"], "left_anti").where((F.col("out_degree") >= threshold) & (F.col("alias") != MISC)).select("graph_id", "alias", "out_degree")


def suggestions(unknown: DataFrame, candidates: DataFrame, within: int = 3, most: int = 3) -> DataFrame:
    """(graph_id, unknown, alias, dist): the most candidates of least edit distance, up to `within`.

    Lengths bound the distance, so candidates meet an unknown name by graph and
    length, over at most 2 * within + 1 lengths, instead of all by all.
    """
    near = unknown.select("graph_id", F.col("alias").alias("unknown"), F.explode(F.sequence(F.char_length("alias") - within, F.char_length("alias") + within)).alias("n"))
    known = candidates.select("graph_id", "alias", F.char_length("alias").alias("n"))
    found = near.join(known, ["graph_id", "n"]).withColumn("dist", F.levenshtein("unknown", "alias")).where(F.col("dist") <= within)
    rank = F.row_number().over(Window.partitionBy("graph_id", "unknown").orderBy("dist", "alias"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("graph_id", "unknown", "alias", "dist")
