"""Whole splits: by strategy, by a map, by seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica import schema
from lattica.operators import account, bfs, components, graph, hubs, prefix
from lattica.operators.community import ArrayGraph, Clusters, LocalGraph, in_order
from lattica.operators.components import coded
from lattica.operators.packed import PackedGraph, chunks, pairs_of
from lattica.operators.refine import ROUNDS, first_round, merge_quotient, refine, refine_alone, rest_of_rounds, shared_holds, split_large
from lattica.options import MISC, PartitionError, SplitOptions
from lattica.session import by_node, cut, dealt, small, stored
from lattica.sources.mapfile import MapFile

#: Names of graph nodes listed in an error or a warning, which states the number of all.
LISTED = 100
#: Links of a component above one_task_nodes from which on its task gets them as numbers.
WIDE = 2_000_000


@dataclass
class Partition:
    """Membership (clusters numbered by name, then first member), hubs, decisions of auto, and warnings."""

    classes: DataFrame
    relations: DataFrame
    hubs: DataFrame
    membership: DataFrame
    decisions: DataFrame
    warnings: list[str]

    def edges(self) -> DataFrame:
        return account.classify(self.relations, self.membership)

    def summary(self) -> DataFrame:
        return account.summary(self.edges())

    def stats(self) -> DataFrame:
        return account.cluster_stats(self.edges(), self.membership)


@dataclass
class Prepared:
    """A graph ready to be split; pairs has each link once a relation, u < v, adj both ways and once."""

    classes: DataFrame
    relations: DataFrame
    degrees: DataFrame
    adj: DataFrame
    pairs: DataFrame


def prepare(classes: DataFrame, relations: DataFrame, degrees: DataFrame | None = None) -> Prepared:
    """degrees: what graph.nodes would make of these, if that has been counted already."""
    classes, pairs = stored(classes, "classes"), stored(graph.pairs(relations), "pairs")
    return Prepared(classes, relations, cut(graph.nodes(classes, relations) if degrees is None else degrees), graph.both_ways(pairs), pairs)


def numbered(labelled: DataFrame) -> DataFrame:
    """Membership: each (cluster_key, cluster_name) of a graph gets its place by name and first member."""
    heads = labelled.groupBy("graph_id", "cluster_key", "cluster_name").agg(F.min("alias").alias("first"))
    heads = heads.withColumn("cluster_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("cluster_name", "first", "cluster_key")))
    return labelled.join(heads.drop("first"), ["graph_id", "cluster_key", "cluster_name"]).select("graph_id", F.col("cluster_id").cast("int").alias("cluster_id"), "cluster_name", "alias")


def _rows_for(members: DataFrame, p: Prepared, by: list[str], links: DataFrame | None = None, linked: bool = True) -> DataFrame:
    """One table of node and edge rows for a grouped kernel: members with their names and degrees, and the pairs among them, maybe repeated.

    links: pairs that have both ends in one group, or neither among members.
    linked: whether the kernel looks at links.
    """
    names = p.classes.select("graph_id", "alias", "name")
    known = members.join(p.degrees.select("graph_id", "alias", "out_degree"), ["graph_id", "alias"], "left").join(names, ["graph_id", "alias"], "left")
    extra = [F.col(c) for c in members.columns if c not in ("graph_id", "alias")]
    nodes = known.select("graph_id", *extra, "alias", F.lit(None).cast("string").alias("v"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("name", "alias").alias("name"))
    if not linked:
        return nodes
    key = [c for c in by if c != "graph_id"]
    u = small(members.select("graph_id", F.col("alias").alias("u"), *key))
    if links is None:
        v = small(members.select("graph_id", F.col("alias").alias("v"), *[F.col(c).alias(f"__{c}") for c in key]))
        edges = p.pairs.join(u, ["graph_id", "u"]).join(v, ["graph_id", "v"])
        for c in key:
            edges = edges.where(F.col(c) == F.col(f"__{c}"))
    else:
        edges = links.join(u, ["graph_id", "u"])
    blank = [F.lit(None).cast(members.schema[c].dataType).alias(c) if c not in key else F.col(c) for c in members.columns if c not in ("graph_id", "alias")]
    edges = edges.select("graph_id", *blank, F.col("u").alias("alias"), "v", F.lit(0).cast("long").alias("out_degree"), F.lit(None).cast("string").alias("name"))
    return nodes.unionByName(edges)


def _local(frame: pd.DataFrame, options: SplitOptions) -> tuple[LocalGraph, pd.DataFrame]:
    nodes = frame[frame["v"].isna()]
    edges = frame[~frame["v"].isna()]
    return LocalGraph(list(zip(edges["alias"], edges["v"], strict=True)), dict(zip(nodes["alias"], nodes["out_degree"], strict=True)), dict(zip(nodes["alias"], nodes["name"], strict=True)), options.max_size), nodes


def _numbered(table: pa.Table, options: SplitOptions) -> ArrayGraph:
    """A component of the rows of _rows_for, all of whose nodes are among them."""
    names, (u, v) = coded(table["alias"], table["v"])
    aliases, linked = names.to_pylist(), v >= 0
    nodes = table.filter(pc.is_null(table["v"]))
    own = nodes["alias"].to_pylist()
    return ArrayGraph(aliases, u[linked], v[linked], dict(zip(own, nodes["out_degree"].to_pylist(), strict=True)), dict(zip(own, nodes["name"].to_pylist(), strict=True)), options.max_size)


_TAGGED = "graph_id string, cluster_key string, cluster_name string, alias string, chosen string, size long, prefix_cut long, leiden_cut long, prefix_satisfies boolean, leiden_satisfies boolean"
_CHOICE = ["chosen", "size", "prefix_cut", "leiden_cut", "prefix_satisfies", "leiden_satisfies"]


def _tagged(graph_id: str, clusters: list[tuple[str, list[str]]], decisions: list[dict], at: str) -> pd.DataFrame:
    rows = [(graph_id, f"{at}|{k}", name, m, *[None] * 6) for k, (name, ms) in enumerate(clusters) for m in ms]
    rows += [(graph_id, None, None, None, *[d[c] for c in _CHOICE]) for d in decisions]
    return pd.DataFrame(rows, columns=["graph_id", "cluster_key", "cluster_name", "alias", *_CHOICE])


def _decided(tagged: DataFrame, stage: str) -> DataFrame:
    return tagged.where("cluster_key IS NULL").select("graph_id", F.lit(stage).alias("stage"), *_CHOICE)


def _clusters(tagged: DataFrame) -> DataFrame:
    return tagged.where("cluster_key IS NOT NULL").select("graph_id", "cluster_key", "cluster_name", "alias")


_SPLIT = "settled boolean, stage string, now string, now_name string, event string, " + _TAGGED
_SETTLED = "graph_id string, cluster_key string, cluster_name string, alias string"


def _split_table(table: pa.Table, local: ArrayGraph, clusters: Clusters, options: SplitOptions, settle: bool, kinds: pa.Schema, shared: bool = False) -> pa.Table:
    """Rows of _SPLIT of a component's first clusters, refined if settle says so and other components have no part in that.

    shared: the graph's other components are split in the same way, so that a
    component that needs misc goes through its first round here: now and
    now_name are a node's cluster after that, size its size, and events say
    what must hold of misc.
    """
    graph_id, component = table["graph_id"][0].as_py(), table["component"][0].as_py()
    first = len(local.decisions)
    splitter = local.strategy(options.strategy)
    done, begun = None, None
    if settle and len(local.aliases) <= options.one_task_nodes:
        begun = first_round(clusters, local, options.min_size, options.max_size, splitter) if shared else None
        if begun and not begun[1].added:
            fits, begun = all(len(ms) <= options.max_size for _, ms in begun[0]) and in_order(begun[0]), None
            if fits:
                done = fits
            else:
                del local.decisions[first:]
        if not done and not begun:
            done = refine_alone(clusters, local, options.min_size, options.max_size, splitter)
    made = local.decisions[: None if done or begun else first]
    out = _tagged(graph_id, done or clusters, made, f"s|{component}")
    out["settled"] = bool(done)
    out["stage"] = [None] * (len(out) - len(made)) + ["initial"] * first + ["begun" if begun else "refine"] * (len(made) - first)
    for c in ("now", "now_name", "event"):
        out[c] = None
    if begun:
        after = {m: (f"b|{component}|{k}", name, len(ms)) for k, (name, ms) in enumerate(begun[0]) for m in ms}
        n = len(after)
        out["now"], out["now_name"], out["size"] = ([after[m][i] for m in out["alias"][:n]] + ([None] * (len(out) - n) if i < 2 else out["size"].tolist()[n:]) for i in range(3))
        rows = [(graph_id, False, name, size, event) for event, pairs in (("added", begun[1].added), ("asked", begun[1].asked)) for size, name in pairs]
        out = pd.concat([out, pd.DataFrame(rows, columns=["graph_id", "settled", "cluster_name", "size", "event"])], ignore_index=True)
    return pa.Table.from_pandas(out[kinds.names].astype(object).where(out[kinds.names].notna(), None), schema=kinds, preserve_index=False)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered links of components, packed."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for g in table["graph_id"].unique():
            own = table.filter(pc.equal(table["graph_id"], g))
            for c in own["component"].unique():
                rows = own.filter(pc.equal(own["component"], c))
                links = chunks(rows["ku"].to_numpy(), rows["kv"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.repeat(g, len(links)), pa.repeat(c, len(links)), links], ["graph_id", "component", "links"])


def _packed_split(options: SplitOptions, kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of _wide_split: rows of _SPLIT of a component's first clusters."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nodes = [], []
        for batch in batches:
            linked = batch.filter(pc.is_valid(batch["links"]))
            if linked.num_rows:
                parts.append(pairs_of(linked["links"]))
            nodes.append(batch.filter(pc.is_null(batch["links"])))
        table = pa.Table.from_batches(nodes)
        head = {c: table[c][0] for c in ("graph_id", "component")}
        k = table["k"].to_numpy()
        at = np.empty(k.max() + 1, np.int64)
        at[k] = np.arange(len(k))
        table = table.select(["alias", "name", "out_degree"]).take(pa.array(at)).combine_chunks()
        nodes.clear()
        aliases = table["alias"].combine_chunks()
        local = PackedGraph(parts, aliases, table["out_degree"].to_numpy(), table["name"].combine_chunks(), options.max_size)
        del table
        label, names = local.strategy(options.strategy)

        def rows(n: int, **held: pa.Array) -> pa.RecordBatch:
            held |= {"graph_id": pa.repeat(head["graph_id"], n), "settled": pa.repeat(False, n)}
            return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        for begin in range(0, len(aliases), 10_000):
            own = pa.array(label[begin : begin + 10_000])
            key = pc.binary_join_element_wise(f"s|{head['component'].as_py()}", own.cast(pa.string()), "|")
            yield rows(len(own), cluster_key=key, cluster_name=names.take(own), alias=aliases.slice(begin, 10_000))
        for d in local.decisions:
            yield rows(1, stage=pa.array(["initial"]), **{c: pa.array([d[c]]) for c in _CHOICE})

    return split


def _wide_split(p: Prepared, wide: DataFrame, options: SplitOptions, kinds: pa.Schema) -> DataFrame:
    """Rows of _SPLIT of components whose links are numbered by joins, so that a task gets eight bytes a link."""
    place = F.row_number().over(Window.partitionBy("graph_id", "component").orderBy("alias")) - 1
    nodes = stored(wide.select("graph_id", "component", "alias", place.alias("k")), "numbers")
    u = nodes.select("graph_id", F.col("alias").alias("u"), "component", F.col("k").alias("ku"))
    v = nodes.select("graph_id", F.col("alias").alias("v"), F.col("k").alias("kv"))
    links = p.pairs.join(by_node(u), ["graph_id", "u"]).join(by_node(v), ["graph_id", "v"]).select("graph_id", "component", "ku", "kv").mapInArrow(_chunked, "graph_id string, component string, links binary")
    known = nodes.join(by_node(p.degrees.select("graph_id", "alias", "out_degree")), ["graph_id", "alias"], "left").join(p.classes.select("graph_id", "alias", "name"), ["graph_id", "alias"], "left")
    rows = known.select("graph_id", "component", "k", "alias", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("name", "alias").alias("name"), F.lit(None).cast("binary").alias("links"))
    rows = rows.unionByName(stored(links, "links"), allowMissingColumns=True)
    return rows.groupBy("graph_id", "component").applyInArrow(_packed_split(options, kinds), _SPLIT)


def _rest(p: Prepared, tagged: DataFrame, options: SplitOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of graphs whose components went through the first round each in its task, where misc turns out to be as they took it; which graphs these are; and decisions.

    What is left of the rounds has to do with members of misc only, and takes one
    task a graph.
    """
    spark = p.classes.sparkSession
    none = spark.createDataFrame([], _SETTLED), spark.createDataFrame([], "graph_id string"), spark.createDataFrame([], schema.DECISIONS)
    members = tagged.where("alias IS NOT NULL")
    alike = members.groupBy("graph_id").agg(
        F.count("now").alias("begun"), F.count(F.when(F.col("now").isNull() & ~F.col("settled"), 1)).alias("other"), F.count(F.when(F.col("now_name") == MISC, 1)).alias("misc"),
        F.count(F.when(F.col("settled") | (F.col("now_name") != MISC), 1)).alias("outside"), F.coalesce(F.max(F.when(F.col("now_name") != MISC, F.col("size"))), F.lit(0)).alias("most"),
    )
    alike = cut(alike.where((F.col("begun") > 0) & (F.col("other") == 0) & (F.col("outside") > 0) & (F.col("misc") <= options.one_task_nodes)))
    if alike.isEmpty():
        return none

    def holds(frame: pd.DataFrame) -> pd.DataFrame:
        added, asked = ([*zip(own["size"].tolist(), own["cluster_name"].tolist(), strict=True)] for own in (frame[frame["event"] == e] for e in ("added", "asked")))
        return pd.DataFrame({"graph_id": frame["graph_id"].iloc[:1] if shared_holds(added, asked, options.max_size) else []}, dtype=object)

    events = tagged.where("event IS NOT NULL").select("graph_id", "event", "size", "cluster_name").join(small(alike.select("graph_id")), "graph_id", "left_semi")
    good = cut(alike.join(events.groupBy("graph_id").applyInPandas(holds, "graph_id string"), "graph_id"))
    if good.isEmpty():
        return none
    begun = members.where("now IS NOT NULL").join(small(good.select("graph_id")), "graph_id", "left_semi").select("graph_id", "alias", "now", "now_name", "size")
    misc = begun.where(F.col("now_name") == MISC).join(by_node(p.degrees.select("graph_id", "alias", "out_degree")), ["graph_id", "alias"]).join(p.classes.select("graph_id", "alias", "name"), ["graph_id", "alias"], "left")
    misc = small(cut(misc.select("graph_id", F.col("alias").alias("u"), "out_degree", F.coalesce("name", "alias").alias("name"))))
    ends = misc.select("graph_id", "u")
    near = cut(p.pairs.join(ends, ["graph_id", "u"]).unionByName(p.pairs.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")).join(ends, ["graph_id", "u"])).distinct())
    links = begun.withColumnRenamed("alias", "v").join(small(near), ["graph_id", "v"]).select("graph_id", "u", "v", "now", "now_name", "size")
    blank = {c: F.lit(None).cast(t) for c, t in (("v", "string"), ("now", "string"), ("now_name", "string"), ("size", "long"), ("out_degree", "long"), ("name", "string"))}
    rows = misc.select("graph_id", "u", *(blank[c].alias(c) for c in ("v", "now", "now_name", "size")), "out_degree", "name").unionByName(links.select("graph_id", "u", "v", "now", "now_name", "size", *(blank[c].alias(c) for c in ("out_degree", "name"))))
    over = (F.col("most") > options.max_size).alias("over")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = frame[frame["v"].isna()], frame[~frame["v"].isna()]
        local = LocalGraph(list(zip(ends["u"], ends["v"], strict=True)), dict(zip(nodes["u"], nodes["out_degree"].astype(int), strict=True)), dict(zip(nodes["u"], nodes["name"], strict=True)), options.max_size)
        outer = ends[ends["now_name"] != MISC]
        heads = {k: (name, int(n)) for k, name, n in zip(outer["now"], outer["now_name"], outer["size"], strict=True)}
        found = rest_of_rounds(sorted(nodes["u"], key=str.encode), local, heads, dict(zip(outer["v"], outer["now"], strict=True)), options.min_size, options.max_size, local.strategy(options.strategy), bool(frame["over"].iloc[0]))
        out = _tagged(frame["graph_id"].iloc[0], [(name, ms) for name, _, ms in found], local.decisions, "r")
        own = [head for _, head, ms in found for _ in ms]
        out["cluster_key"] = [head or key for head, key in zip(own, out["cluster_key"], strict=False)] + [None] * (len(out) - len(own))
        return out

    tagged = cut(rows.join(small(good.select("graph_id", over)), "graph_id").groupBy("graph_id").applyInPandas(work, _TAGGED))
    kept = begun.where(F.col("now_name") != MISC).select("graph_id", F.col("now").alias("cluster_key"), F.col("now_name").alias("cluster_name"), "alias")
    return kept.unionByName(_clusters(tagged)), good.select("graph_id"), _decided(tagged, "refine")


def seed_clusters(p: Prepared, excluded: DataFrame, seeds: DataFrame, options: SplitOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every node that isn't excluded goes to its nearest seed; what no seed reaches goes to misc.

    A component that one task holds is searched and refined there, if other
    components have no part in that.  Returns clusters, decisions, and the
    clusters that are refined already.
    """
    labels = components.connected(p.degrees, p.pairs, excluded)
    known = labels.join(seeds.select("graph_id", "alias", F.lit(True).alias("seed")), ["graph_id", "alias"], "left").join(by_node(p.degrees), ["graph_id", "alias"])
    own = Window.partitionBy("graph_id", "component")
    links = F.sum(F.col("in_degree") + F.col("out_degree")).over(own)
    kind = F.when(F.max("seed").over(own).isNull(), "none").when((F.count("*").over(own) <= options.one_task_nodes) & (links <= 2 * bfs.ONE_TASK), "task").otherwise("rounds")
    known = cut(known.select("graph_id", "alias", "component", "seed", kind.alias("kind")))
    shared = known.groupBy("graph_id").agg((F.bool_and(F.col("kind") == "task") & (F.count("*") > options.one_task_nodes)).alias("shared"))

    def split(table: pa.Table) -> pa.Table:
        local = _numbered(table, options)
        named = table.filter(pc.and_(pc.is_null(table["v"]), pc.fill_null(table["seed"], False)))["alias"].to_pylist()
        at = np.array(sorted(local.number[a] for a in named), np.int64)
        nearest, _ = bfs.nearest_places(local.source, local.target, at, len(local.aliases))
        held: dict[int, list[str]] = {}
        for alias, k in zip(local.aliases, nearest.tolist(), strict=True):
            held.setdefault(k, []).append(alias)
        return _split_table(table, local, in_order([(local.aliases[k], ms) for k, ms in held.items()]), options, options.one_task_nodes > 0, kinds, pc.any(table["shared"]).as_py() or False)

    kinds = to_arrow_schema(StructType.fromDDL(_SPLIT))
    rows = _rows_for(known.where("kind = 'task'").drop("kind").join(small(cut(shared)), "graph_id"), p, ["graph_id", "component"], graph.without(p.pairs, excluded))
    tagged = stored(rows.groupBy("graph_id", "component").applyInArrow(split, _SPLIT), "split")
    rest, graphs, made = _rest(p, tagged, options)
    decided = tagged.where("chosen IS NOT NULL AND stage <> 'begun'").select("graph_id", "stage", *_CHOICE).unionByName(made)
    decided = decided.unionByName(tagged.where("chosen IS NOT NULL AND stage = 'begun'").join(graphs, "graph_id", "left_semi").select("graph_id", F.lit("refine").alias("stage"), *_CHOICE))
    found = _clusters(tagged.where("NOT settled").join(graphs, "graph_id", "left_anti")).unionByName(known.where("kind = 'none'").select("graph_id", F.lit(f"z|{MISC}").alias("cluster_key"), F.lit(MISC).alias("cluster_name"), "alias"))
    wide = known.where("kind = 'rounds'")
    if not wide.isEmpty():
        near = bfs.nearest_seed(wide, p.pairs, wide.where("seed"), excluded)
        found = found.unionByName(near.select("graph_id", F.concat(F.lit("z|"), "seed").alias("cluster_key"), F.col("seed").alias("cluster_name"), "alias"))
    return found, decided, _clusters(tagged.where("settled")).unionByName(rest)


def component_clusters(p: Prepared, excluded: DataFrame, options: SplitOptions, only: DataFrame | None = None, settle: bool = False, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components without the excluded: small ones are clusters, large ones are split by the strategy, by prefix in columns, else each in a task of its own.

    labels: the components of all that isn't excluded, if they are known.

    settle: tasks also refine what they have split, where other components
    have no part in that.  Returns clusters, decisions, and the clusters that
    are refined already.
    """
    spark = p.classes.sparkSession
    none = spark.createDataFrame([], _SETTLED)
    labels = components.connected(p.degrees, p.pairs, excluded) if labels is None else labels
    if only is not None:
        labels = labels.join(only.select("graph_id", "alias"), ["graph_id", "alias"], "left_semi")
    labels = cut(labels.withColumn("n", F.count("*").over(Window.partitionBy("graph_id", "component"))))
    few, large = labels.where(F.col("n") <= options.max_size), labels.where(F.col("n") > options.max_size).select("graph_id", "alias", "component")
    names = graph.name_by_out_degree(few, p.degrees, "component")
    whole = few.join(names, ["graph_id", "component"]).select("graph_id", F.concat(F.lit("c|"), "component").alias("cluster_key"), "cluster_name", "alias", "n")

    if options.strategy == "prefix":
        shown = large.join(p.classes.select("graph_id", "alias", "name"), ["graph_id", "alias"], "left")
        by_name = prefix.prefix_clusters(shown, options.max_size, ["component"])
        key = F.concat_ws("|", F.lit("s"), "component", "cluster_name")
        return whole.drop("n").unionByName(by_name.select("graph_id", key.alias("cluster_key"), "cluster_name", "alias")), spark.createDataFrame([], schema.DECISIONS), none

    def split(table: pa.Table) -> pa.Table:
        local = _numbered(table, options)
        return _split_table(table, local, local.strategy(options.strategy)(local.aliases), options, settle, kinds)

    kinds = to_arrow_schema(StructType.fromDDL(_SPLIT))
    wide = cut(large.groupBy("graph_id", "component").agg(F.count("*").alias("n")).where(F.col("n") > options.one_task_nodes))
    if not wide.isEmpty():
        ends = large.join(small(wide), ["graph_id", "component"]).join(by_node(p.degrees), ["graph_id", "alias"]).groupBy("graph_id", "component").agg(F.sum(F.col("in_degree") + F.col("out_degree")).alias("ends"))
        wide = cut(ends.where(F.col("ends") > 2 * WIDE).select("graph_id", "component"))
    some = not wide.isEmpty()
    held = cut(large.join(small(wide), ["graph_id", "component"], "left_anti")) if some else large
    if some and held.isEmpty():
        tagged = spark.createDataFrame([], _SPLIT)
    else:
        rows = _rows_for(held, p, ["graph_id", "component"], graph.without(p.pairs, excluded) if only is None else None)
        tagged = rows.groupBy("graph_id", "component").applyInArrow(split, _SPLIT)
    if some:
        tagged = tagged.unionByName(_wide_split(p, large.join(small(wide), ["graph_id", "component"], "left_semi"), options, kinds))
    tagged = stored(tagged, "split")
    decided = tagged.where("cluster_key IS NULL").select("graph_id", "stage", *_CHOICE)
    if not settle:
        return whole.drop("n").unionByName(_clusters(tagged)), decided, none
    alone = (F.col("n") >= options.min_size) & (F.col("cluster_name") != MISC)
    rest, fine = whole.where(~alone).drop("n"), whole.where(alone).drop("n")
    return rest.unionByName(_clusters(tagged.where("NOT settled"))), decided, fine.unionByName(_clusters(tagged.where("settled")))


def cluster_parts(p: Prepared, membership: DataFrame, labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """(graph_id, cluster_id, parts): connected parts of what links make of each cluster's members.

    labels: the components of all that isn't excluded.  No part crosses them,
    so each is looked at in a task of its own, and a cluster's parts are added up.
    """
    placed = labels.join(by_node(membership.select("graph_id", "alias", "cluster_id")), ["graph_id", "alias"]).select("graph_id", "component", "cluster_id", "alias")
    nodes = placed.withColumn("v", F.lit(None).cast("string"))
    held = small(labels.select("graph_id", F.col("alias").alias("u"), "component"))
    links = graph.without(p.pairs, excluded).join(held, ["graph_id", "u"])
    rows = nodes.unionByName(links.select("graph_id", "component", F.lit(None).cast("int").alias("cluster_id"), F.col("u").alias("alias"), "v"))

    def count(table: pa.Table) -> pa.Table:
        names, (u, v) = coded(table["alias"], table["v"])
        own = v < 0
        cluster = np.zeros(len(names), np.int64)
        known = np.zeros(len(names), bool)
        cluster[u[own]], known[u[own]] = table["cluster_id"].fill_null(0).to_numpy()[own], True
        u, v = u[~own], v[~own]
        inner = known[u] & known[v] & (cluster[u] == cluster[v])
        label = components.least(u[inner], v[inner], len(names))
        heads, n = np.unique(cluster[np.flatnonzero(known & (label == np.arange(len(names))))], return_counts=True)
        return pa.table({"graph_id": pa.repeat(table["graph_id"][0], len(heads)), "cluster_id": pa.array(heads.astype(np.int32)), "parts": pa.array(n)})

    found = rows.groupBy("graph_id", "component").applyInArrow(count, "graph_id string, cluster_id int, parts long")
    return found.groupBy("graph_id", "cluster_id").agg(F.sum("parts").alias("parts"))


def refined(p: Prepared, labelled: DataFrame, options: SplitOptions, settled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The clusters of each graph brought within bounds.

    Graphs that are within them already are left alone.  Others of up to
    one_task_nodes nodes take a task each; in larger ones each cluster is split
    in a task of its own, and only sizes and link counts of clusters meet in
    one.  settled: clusters of the same graphs that are refined already and
    have no links to these.
    """
    spark = p.classes.sparkSession
    labelled = cut(labelled)
    if settled is not None and labelled.isEmpty():
        return settled, spark.createDataFrame([], schema.DECISIONS)
    if settled is None:
        settled = spark.createDataFrame([], _SETTLED)
    besides = cut(settled.select("graph_id", F.lit(True).alias("others")).distinct())
    sizes = labelled.groupBy("graph_id", "cluster_key", "cluster_name").agg(F.count("*").alias("n"))
    state = sizes.groupBy("graph_id").agg(F.count("*").alias("k"), F.sum("n").alias("nodes"), F.max("n").alias("most"), F.min(F.when(F.col("cluster_name") != MISC, F.col("n"))).alias("least"))
    state = state.join(besides, "graph_id", "left").withColumn("others", F.coalesce("others", F.lit(False)))
    todo = cut(state.where((F.col("most") > options.max_size) | ((F.col("k") > 1) | F.col("others")) & (F.col("least") < options.min_size)).select("graph_id", "nodes", "others"))
    few, large = todo.where(F.col("nodes") <= options.one_task_nodes), todo.where(F.col("nodes") > options.one_task_nodes)
    fine, members = labelled.join(todo, "graph_id", "left_anti"), cut(labelled.join(few.select("graph_id", "others"), "graph_id"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        local, nodes = _local(frame, options)
        groups: dict[tuple[str, str], list[str]] = {}
        for key, name, alias in zip(nodes["cluster_key"], nodes["cluster_name"], nodes["alias"], strict=True):
            groups.setdefault((key, name), []).append(alias)
        start = sorted(((name, sorted(ms, key=str.encode)) for (_, name), ms in groups.items()), key=lambda c: (c[0].encode(), c[1][0].encode()))
        out = refine(start, local, options.min_size, options.max_size, local.strategy(options.strategy), others=bool(nodes["others"].iloc[0]))
        return _tagged(frame["graph_id"].iloc[0], out, local.decisions, "r")

    linked = not members.isEmpty()
    tagged = cut(_rows_for(members, p, ["graph_id"], linked=linked).groupBy("graph_id").applyInPandas(work, _TAGGED))
    found, decided = settled.unionByName(fine).unionByName(_clusters(tagged)), _decided(tagged, "refine")
    if large.isEmpty():
        return found, decided
    more, made = _refined_by_rounds(p, labelled.join(large, "graph_id", "left_semi"), options, besides)
    return found.unionByName(more), decided.unionByName(made)


_PLACED = ["graph_id", "pos", "cluster_name", "stuck", "alias"]


def _split_round(p: Prepared, members: DataFrame, options: SplitOptions) -> tuple[DataFrame, DataFrame]:
    """Clusters above max_size that aren't known to be stuck are split, each in a task; parts take their cluster's place."""
    n = F.count("*").over(Window.partitionBy("graph_id", "pos"))
    sized = members.withColumn("n", n)
    over = (F.col("n") > options.max_size) & ~F.col("stuck")

    choice = _TAGGED[_TAGGED.index("chosen") :]
    made_of = f"graph_id string, pos int, part int, cluster_name string, stuck boolean, alias string, {choice}"
    kinds = to_arrow_schema(StructType.fromDDL(made_of))

    def split(table: pa.Table) -> pa.Table:
        local = _numbered(table, options)
        stuck: set[tuple[str, ...]] = set()
        name = next(x for x in table["cluster_name"].to_pylist() if x is not None)
        parts = split_large([(name, local.aliases)], options.max_size, local.strategy(options.strategy), stuck)
        head = {"graph_id": table["graph_id"][0].as_py(), "pos": table["pos"][0].as_py()}
        rows = [{**head, "part": k, "cluster_name": name, "stuck": tuple(ms) in stuck, "alias": m} for k, (name, ms) in enumerate(parts) for m in ms]
        return pa.Table.from_pylist(rows + [{**head, **d} for d in local.decisions], schema=kinds)

    todo = cut(sized.where(over).select("graph_id", "pos", "cluster_name", "alias"))
    if todo.isEmpty():
        return members, p.classes.sparkSession.createDataFrame([], schema.DECISIONS)
    rows = _rows_for(todo, p, ["graph_id", "pos"], linked=options.strategy != "prefix")
    made = cut(dealt(rows, "graph_id", "pos").groupBy("graph_id", "pos").applyInArrow(split, made_of))
    parts = made.where("alias IS NOT NULL").select("graph_id", "pos", "part", "cluster_name", "stuck", "alias")
    joined = sized.where(~over).select("graph_id", "pos", F.lit(0).alias("part"), "cluster_name", "stuck", "alias").unionByName(parts)
    place = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("pos", "part")) - 1
    return cut(joined.withColumn("pos", place).select(*_PLACED)), made.where("alias IS NULL").select("graph_id", F.lit("refine").alias("stage"), *_CHOICE)


@dataclass
class _Near:
    """The links of nodes (graph_id, u) that have been in a small cluster, both ways and once; later rounds ask for the same nodes mostly."""

    nodes: DataFrame | None = None
    links: DataFrame | None = None

    def of(self, p: Prepared, least: DataFrame) -> DataFrame:
        asked = least.select("graph_id", "u")
        more = asked if self.nodes is None else cut(asked.join(self.nodes, ["graph_id", "u"], "left_anti"))
        if self.nodes is None or not more.isEmpty():
            more = small(more)
            turned = p.pairs.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))
            found = stored(p.pairs.join(more, ["graph_id", "u"]).unionByName(turned.join(more, ["graph_id", "u"])).distinct(), "near")
            self.nodes, self.links = (more, found) if self.nodes is None else (self.nodes.unionByName(more), self.links.unionByName(found))
        return self.links.join(least, ["graph_id", "u"])


def _merge_round(p: Prepared, members: DataFrame, options: SplitOptions, besides: DataFrame, known: _Near) -> DataFrame:
    """Small clusters are merged on the quotient graph: a row a cluster and a row a pair of clusters of which one is small, as no other pair decides anything."""
    clusters = cut(members.groupBy("graph_id", "pos", "cluster_name").agg(F.count("*").alias("n")))
    few = clusters.where((F.col("n") < options.min_size) & (F.col("cluster_name") != MISC)).select("graph_id", "pos")
    if few.isEmpty():
        return members
    least = small(cut(members.join(small(few), ["graph_id", "pos"], "left_semi").select("graph_id", F.col("alias").alias("u"), "pos")))
    near = known.of(p, least)
    apart = near.join(by_node(members.select("graph_id", F.col("alias").alias("v"), F.col("pos").alias("other"))), ["graph_id", "v"]).where("pos <> other")
    links = cut(apart.groupBy("graph_id", "pos", "other").agg(F.count("*").alias("n"), F.min(F.struct("u", "v")).alias("first"), F.min(F.struct("v", "u")).alias("back")))
    to_large = links.join(small(few.withColumnRenamed("pos", "other")), ["graph_id", "other"], "left_anti")
    there = links.select("graph_id", "pos", "other", "n", "first.u", "first.v")
    there = there.unionByName(to_large.select("graph_id", F.col("other").alias("pos"), F.col("pos").alias("other"), "n", F.col("back.v").alias("u"), F.col("back.u").alias("v")))
    none = F.lit(None).cast("string")
    rows = clusters.join(small(besides), "graph_id", "left").select("graph_id", "pos", F.lit(-1).alias("other"), "n", "cluster_name", none.alias("u"), none.alias("v"), F.coalesce("others", F.lit(False)).alias("others"))
    rows = rows.unionByName(there.select("graph_id", "pos", "other", "n", none.alias("cluster_name"), "u", "v", F.lit(False).alias("others")))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        heads = frame[frame["other"] < 0].sort_values("pos")
        between: list[dict] = [{} for _ in range(len(heads))]
        links = frame[frame["other"] >= 0]
        for pos, other, n, u, v in zip(*(links[c].tolist() for c in ("pos", "other", "n", "u", "v")), strict=True):
            between[pos][other] = (n, (u.encode(), v.encode()))
        merged = merge_quotient(heads["cluster_name"].tolist(), heads["n"].tolist(), between, options.min_size, options.max_size, bool(heads["others"].iloc[0]))
        rows = [(frame["graph_id"].iloc[0], old, new, name, len(olds) > 1) for new, (name, olds) in enumerate(merged) for old in olds]
        return pd.DataFrame(rows, columns=["graph_id", "pos", "to", "name", "grown"])

    moved = rows.groupBy("graph_id").applyInPandas(merge, "graph_id string, pos int, to int, name string, grown boolean")
    return cut(members.join(moved, ["graph_id", "pos"]).select("graph_id", F.col("to").alias("pos"), F.col("name").alias("cluster_name"), (F.col("stuck") & ~F.col("grown")).alias("stuck"), "alias"))


def _refined_by_rounds(p: Prepared, labelled: DataFrame, options: SplitOptions, besides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refine for graphs that no one task should hold: a graph leaves the rounds when it is within bounds or a round has changed nothing."""
    start = numbered(labelled).select("graph_id", (F.col("cluster_id") - 1).alias("pos"), "cluster_name", F.lit(False).alias("stuck"), "alias")
    members, before, done, decisions, known = cut(start), None, None, None, _Near()
    for k in range(ROUNDS):
        members, made = _split_round(p, members, options)
        members = _merge_round(p, members, options, besides, known)
        decisions = made if decisions is None else decisions.unionByName(made)
        clusters = members.groupBy("graph_id", "pos", "cluster_name").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("alias")).alias("x"))
        kind = F.xxhash64("cluster_name", "n", "x")
        now = cut(clusters.groupBy("graph_id").agg(F.max("n").alias("most"), F.count("*").alias("k"), F.bit_xor(kind).alias("kinds")))
        over = now.where(F.col("most") <= options.max_size).select("graph_id")
        if before is not None:
            over = over.union(now.join(before, ["graph_id", "most", "k", "kinds"]).select("graph_id")).distinct()
        if k == ROUNDS - 1:
            over = now.select("graph_id")
        left = members.join(over, "graph_id", "left_semi")
        done = left if done is None else done.unionByName(left)
        members, before = cut(members.join(over, "graph_id", "left_anti")), now
        if members.isEmpty():
            break
    key = F.concat(F.lit("r|"), F.col("pos").cast("string"))
    return done.select("graph_id", key.alias("cluster_key"), "cluster_name", "alias"), decisions


def _listed(rows: DataFrame) -> tuple[int, str]:
    found = [r["alias"] for r in rows.select("alias").distinct().orderBy("alias").limit(LISTED).collect()]
    n = rows.select("alias").distinct().count() if len(found) == LISTED else len(found)
    return n, ", ".join(found) + (", …" if n > len(found) else "")


def _start(classes: DataFrame, relations: DataFrame, options: SplitOptions, degrees: DataFrame | None = None) -> tuple[Prepared, list[str]]:
    options.validate()
    p = prepare(classes, relations, degrees)
    if p.classes.isEmpty():
        raise PartitionError("No class declarations found in the input.")
    warnings = []
    for alias in options.forced_hubs:
        if p.degrees.where(F.col("alias") == alias).isEmpty():
            warnings.append(f"Forced hub {alias} is not in the graph.")
    return p, warnings


def _finish(p: Prepared, found: DataFrame, labelled: DataFrame, decisions: DataFrame, options: SplitOptions, warnings: list[str]) -> Partition:
    membership = cut(numbered(labelled))
    for alias in options.policy_overrides:
        if found.where(F.col("alias") == alias).isEmpty():
            warnings.append(f"Policy override for {alias}, which is not a hub, has no effect.")
    return Partition(p.classes, p.relations, found, membership, decisions, warnings)


def partition(classes: DataFrame, relations: DataFrame, options: SplitOptions | None = None, degrees: DataFrame | None = None) -> Partition:
    """By strategy: hubs out, components, split of large ones, refinement."""
    options = options or SplitOptions()
    p, warnings = _start(classes, relations, options, degrees)
    found = cut(hubs.detect(p.degrees, options))
    labelled, first, settled = component_clusters(p, found, options, settle=options.one_task_nodes > 0)
    labelled, second = refined(p, labelled, options, settled)
    return _finish(p, found, labelled, first.unionByName(second), options, warnings)


def partition_by_map(classes: DataFrame, relations: DataFrame, mapping: MapFile, options: SplitOptions | None = None) -> Partition:
    """By a map: mapped aliases are never hubs and mapped clusters never refined; the rest as the map's fallback says."""
    options = options or SplitOptions(strategy="map")
    p, warnings = _start(classes, relations, options)
    spark = classes.sparkSession
    rows = spark.createDataFrame([(c, a) for c, members in mapping.clusters.items() for a in members], "cluster_name string, alias string")
    unknown = rows.join(p.degrees.select("alias").distinct(), "alias", "left_anti")
    n, listed = _listed(unknown)
    if n:
        if mapping.fallback == "error":
            raise PartitionError(f"Map file references {n} alias(es) not present in the graph: {listed}.")
        warnings.append(f"Map file references {n} alias(es) not present in the graph (ignored): {listed}.")
    mapped = p.degrees.select("graph_id", "alias").join(F.broadcast(rows), "alias")
    found = cut(hubs.detect(p.degrees, options, mapped))
    labelled = mapped.select("graph_id", F.concat(F.lit("m|"), "cluster_name").alias("cluster_key"), "cluster_name", "alias")
    outside = labelled.groupBy("graph_id", "cluster_name").agg(F.count("*").alias("n")).where((F.col("n") < options.min_size) | (F.col("n") > options.max_size))
    # The map, and with it the number of its clusters, is in the driver already.
    for r in outside.orderBy("graph_id", "cluster_name").toLocalIterator():
        warnings.append(f'Mapped cluster "{r["cluster_name"]}" has {r["n"]} member(s), outside [{options.min_size}, {options.max_size}]; it is left as mapped.')
    taken = mapped.select("graph_id", "alias").unionByName(found.select("graph_id", "alias"))
    rest = cut(p.degrees.select("graph_id", "alias").join(taken, ["graph_id", "alias"], "left_anti"))
    decisions = spark.createDataFrame([], schema.DECISIONS)
    if not rest.isEmpty():
        if mapping.fallback == "error":
            n, listed = _listed(rest)
            raise PartitionError(f'Map file leaves {n} graph alias(es) unmapped and the fallback is "error": {listed}.')
        if mapping.fallback == "misc":
            other = rest.select("graph_id", F.lit("f|misc").alias("cluster_key"), F.lit(MISC).alias("cluster_name"), "alias")
        else:
            other, first, _ = component_clusters(p, taken, options)
            other, second = refined(p, other, options)
            decisions = first.unionByName(second)
        labelled = labelled.unionByName(other)
    return _finish(p, found, labelled, decisions, options, warnings)


def partition_by_seeds(classes: DataFrame, relations: DataFrame, options: SplitOptions, degrees: DataFrame | None = None) -> Partition:
    """By seeds: every node that is no hub goes to its nearest seed, then clusters are refined."""
    p, warnings = _start(classes, relations, options, degrees)
    spark = classes.sparkSession
    if MISC in options.seeds:
        raise PartitionError(f'Seed "{MISC}" is reserved.')
    named = list(dict.fromkeys(options.seeds))
    chosen = spark.createDataFrame([(s,) for s in named], "alias string")
    asked = p.degrees.select("graph_id").distinct().join(F.broadcast(chosen)) if named else None
    found = cut(hubs.detect(p.degrees, options, asked))
    if named:
        inside = p.degrees.select("graph_id", "alias").join(F.broadcast(chosen), "alias").select("graph_id", "alias")
        missing = chosen.join(inside.select("alias").distinct(), "alias", "left_anti")
        n, listed = _listed(missing)
        if n:
            near = bfs.suggestions(missing.select(F.lit("").alias("graph_id"), "alias"), p.degrees.select(F.lit("").alias("graph_id"), "alias").distinct())
            help_ = "; ".join(f"{r['unknown']}: did you mean {r['alias']}?" for r in near.orderBy("unknown", "dist", "alias").limit(LISTED).collect())
            raise PartitionError(f"Unknown seeds: {n} alias(es): {listed}." + (f" {help_}" if help_ else ""))
        seeds = inside
    else:
        seeds = bfs.auto_seeds(p.degrees, found, options.seed_threshold).select("graph_id", "alias")
        if seeds.isEmpty():
            most = p.degrees.join(found, ["graph_id", "alias"], "left_anti").agg(F.max("out_degree")).first()[0] or 0
            raise PartitionError(f"No seed has an out-degree of {options.seed_threshold} or more; the highest is {most}.")
    labelled, first, settled = seed_clusters(p, found, seeds, options)
    labelled, second = refined(p, labelled, options, settled)
    return _finish(p, found, labelled, first.unionByName(second), options, warnings)
