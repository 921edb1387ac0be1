"""What large graphs need: both ways of searching and labelling agree, and little is written down."""

import random
import tracemalloc
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from graphs import clique, tables
from pyspark.sql import functions as F

from lattica import session
from lattica.operators import bfs, community, components, graph, packed, refine
from lattica.options import SplitOptions
from lattica.plans import partition as plans
from lattica.sources import adapters


def some(spark, n=60, m=75, seed=3):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    classes, relations = tables(spark, edges + edges[:9])
    return plans.prepare(classes, relations), sorted({f"n{rng.randrange(n)}" for _ in range(20)} | {"n0"})


def got(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    f()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_nearest_seed_in_a_task_is_that_by_rounds(spark):
    p, names = some(spark)
    seeds = p.degrees.where(F.col("alias").isin(names)).select("graph_id", "alias")
    one, rounds = (got(bfs.nearest_seed(p.degrees, p.pairs, seeds, None, k)) for k in (bfs.ONE_TASK, 0))
    assert one == rounds and len(one) == p.degrees.count()


def test_pairs_take_little_room(spark):
    """Pairs take less than their names do as text."""
    edges = [(f"S{k % 50}", f"P{k}") for k in range(20_000)]
    classes, relations = tables(spark, edges)
    files = plans.prepare(classes, relations).pairs.inputFiles()
    assert sum(Path(f.removeprefix("file://").removeprefix("file:")).stat().st_size for f in files) < 20_000 * 14


def test_distances_in_a_task_are_those_by_rounds(spark):
    p, names = some(spark)
    seeds = p.degrees.where(F.col("alias").isin(names)).select("graph_id", "alias")
    blocked = p.degrees.where("alias IN ('n1', 'n2')")
    one, rounds = (got(bfs.distances(p.pairs, seeds, blocked, k)) for k in (bfs.ONE_TASK, 0))
    assert one == rounds


def test_distances_take_as_many_jobs_whatever_the_hops(spark):
    p = plans.prepare(*tables(spark, [(f"a{k:02}", f"a{k + 1:02}") for k in range(40)]))
    seeds = p.degrees.where("alias = 'a00'").select("graph_id", "alias")
    assert jobs(spark, "hops", lambda: bfs.distances(p.pairs, seeds).collect()) < 40


def test_components_by_forests_are_those_of_one_task(spark):
    p, _ = some(spark, 200, 150)
    one, forest, rounds = (got(components.connected(p.degrees, p.pairs, None, k)) for k in (components.SMALL_GRAPH, 10, 0))
    assert one == forest == rounds
    assert got(graph.both_ways(p.pairs)) == got(graph.adjacency(p.relations))


def test_forest_needs_no_rounds(spark):
    """One task takes the forest of a graph above the bound of edges; contraction took jobs for every pointer that it followed."""
    p = plans.prepare(*tables(spark, [(f"a{k:02}", f"a{k + 1:02}") for k in range(60)]))
    assert jobs(spark, "forest", lambda: components.connected(p.degrees, p.pairs, None, 50).collect()) < 20


def test_forest_goes_on_with_what_a_task_has_found(monkeypatch):
    """Links in no order: a task gives fewer rows than it has nodes, where each step gave as many as the nodes that it met."""
    rng = random.Random(5)
    fields = pa.schema([pa.field(c, pa.string(), nullable=False) for c in ("graph_id", "u", "v")])
    links = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(600)) if a != b]
    batches = [pa.RecordBatch.from_arrays([pa.array(["g"] * len(own)), *map(pa.array, zip(*own, strict=True))], schema=fields) for own in (links[k : k + 50] for k in range(0, len(links), 50))]
    monkeypatch.setattr(components, "STEP", 100)
    assert sum(b.num_rows for b in components._stars(iter(batches))) < 40


def test_matrix_moves_as_tables_do(monkeypatch):
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randrange(2, 50)
        weight = {}
        for _ in range(rng.randrange(400)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                weight[a, b] = weight[b, a] = rng.randrange(1, 9)
        keys = sorted(weight)
        of = community.Weighted(*(np.array(x, np.int64) for x in ([a for a, _ in keys], [b for _, b in keys], [weight[k] for k in keys], [rng.randrange(3) for _ in range(n)])))
        total = int(of.degrees().sum())
        monkeypatch.setattr(community, "DENSE", 10**9)
        assert community.local_moving(of, total).tolist() == community._moving_dense(of, total).tolist()


def mixed():
    """Components that refine by themselves, some that need misc, and one called misc."""
    rng = random.Random(11)
    edges = []
    for c in "abcdefgh":
        n = rng.randrange(8, 60)
        edges += [(f"{c}{k}", f"{c}{rng.randrange(k)}") for k in range(1, n)] + [(f"{c}{rng.randrange(n)}", f"{c}{rng.randrange(n)}") for _ in range(n)]
    return [*edges, ("x1", "x2"), ("misc", "y1"), ("y1", "y2"), ("z1", "z2"), ("z2", "z3")]


def split(spark, strategy, settle, monkeypatch):
    graphs = [tables(spark, edges, graph_id=f"g{k}") for k, edges in enumerate((mixed(), mixed()[:-5], [e for e in mixed() if e[0][0] in "ab"] + [("x1", "x2")]))]
    classes, relations = (reduce(lambda a, b: a.unionByName(b), of) for of in zip(*graphs, strict=True))
    options = SplitOptions(strategy=strategy, max_size=7, min_size=3, hub_threshold=99, hub_out_threshold=99)
    whole = plans.component_clusters
    with monkeypatch.context() as m:
        if not settle:
            m.setattr(plans, "component_clusters", lambda p, found, options, **_: whole(p, found, options))
        made = plans.partition(classes, relations, options)
        return got(made.membership), got(made.decisions)


@pytest.mark.parametrize("strategy", ["leiden", "louvain", "auto"])
def test_components_refined_where_they_are_split(spark, strategy, monkeypatch):
    """The same rows as by refining all of a graph's clusters together, whether misc takes part or not."""
    assert split(spark, strategy, True, monkeypatch) == split(spark, strategy, False, monkeypatch)


def test_refined_by_rounds_beside_settled_components(spark):
    """A lone small cluster goes to misc if the graph has others, also when these are settled."""
    p = plans.prepare(*tables(spark, [("a", "b")]))
    labelled = spark.createDataFrame([("g", "c|a", "a", "a"), ("g", "c|a", "a", "b")], "graph_id string, cluster_key string, cluster_name string, alias string")
    settled = spark.createDataFrame([("g", "s|x|0", "x", m) for m in ("x", "y", "z")], labelled.schema)
    for bound in (100, 0):
        for others, name in ((settled, "misc"), (None, "a")):
            found, _ = plans.refined(p, labelled, SplitOptions(one_task_nodes=bound), others)
            assert {r["cluster_name"] for r in found.where("alias IN ('a', 'b')").collect()} == {name}


def test_components_take_one_task_each(spark):
    """Large components of one graph are split and refined without a job that looks at the whole graph's links again."""
    p = tables(spark, [e for c in "abcd" for e in clique([f"{c}{k}" for k in range(12)])])
    one = jobs(spark, "settled", lambda: plans.partition(*p, SplitOptions(strategy="leiden", max_size=5, hub_threshold=99, hub_out_threshold=99)).membership.collect())
    rounds = jobs(spark, "rounds", lambda: plans.partition(*p, SplitOptions(strategy="leiden", max_size=5, hub_threshold=99, hub_out_threshold=99, one_task_nodes=0)).membership.collect())
    assert one < rounds


def test_clusters_split_in_rounds_take_many_tasks(spark):
    """Rows of many small clusters went into one task, which split them one after another."""
    rows = spark.createDataFrame([("g", k) for k in range(40)], "graph_id string, pos int")
    assert session.dealt(rows, "graph_id", "pos").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rounds_ask_for_links_once(spark, monkeypatch):
    """misc is too large, split, and made again in every round; the links of its nodes are those of the round before."""
    names = []
    monkeypatch.setattr(plans, "stored", lambda df, name, kept=plans.stored: (names.append(name), kept(df, name))[1])
    lone = [f"x{k:02}" for k in range(12)]
    p = tables(spark, clique([f"a{k}" for k in range(6)]), lone, {a: f"{'One' if k % 2 else 'Two'}{k}" for k, a in enumerate(lone)})
    made = {n: got(plans.partition(*p, SplitOptions(strategy="prefix", max_size=7, hub_threshold=99, hub_out_threshold=99, one_task_nodes=n)).membership) for n in (100, 0)}
    assert made[0] == made[100] and names.count("near") == 1


def test_seeds_are_searched_and_refined_in_a_task_each(spark):
    """The same rows as by rounds, in fewer jobs; one component has no seed."""
    p = tables(spark, [*(e for c in "abcd" for e in clique([f"{c}{k:02}" for k in range(12)])), ("y1", "y2")])
    seeds = tuple(f"{c}{k}" for c in "abcd" for k in ("00", "07"))
    made = []
    split = lambda n: plans.partition_by_seeds(*p, SplitOptions(strategy="seeds", seeds=seeds, max_size=5, hub_threshold=99, hub_out_threshold=99, one_task_nodes=n))
    one, rounds = (jobs(spark, f"seeds{n}", lambda n=n: made.append(got(split(n).membership))) for n in (100_000, 0))
    assert made[0] == made[1] and one < rounds


def test_parts_of_clusters(spark):
    p = plans.prepare(*tables(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("h", "a"), ("h", "c")]))
    of = {"a": 1, "b": 2, "c": 1, "d": 1, "x": 2, "y": 3}
    members = spark.createDataFrame([("g", k, str(k), a) for a, k in of.items()], "graph_id string, cluster_id int, cluster_name string, alias string")
    hub = p.degrees.where("alias = 'h'")
    labels = components.connected(p.degrees, p.pairs, hub)
    assert {(r["cluster_id"], r["parts"]) for r in plans.cluster_parts(p, members, labels, hub).collect()} == {(1, 2), (2, 2), (3, 1)}


def _stars_of(copies, seed):
    """Random components with twigs, so that refinement leaves nodes to misc; and a seed or two in each."""
    rng = random.Random(seed)
    edges, seeds = [], []
    for c in range(copies):
        names = [f"{chr(97 + rng.randrange(26))}{c:02}x{k:02}" for k in range(30)]
        edges += [(names[k], names[rng.randrange(max(1, k // 3 + 1))]) for k in range(1, 30)] + [(rng.choice(names), rng.choice(names)) for _ in range(12)]
        seeds += rng.sample(names, 2)
    return edges, tuple(seeds)


@pytest.mark.parametrize(("copies", "seed", "shared"), [(12, 1, True), (12, 2, True), (12, 3, True), (2, 4, None)])
def test_components_that_share_misc_take_a_task_each(spark, monkeypatch, copies, seed, shared):
    """Seeds: the rows are those of one task for all components, and no round looks at all links; where misc has room when a component asks, rounds do."""
    edges, seeds = _stars_of(copies, seed)
    p = tables(spark, edges)
    split = lambda n: plans.partition_by_seeds(*p, SplitOptions(strategy="seeds", seeds=seeds, max_size=6, min_size=3, hub_threshold=99, hub_out_threshold=99, one_task_nodes=n))
    whole = split(100_000)
    rounds = []
    monkeypatch.setattr(plans, "_refined_by_rounds", lambda *a, f=plans._refined_by_rounds: (rounds.append(1), f(*a))[1])
    apart = split(40)
    assert got(apart.membership) == got(whole.membership)
    assert got(apart.decisions) == got(whole.decisions)
    assert whole.membership.where("cluster_name = 'misc'").count() or shared is None
    assert shared is None or bool(rounds) != shared


def test_misc_without_room_holds():
    assert refine.shared_holds([(1, "a"), (2, "b"), (3, "c")], [(2, "c")], 4)
    assert not refine.shared_holds([(1, "a"), (2, "b"), (3, "c")], [(2, "a")], 4)
    assert not refine.shared_holds([(2, "b")], [(2, "b")], 3)


def test_degrees_of_trade_are_counted_once(spark, tmp_path):
    """Counts by key are those of the graph's own nodes, also for lines without a key or without a row of their part; and nothing else counts lines."""
    lines = [(1, 1), (1, 2), (2, 1), (1, 1), (None, 2), (3, None), (9, 9)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 3, 4)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, f"part {k}") for k in (1, 2, 3)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    classes, relations = adapters.trade(spark, str(tmp_path))
    counted, lines, degrees = adapters.trade_counted(spark, str(tmp_path))
    assert got(counted) == got(classes) and got(lines) == got(relations)
    assert got(degrees) == got(graph.nodes(classes, relations))
    assert degrees.columns == graph.nodes(classes, relations).columns and not any("lineitem" in f for f in degrees.inputFiles() + counted.inputFiles())


@pytest.mark.parametrize("step", [7, 50, 1_000_000])
def test_packed_clusters_are_those_of_tables(monkeypatch, step):
    monkeypatch.setattr(packed, "STEP", step)
    monkeypatch.setattr(packed, "LONG", min(step, 8))
    monkeypatch.setattr(packed, "FEW", 0 if step == 7 else 4)
    for seed in range(12):
        r = np.random.default_rng(seed)
        n, m = int(r.integers(2, 90)), int(r.integers(1, 400))
        u = r.integers(0, n, m)
        v = r.integers(0, n, m) if seed % 3 else np.minimum(u // 9 * 9 + r.integers(0, 9, m), n - 1)
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        aliases = sorted({f"{'PS'[i % 2]}{i}" for i in range(n)}, key=str.encode)
        names = {a: ("Ab" if i % 3 else "CdEf") + f"X{i % 7}y" * (i % 5 > 0) for i, a in enumerate(aliases)}
        out = {a: int(r.integers(0, 4)) for a in aliases}
        tables = community.ArrayGraph(aliases, u, v, out, names, 25)
        rows = pa.concat_arrays([packed.chunks(u[k::3], v[k::3]) for k in range(3)])
        local = packed.PackedGraph([packed.pairs_of(rows)], pa.array(aliases), np.array([out[a] for a in aliases]), pa.array([names[a] for a in aliases]), 25)
        for strategy in ("louvain", "leiden", "prefix", "auto"):
            label, called = local.strategy(strategy)
            assert tables.strategy(strategy)(aliases) == [(called[k].as_py(), [aliases[i] for i in np.flatnonzero(label == k)]) for k in range(len(called))]
        assert local.decisions == tables.decisions


def test_packed_links_take_few_bytes(monkeypatch):
    """Tables of weights take over a hundred bytes a link, and made a component's task fail by memory."""
    monkeypatch.setattr(packed, "STEP", 20_000)
    monkeypatch.setattr(packed, "SWEEPS", 2)
    r = np.random.default_rng(1)
    n, m = 10_000, 300_000
    u, v = r.integers(0, n // 20, m), r.integers(n // 20, n, m)
    aliases = pa.array([f"n{k:05}" for k in range(n)])
    tracemalloc.start()
    local = packed.PackedGraph(np.array_split(np.column_stack([u, v]).astype(np.int32), 30), aliases, np.zeros(n, np.int64), aliases, 25)
    assert tracemalloc.get_traced_memory()[1] < 40 * m
    tracemalloc.reset_peak()
    packed.local_moving(local.graph, 2 * m)
    assert tracemalloc.get_traced_memory()[1] < 20 * m
    tracemalloc.stop()


@pytest.mark.parametrize("strategy", ["louvain", "leiden", "auto"])
def test_wide_components_are_split_as_others(spark, monkeypatch, strategy):
    rng = random.Random(5)
    halves = []
    for g in ("g", "h"):
        edges = [(f"{c}{rng.randrange(60)}", f"{c}{rng.randrange(60)}") for c in "ab" for _ in range(150)] + [("x", "y")]
        halves.append(tables(spark, edges + edges[:9], names={f"a{k}": f"Ab{'CD'[k % 2]}e" for k in range(60)}, graph_id=g))
    p = plans.prepare(*(reduce(lambda x, y: x.unionByName(y), t) for t in zip(*halves, strict=True)))
    gone = p.degrees.where("alias IN ('a1', 'b2')")
    whole = plans.component_clusters(p, gone, SplitOptions(strategy=strategy))
    # Components of more than no nodes and 150 links, counted with those that hubs have, are wide, others aren't.
    for wide in (0, 155):
        monkeypatch.setattr(plans, "WIDE", wide)
        packed_too = plans.component_clusters(p, gone, SplitOptions(strategy=strategy, one_task_nodes=0))
        assert got(packed_too[0]) == got(whole[0])
        assert got(packed_too[1]) == got(whole[1])
