import random

from graphs import clique, tables
from pyspark.sql import functions as F

from lattica.operators import account, bfs, components, graph, hubs
from lattica.options import SplitOptions


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_degrees_and_top(spark):
    classes, relations = tables(spark, [("Ann", "Zed"), ("Bob", "Zed"), ("Cyd", "Ann"), ("Dan", "Bob"), ("Ann", "Ghost")], ["Ann", "Bob", "Cyd", "Dan", "Zed"])
    nodes = graph.nodes(classes.where("alias <> 'Ghost'"), relations)
    found = {a: (i, o) for a, i, o in rows(nodes, "alias", "in_degree", "out_degree")}
    assert len(found) == 6 and found["Zed"] == (2, 0) and found["Ghost"] == (1, 0) and found["Cyd"] == (0, 1) and found["Ann"] == (1, 2)
    assert [r["alias"] for r in graph.top_by(nodes, "in_degree", 4).orderBy("rank").collect()] == ["Zed", "Ann", "Bob", "Ghost"]
    assert [r["alias"] for r in graph.top_by(nodes, "out_degree", 3).orderBy("rank").collect()] == ["Ann", "Bob", "Cyd"]
    assert graph.top_by(nodes, "out_degree", -1).count() == 0


def test_self_loops_count_twice_but_are_no_neighbours(spark):
    classes, relations = tables(spark, [("A", "A"), ("A", "B"), ("A", "B")])
    assert rows(graph.nodes(classes, relations), "alias", "in_degree", "out_degree") == [("A", 1, 3), ("B", 2, 0)]
    assert rows(graph.adjacency(relations), "u", "v") == [("A", "B"), ("B", "A")]
    assert rows(graph.neighbours(graph.adjacency(relations)), "alias") == [("A",), ("B",)]


def test_components(spark):
    classes, relations = tables(spark, [("A", "B"), ("B", "C"), ("D", "E"), ("A", "H"), ("D", "H")], ["F"])
    nodes, adj = graph.nodes(classes, relations), graph.adjacency(relations)
    out = nodes.where("alias = 'H'")
    for small in (10, 0):  # one task, and contraction
        assert rows(components.connected(nodes, adj, out, small), "alias", "component") == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D"), ("F", "F")]
        assert {c for _, c in rows(components.connected(nodes, adj, None, small), "alias", "component")} == {"A", "F"}


def test_components_of_random_graphs_agree(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{k}", f"p{k + 1}") for k in range(40)]
    classes, relations = tables(spark, edges)
    nodes, adj = graph.nodes(classes, relations), graph.adjacency(relations)
    assert rows(components.connected(nodes, adj, None, 0), "alias", "component") == rows(components.connected(nodes, adj), "alias", "component")


def test_hubs(spark):
    edges = [(f"X{k}", "A") for k in (1, 2, 3)] + [("B", f"W{k}") for k in (1, 2, 3)] + [(f"Z{k}", "C") for k in (1, 2, 3)] + [("C", f"V{k}") for k in (1, 2, 3)] + [("E", "P")] + [("F", f"Y{k}") for k in (1, 2, 3)] + [(f"X{k}", "G") for k in (4, 5, 6)] + [("D", "Q")]
    classes, relations = tables(spark, edges)
    options = SplitOptions(hub_threshold=3, hub_out_threshold=3, forced_hubs=("E", "G"), policy_overrides={"B": "exclude"})
    found = hubs.detect(graph.nodes(classes, relations), options)
    assert rows(found, "alias", "reason", "policy") == [("A", "in", "duplicate"), ("B", "out", "exclude"), ("C", "in+out", "duplicate"), ("E", "forced", "duplicate"), ("F", "out", "separate"), ("G", "forced", "duplicate")]
    assert rows(hubs.pure_out(found), "alias") == [("B",), ("F",)]
    assert rows(hubs.detect(graph.nodes(classes, relations), options, found.where("alias IN ('A', 'E')")), "alias") == [("B",), ("C",), ("F",), ("G",)]


def nearest(spark, edges, seeds):
    classes, relations = tables(spark, edges)
    nodes, adj = graph.nodes(classes, relations), graph.adjacency(relations)
    return dict(rows(bfs.nearest_seed(nodes, adj, nodes.where(F.col("alias").isin(*seeds))), "alias", "seed"))


def test_nearest_seed_ties(spark):
    assert nearest(spark, [("A", "P"), ("P", "Q"), ("Q", "X"), ("B", "X")], ["A", "B"])["X"] == "B"
    assert nearest(spark, [("A", "P1"), ("A", "P2"), ("B", "P3"), ("Y", "P1"), ("Y", "P2"), ("Y", "P3")], ["A", "B"])["Y"] == "A"
    assert nearest(spark, [("S1", "M"), ("M", "Z"), ("S2", "N"), ("N", "Z")], ["S2", "S1"])["Z"] == "S1"
    assert nearest(spark, [("A", "B"), ("C", "D")], ["A"])["D"] == "misc"


def test_accounting(spark):
    classes, relations = tables(spark, [("a", "b"), ("a", "c"), ("c", "d"), ("a", "H"), ("H", "H"), ("b", "a")])
    membership = spark.createDataFrame([("g", 1, "x", "a"), ("g", 1, "x", "b"), ("g", 2, "y", "c"), ("g", 2, "y", "d")], "graph_id string, cluster_id int, cluster_name string, alias string")
    edges = account.classify(relations, membership)
    assert rows(account.summary(edges), "internal_edges", "inter_cluster_edges", "hub_edges", "total_edges") == [(3, 1, 2, 6)]
    assert rows(account.cluster_stats(edges, membership), "cluster_name", "size", "internal_edges", "external_edges") == [("x", 2, 2, 1), ("y", 2, 1, 1)]
    assert rows(account.pair_counts(edges), "from_cluster", "to_cluster", "n", "thickness") == [(1, 2, 1, 1)]
    assert rows(account.cut_edges(graph.adjacency(relations), membership), "cut") == [(1,)]


def test_suggestions(spark):
    known = spark.createDataFrame([("g", a) for a in ("Order", "Orders", "Border", "Invoice")], "graph_id string, alias string")
    unknown = spark.createDataFrame([("g", "Ordr")], "graph_id string, alias string")
    assert [r["alias"] for r in bfs.suggestions(unknown, known).orderBy("dist", "alias").collect()] == ["Order", "Orders", "Border"]


def test_many_graphs_at_once(spark):
    a, b = tables(spark, clique(["a", "b", "c"]), graph_id="one"), tables(spark, [("a", "z")], graph_id="two")
    nodes = graph.nodes(a[0].union(b[0]), a[1].union(b[1]))
    adj = graph.adjacency(a[1].union(b[1]))
    assert rows(components.component_sizes(components.connected(nodes, adj)), "graph_id", "component", "size") == [("one", "a", 3), ("two", "a", 2)]
