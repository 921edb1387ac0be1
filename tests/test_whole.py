"""The graph queries over all lines of lineitem, those without SQL against brute force."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from lattica.plans.queries import _TRADES, QUERIES


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return [(f"S{r[0]}", f"P{r[1]}") for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()]


@pytest.fixture(scope="module")
def near(lines):
    out = {}
    for a, b in lines:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def reached(near, start, blocked=frozenset()):
    dist, todo = {start: 0}, deque([start])
    while todo:
        u = todo.popleft()
        for v in near[u] - blocked:
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    return dist


def test_no_line_is_left_out(spark, sf_dir, lines):
    total = QUERIES["edge_accounting"](spark, sf_dir).first()
    assert total["total_edges"] == len(lines) and total["internal_edges"] + total["inter_cluster_edges"] + total["hub_edges"] == len(lines)
    for name in ("prefix", "louvain", "leiden", "auto", "seeds"):
        row = QUERIES[f"{name}_conservation"](spark, sf_dir).first()
        assert row["total_edges"] == row["accounted"] == len(lines)


def test_components(spark, sf_dir, near, lines):
    ins, outs = degrees(lines)
    blocked = hubs_of(near, ins, outs)
    found = {r["alias"]: r["component"] for r in QUERIES["components_large"](spark, sf_dir).collect()}
    assert found == {a: min(reached(near, a, blocked)) for a in near if a not in blocked}
    assert found == {r["alias"]: r["component"] for r in QUERIES["components_contracted"](spark, sf_dir).collect()}


def degrees(lines):
    ins, outs = {}, {}
    for a, b in lines:
        outs[a], ins[b] = outs.get(a, 0) + 1, ins.get(b, 0) + 1
    return ins, outs


def hubs_of(near, ins, outs):
    return {a for a in near if ins.get(a, 0) >= _TRADES.split.hub_threshold or outs.get(a, 0) >= _TRADES.split.hub_out_threshold}


def test_distances(spark, sf_dir, near, lines):
    ins, outs = degrees(lines)
    blocked = hubs_of(near, ins, outs)
    seeds = [a for a in near if outs.get(a, 0) >= _TRADES.seed_threshold and a not in blocked]
    want = {(s, a): d for s in seeds for a, d in reached(near, s, blocked).items()}
    assert blocked and seeds
    assert {(r["seed"], r["alias"]): r["dist"] for r in QUERIES["bfs_distances"](spark, sf_dir).collect()} == want
    nearest = {r["alias"]: r for r in QUERIES["nearest_seed"](spark, sf_dir).collect()}
    assert set(nearest) == set(near) - blocked
    for a, r in nearest.items():
        tied = [(d, -sum(want.get((s, v)) == d - 1 for v in near[a]), s) for (s, x), d in want.items() if x == a]
        assert (r["dist"], r["seed"]) == ((min(tied)[0], min(tied)[2]) if tied else (None, "misc"))


@pytest.mark.parametrize("strategy", ["louvain", "leiden"])
def test_communities_of_a_large_component(spark, sf_dir, near, strategy):
    rows = QUERIES[f"{strategy}_clusters"](spark, sf_dir).groupBy("alias").agg(F.count("*").alias("n")).collect()
    assert len(rows) > 150 and all(r["n"] == 1 for r in rows)
