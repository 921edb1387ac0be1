import random

from graphs import clique, local
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.operators.refine import merge_small, refine, split_large


def groups(clusters):
    return sorted(sorted(ms) for _, ms in clusters)


def named(prefix, n):
    return [f"{prefix}{k}" for k in range(1, n + 1)]


def connected(graph, members):
    seen, todo, inside = {members[0]}, [members[0]], set(members)
    while todo:
        for v in graph.near.get(todo.pop(), ()):
            if v in inside and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen == inside


def test_two_cliques():
    a, b = named("a", 5), named("b", 5)
    g = local([*clique(a), *clique(b), ("a1", "b1")])
    assert groups(g.louvain(a + b)) == groups(g.leiden(a + b)) == [a, b]


def test_three_cliques():
    parts = [named(x, 4) for x in "abc"]
    g = local([*(e for p in parts for e in clique(p)), ("a1", "b1"), ("b1", "c1"), ("a1", "c1")])
    assert groups(g.louvain([m for p in parts for m in p])) == parts


def test_whole_empty_single():
    g = local(clique(named("k", 5)))
    for f in (g.louvain, g.leiden):
        assert groups(f(named("k", 5))) == [named("k", 5)]
        assert f([]) == []
        assert f(["x"]) == [("x", ["x"])]


def test_dumbbell_traps_louvain_and_not_leiden():
    left, right, big = named("L", 3), named("R", 3), named("Bg", 10)
    g = local([*clique(left), *clique(right), *clique(big), ("L1", "R1")])
    everything = left + right + big
    assert sorted(len(ms) for _, ms in g.louvain(everything)) == [6, 10]
    assert left in groups(g.leiden(everything)) and right in groups(g.leiden(everything))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 30), st.integers(1, 60))
def test_covers_and_connectivity(seed, n, m):
    rng = random.Random(seed)
    members = [f"n{k:02d}" for k in range(n)]
    g = local([(a, b) for a, b in ((rng.choice(members), rng.choice(members)) for _ in range(m)) if a != b])
    for f in (g.louvain, g.leiden, g.prefix, g.auto):
        first = f(members)
        assert sorted(x for _, ms in first for x in ms) == members
        assert first == f(list(reversed(members)))
    assert all(connected(g, ms) for _, ms in g.leiden(members))


def test_prefix():
    def of(names, max_size):
        return local([], max_size).prefix(names)

    assert of(["OrderLine", "OrderHeader", "InvoiceLine", "Customer"], 10) == [("Customer", ["Customer"]), ("Invoice", ["InvoiceLine"]), ("Order", ["OrderHeader", "OrderLine"])]
    assert of(["OrderLineA", "OrderLineB", "OrderHeaderX"], 2) == [("OrderHeader", ["OrderHeaderX"]), ("OrderLine", ["OrderLineA", "OrderLineB"])]
    assert of(["OrderA", "OrderB", "OrderC"], 2) == [("Order", ["OrderA", "OrderB", "OrderC"])]
    assert of(["Tok001Tok009", "Tok001Tok010", "Tok002Tok011"], 10) == [("Tok001", ["Tok001Tok009", "Tok001Tok010"]), ("Tok002", ["Tok002Tok011"])]


def test_auto():
    x, y = named("x", 3), named("y", 3)
    edges = [*clique(x), *clique(y), ("x1", "y1")]
    g = local(edges, 10, dict(zip(x + y, ["FooA", "BarA", "BazA", "FooB", "BarB", "BazB"], strict=True)))
    assert groups(g.auto(x + y)) == [x, y]
    assert (g.decisions[0]["chosen"], g.decisions[0]["prefix_cut"], g.decisions[0]["leiden_cut"]) == ("leiden", 6, 1)
    z = named("z", 6)
    g = local(clique(z), 3, dict(zip(z, ["AlphaP", "AlphaQ", "AlphaR", "BetaP", "BetaQ", "BetaR"], strict=True)))
    assert groups(g.auto(z)) == [z[:3], z[3:]] and g.decisions[0]["chosen"] == "prefix" and not g.decisions[0]["leiden_satisfies"]
    g = local(edges, 10, dict(zip(x + y, ["XeeA", "XeeB", "XeeC", "YeeA", "YeeB", "YeeC"], strict=True)))
    g.auto(x + y)
    assert g.decisions[0]["chosen"] == "prefix"


def test_refine_splits():
    nodes = named("n", 6)
    g = local([])
    halves = lambda ms: [("partA", ms[: len(ms) // 2]), ("partB", ms[len(ms) // 2 :])]
    assert refine([("big", nodes)], g, 1, 5, halves) == [("partA", nodes[:3]), ("partB", nodes[3:])]
    for bad in (lambda ms: [("big", ms)], lambda ms: [("a", ms[:3]), ("b", ms[3:5])]):
        assert refine([("big", nodes)], g, 1, 5, bad) == [("big", nodes)]
    stuck = set()
    split_large([("big", nodes)], 5, lambda ms: [("big", ms)], stuck)
    assert stuck == {tuple(nodes)}


def test_refine_merges():
    b = named("b", 3)
    g = local([("a", "b1"), ("b1", "b2"), ("b2", "b3")])
    assert refine([("B", b), ("S", ["a"])], g, 3, 25, g.prefix) == [("B", ["a", *b])]
    g = local([("b1", "b2"), ("b2", "b3")])
    assert refine([("B", b), ("I", ["x"])], g, 3, 25, g.prefix) == [("B", b), ("misc", ["x"])]
    assert merge_small([("I", ["x"])], g, 3, 25) == [("I", ["x"])]


def test_refine_splits_misc_again():
    names = [f"Command_Foo{k}" for k in range(1, 16)] + [f"Controller_Bar{k}" for k in range(1, 16)]

    def by_kind(ms):
        kinds = {}
        for m in ms:
            kinds.setdefault(m.split("_")[0], []).append(m)
        return list(kinds.items())

    start = [(m, [m]) for m in names]
    out = refine(start, local([]), 3, 20, by_kind)
    assert sorted(m for _, ms in out for m in ms) == sorted(names) and all(len(ms) <= 20 for _, ms in out) and "misc" not in dict(out)
    assert [(n, len(ms)) for n, ms in refine(start, local([]), 3, 20, lambda ms: [("one", ms)])] == [("misc", 30)]
