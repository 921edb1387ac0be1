"""Small graphs out of edge lists."""

from lattica import schema


def tables(spark, edges, nodes=(), names=None, graph_id="g"):
    """(classes, relations) with X→Y as `..>`, or (source, arrow, target)."""
    names = names or {}
    edges = [e if len(e) == 3 else (e[0], "..>", e[1]) for e in edges]
    declared = list(dict.fromkeys([*nodes, *(x for s, _, t in edges for x in (s, t))]))
    classes = spark.createDataFrame([(graph_id, a, names.get(a, a), "class", None, None, None, 0) for a in declared], schema.CLASSES)
    relations = spark.createDataFrame([(graph_id, k, s, a, t, None, None, None, f"{s} {a} {t}") for k, (s, a, t) in enumerate(edges)], schema.RELATIONS)
    return classes, relations


def clique(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def local(edges, max_size=25, names=None):
    from lattica.operators.community import LocalGraph

    out = {}
    for s, _ in edges:
        out[s] = out.get(s, 0) + 1
    return LocalGraph(edges, out, names, max_size)


def members(partition):
    found = {}
    for r in partition.membership.orderBy("cluster_id", "alias").collect():
        found.setdefault((r["cluster_id"], r["cluster_name"]), []).append(r["alias"])
    return [(name, ms) for (_, name), ms in sorted(found.items())]
