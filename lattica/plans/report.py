"""The plan report: what a split would do, as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import account
from lattica.options import SplitOptions
from lattica.plans.partition import Partition


def _table(head: list[str], rows: DataFrame, columns: list[str], order: list[str]) -> Iterator[str]:
    """All rows, one at a time, in columns as wide as their widest cell."""
    widest = rows.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    width = [max(len(h), widest[c] or 0) for h, c in zip(head, columns, strict=True)]
    cells = lambda r: "  ".join(str(c).ljust(w) for c, w in zip(r, width, strict=True)).rstrip()
    yield cells(head)
    yield cells(["-" * w for w in width])
    for r in rows.orderBy(*order).toLocalIterator():
        yield cells([r[c] for c in columns])


def report_lines(p: Partition, options: SplitOptions) -> Iterator[str]:
    """The report, line by line: rows come from the tables as they are printed."""
    edges = p.edges()
    stats = account.cluster_stats(edges, p.membership)
    s = account.summary(edges).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("internal_edges", "inter_cluster_edges", "hub_edges", "total_edges")]).first()
    n_relations = p.relations.count()
    yield from ["Split plan", f"Classes: {p.classes.count()}", f"Relations: {n_relations}", f"Strategy: {options.strategy}", f"Hubs: {p.hubs.count()}", f"Clusters: {stats.count()}"]
    if options.strategy == "auto":
        yield from ["", "Auto strategy (prefix or leiden)"]
        none = True
        for r in p.decisions.orderBy("graph_id", "stage", "size").toLocalIterator():
            none = False
            yield f"  {r['size']}-node group: prefix cut={r['prefix_cut']}{'' if r['prefix_satisfies'] else ' (oversized)'}, leiden cut={r['leiden_cut']}{'' if r['leiden_satisfies'] else ' (oversized)'}, chose {r['chosen']}"
        if none:
            yield "  (no component required splitting)"
    yield from ["", "Hubs"]
    if p.hubs.isEmpty():
        yield "  (none detected)"
    else:
        yield from _table(["Alias", "In-degree", "Out-degree", "Reason", "Policy"], p.hubs, ["alias", "in_degree", "out_degree", "reason", "policy"], ["graph_id", "alias"])
    yield from ["", "Clusters"]
    yield from _table(["Cluster", "Size", "Internal edges", "External edges"], stats, ["cluster_name", "size", "internal_edges", "external_edges"], ["graph_id", "cluster_id"])
    total = s["internal_edges"] + s["inter_cluster_edges"] + s["hub_edges"]
    yield from ["", f"Internal edges: {s['internal_edges']}", f"Inter-cluster edges: {s['inter_cluster_edges']}", f"Hub edges: {s['hub_edges']}", f"Total (must equal relations): {total} / {n_relations}"]
    for r in account.oversized(stats, options.max_size).orderBy("graph_id").toLocalIterator():
        yield f'{r["n_oversized"]} cluster(s) exceed max-size ({options.max_size}); the "{options.strategy}" strategy could not split them cleanly. Largest: {r["largest_name"]} ({r["largest_size"]}).'


def plan_report(p: Partition, options: SplitOptions) -> str:
    return "\n".join(report_lines(p, options)) + "\n"
