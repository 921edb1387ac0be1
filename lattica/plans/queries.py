"""The query catalogue: one query for each operator over graphs derived from the tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import account, anonymize, bfs, components, graph, hubs, prefix, render
from lattica.options import SplitOptions
from lattica.plans import partition as plans
from lattica.session import cut, small
from lattica.sources import adapters, diagrams, mapfile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- SQL pieces -----------------------------------------------------------------

_TRADE = "SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target FROM lineitem"
_COORDER = "SELECT 'P' || a.l_partkey AS source, 'P' || b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"
_LINKS = "SELECT 'H' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"
_ORDERS = "SELECT 'O' || o_orderkey AS source, 'C' || o_custkey AS target FROM orders"
_GEO = "SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"
_STEPS = "SELECT DISTINCT 'U' || user_id AS source, 'U' || next AS target FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS next FROM events WHERE event_type = 'purchase') WHERE next IS NOT NULL"
_NODES = "nodes AS (SELECT alias, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source AS alias, 0 AS i, 1 AS o FROM rel UNION ALL SELECT target, 1, 0 FROM rel) GROUP BY alias)"
_ADJ = "adj AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM rel UNION ALL SELECT target, source FROM rel) WHERE u <> v)"
_NAMES = "names AS (SELECT 'S' || s_suppkey AS alias, s_name AS name FROM supplier UNION ALL SELECT 'P' || p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') FROM part)"
_TOKENS = "regexp_extract_all(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1|\\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z][a-z0-9]*|[0-9]+')"
_SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'cluster' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_') END"


def _with(rel: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}rel AS ({rel}), " + ", ".join([_NODES, _ADJ, *parts]) + " "


def _key(n: int) -> str:
    t = _TOKENS.format("shown")
    return f"CASE WHEN len({t}) = 0 THEN alias ELSE array_to_string(({t})[1:{n}], '') END"


def _prefix_sql(max_size: int) -> str:
    """prefix clusters of all nodes as pc(alias, cluster_name)."""
    return (
        f"{_NAMES}, shown AS (SELECT n.alias, coalesce(m.name, n.alias) AS shown FROM nodes n LEFT JOIN names m ON m.alias = n.alias), keyed AS (SELECT alias, {_key(1)} AS one, {_key(2)} AS two FROM shown), "
        f"sized AS (SELECT one, count(*) AS n, count(DISTINCT two) AS k FROM keyed GROUP BY one), pc AS (SELECT alias, CASE WHEN n > {max_size} AND k < n THEN two ELSE one END AS cluster_name FROM keyed JOIN sized USING (one))"
    )


_MEMBERS = "heads AS (SELECT cluster_name, CAST(row_number() OVER (ORDER BY cluster_name) AS INTEGER) AS cluster_id FROM (SELECT DISTINCT cluster_name FROM pc)), mem AS (SELECT alias, cluster_id, cluster_name FROM pc JOIN heads USING (cluster_name))"
#: Parts have 30 lines and suppliers 600, more or less, at every scale: the tails of both are the hubs of the trade graph, and what is left is one large component.
_HUBS = {"hub_threshold": 40, "hub_out_threshold": 660}
_IS_HUB = f"(in_degree >= {_HUBS['hub_threshold']} OR out_degree >= {_HUBS['hub_out_threshold']})"
_HUB = f"hub AS (SELECT alias, in_degree, out_degree, CASE WHEN in_degree >= {_HUBS['hub_threshold']} AND out_degree >= {_HUBS['hub_out_threshold']} THEN 'in+out' WHEN in_degree >= {_HUBS['hub_threshold']} THEN 'in' ELSE 'out' END AS reason FROM nodes WHERE {_IS_HUB})"
_CLASSIFIED = "cl AS (SELECT r.source, r.target, a.cluster_id AS fc, b.cluster_id AS tc, CASE WHEN a.cluster_id IS NULL OR b.cluster_id IS NULL THEN 'hub' WHEN a.cluster_id = b.cluster_id THEN 'internal' ELSE 'inter' END AS kind FROM rel r LEFT JOIN mem a ON a.alias = r.source LEFT JOIN mem b ON b.alias = r.target)"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _graph(adapter) -> Callable[[SparkSession, str], plans.Prepared]:
    def make(spark: SparkSession, sf_dir: str) -> plans.Prepared:
        classes, relations = adapter(spark, sf_dir)
        return plans.Prepared(classes, relations, graph.nodes(classes, relations), graph.adjacency(relations), graph.pairs(relations))

    return make


_all, _co, _orders, _geo, _steps, _links = (_graph(a) for a in (adapters.trade, adapters.coorder, adapters.orders, adapters.geo, adapters.steps, adapters.links))


@dataclass(frozen=True)
class _Source:
    """A graph of suppliers and parts, and the options it is split with."""

    adapter: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]
    split: SplitOptions
    prefix: SplitOptions
    seed_threshold: int
    counted: Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]]

    def make(self, spark: SparkSession, sf_dir: str) -> plans.Prepared:
        """Degrees and pairs are written down once: most queries read them several times."""
        return plans.prepare(*self.adapter(spark, sf_dir))


_TRADES = _Source(adapters.trade, SplitOptions(**_HUBS), SplitOptions(max_size=10, min_size=3, strategy="prefix", **_HUBS), 640, adapters.trade_counted)

# --- graph ----------------------------------------------------------------------

_add("graph_nodes", lambda s, d: _all(s, d).degrees.select("graph_id", "alias"), _with(_TRADE) + "SELECT 'trade' AS graph_id, alias FROM nodes")
_add("graph_degrees", lambda s, d: _all(s, d).degrees, _with(_TRADE) + "SELECT 'trade' AS graph_id, alias, in_degree, out_degree FROM nodes")
_add("graph_adjacency", lambda s, d: _co(s, d).adj, _with(_COORDER) + "SELECT 'coorder' AS graph_id, u, v FROM adj")
_add("graph_neighbours", lambda s, d: graph.neighbours(_co(s, d).adj).select("graph_id", "alias", F.array_join("neighbours", ",").alias("neighbours")), _with(_COORDER) + "SELECT 'coorder' AS graph_id, u AS alias, string_agg(v, ',' ORDER BY v) AS neighbours FROM adj GROUP BY u")
for _k, _c in (("in", "in_degree"), ("out", "out_degree")):
    _add(f"graph_topk_{_k}", lambda s, d, c=_c: graph.top_by(_all(s, d).degrees, c, 10), _with(_TRADE) + f"SELECT * FROM (SELECT 'trade' AS graph_id, alias, {_c} AS degree, CAST(row_number() OVER (ORDER BY {_c} DESC, alias) AS INTEGER) AS rank FROM nodes) WHERE rank <= 10")
_add("graph_counts", lambda s, d: (lambda p: p.degrees.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_relations")))(_geo(s, d)), _with(_GEO) + "SELECT 'geo' AS graph_id, count(*) AS n_nodes, CAST(sum(out_degree) AS BIGINT) AS n_relations FROM nodes")

# --- hubs -----------------------------------------------------------------------


def _hub_sql(graph_id: str, where: str = "TRUE", forced: str = "FALSE", policy: str = "CASE WHEN reason = 'out' THEN 'separate' ELSE 'duplicate' END") -> str:
    return (
        f"SELECT '{graph_id}' AS graph_id, alias, in_degree, out_degree, reason, forced, {policy} AS policy FROM (SELECT alias, in_degree, out_degree, {forced} AS forced, CASE WHEN {forced} THEN 'forced' WHEN in_degree >= 8 AND out_degree >= 20 THEN 'in+out' "
        f"WHEN in_degree >= 8 THEN 'in' ELSE 'out' END AS reason FROM nodes WHERE (in_degree >= 8 OR out_degree >= 20 OR {forced}) AND {where})"
    )


_FORCED = SplitOptions(forced_hubs=("U1", "U2"), hub_policy="exclude", policy_overrides={"U3": "duplicate", "U1": "separate"})
_add("hubs_default", lambda s, d: hubs.detect(_orders(s, d).degrees, SplitOptions()), _with(_ORDERS) + _hub_sql("orders"))
_add("hubs_forced_override", lambda s, d: hubs.detect(_steps(s, d).degrees, _FORCED), _with(_STEPS) + _hub_sql("steps", forced="(alias IN ('U1', 'U2'))", policy="CASE WHEN alias = 'U3' THEN 'duplicate' WHEN alias = 'U1' THEN 'separate' WHEN reason = 'out' THEN 'separate' ELSE 'exclude' END"))
_add("hubs_excluded", lambda s, d: (lambda p: hubs.detect(p.degrees, SplitOptions(), p.degrees.where("alias LIKE 'N1%'")))(_geo(s, d)), _with(_GEO) + _hub_sql("geo", where="NOT alias LIKE 'N1%'"))

_add("hubs_links", lambda s, d: hubs.detect(_links(s, d).degrees, SplitOptions()), _with(_LINKS) + _hub_sql("links"))
_add("hubs_pure_out", lambda s, d: hubs.pure_out(hubs.detect(_links(s, d).degrees, SplitOptions())).select("graph_id", "alias"), _with(_LINKS) + "SELECT 'links' AS graph_id, alias FROM nodes WHERE in_degree < 8 AND out_degree >= 20")

# --- components, distances, seeds -------------------------------------------------

_REACH = "reach(a, b) AS (SELECT alias, alias FROM {0} UNION SELECT r.a, adj.v FROM reach r JOIN adj ON adj.u = r.b WHERE adj.v IN (SELECT alias FROM {0}))"
_COMP = "comp AS (SELECT a AS alias, min(b) AS component FROM reach GROUP BY a)"


def _components(make, excluded: SplitOptions | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        p = make(s, d)
        return components.connected(p.degrees, p.pairs, hubs.detect(p.degrees, excluded) if excluded else None)

    return run


_of_orders = _with(_ORDERS, _REACH.format("nodes"), _COMP, recursive=True)
_add("components", _components(_orders), _of_orders + "SELECT 'orders' AS graph_id, alias, component FROM comp")
_add("components_minus_hubs", _components(_geo, SplitOptions()), _with(_GEO, "kept AS (SELECT alias FROM nodes WHERE in_degree < 8 AND out_degree < 20)", _REACH.format("kept"), _COMP, recursive=True) + "SELECT 'geo' AS graph_id, alias, component FROM comp")
_add("component_sizes", lambda s, d: components.component_sizes(_components(_orders)(s, d)), _of_orders + "SELECT 'orders' AS graph_id, component, count(*) AS size FROM comp GROUP BY component")
#: What the least node reaches, and nodes without neighbours: any other node would come out null.
_ONE = f"kept AS (SELECT alias FROM nodes WHERE NOT {_IS_HUB}), inner_adj AS (SELECT u, v FROM adj WHERE u IN (SELECT alias FROM kept) AND v IN (SELECT alias FROM kept)), hit(b) AS (SELECT min(u) FROM inner_adj UNION SELECT v FROM hit JOIN inner_adj ON u = b), comp AS (SELECT alias, CASE WHEN alias IN (SELECT b FROM hit) THEN (SELECT min(b) FROM hit) WHEN alias NOT IN (SELECT u FROM inner_adj) THEN alias END AS component FROM kept)"
_add("components_large", lambda s, d: _components(_TRADES.make, _TRADES.split)(s, d), _with(_TRADE, _ONE, recursive=True) + "SELECT 'trade' AS graph_id, alias, component FROM comp")


def _contracted(s: SparkSession, d: str) -> DataFrame:
    """The same by contraction, as for graphs that no one task should hold."""
    p = _TRADES.make(s, d)
    return components.connected(p.degrees, p.pairs, hubs.detect(p.degrees, _TRADES.split), small_graph=0)


_add("components_contracted", _contracted, ORACLES["components_large"])


def _named(s: SparkSession, d: str) -> DataFrame:
    p = _orders(s, d)
    return graph.name_by_out_degree(components.connected(p.degrees, p.pairs), p.degrees, "component")


_add("graph_name_by_out_degree", _named, _of_orders + "SELECT 'orders' AS graph_id, component, alias AS cluster_name FROM (SELECT component, alias, row_number() OVER (PARTITION BY component ORDER BY out_degree DESC, alias) AS k FROM comp JOIN nodes USING (alias)) WHERE k = 1")

_SEEDS = f"seeds AS (SELECT alias, out_degree FROM nodes WHERE out_degree >= {_TRADES.seed_threshold} AND NOT {_IS_HUB} AND alias <> 'misc')"
_WALK = f"kept AS (SELECT alias FROM nodes WHERE NOT {_IS_HUB}), walk(seed, alias, dist) AS (SELECT alias, alias, 0 FROM seeds UNION SELECT w.seed, adj.v, w.dist + 1 FROM walk w JOIN adj ON adj.u = w.alias WHERE w.dist < 12 AND adj.v IN (SELECT alias FROM kept)), dist AS (SELECT seed, alias, CAST(min(dist) AS INTEGER) AS dist FROM walk GROUP BY seed, alias)"
_NEAR = "prior AS (SELECT d.seed, d.alias, d.dist, (SELECT count(*) FROM adj JOIN dist e ON e.alias = adj.v AND e.seed = d.seed WHERE adj.u = d.alias AND e.dist = d.dist - 1) AS before FROM dist d), best AS (SELECT seed, alias, dist FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY dist, before DESC, seed) AS k FROM prior) WHERE k = 1)"


def _seeded(s: SparkSession, d: str, g: _Source = _TRADES) -> tuple[plans.Prepared, DataFrame, DataFrame]:
    p = g.make(s, d)
    found = cut(hubs.detect(p.degrees, g.split))
    return p, found, bfs.auto_seeds(p.degrees, found, g.seed_threshold)


def _distances(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    p, found, seeds = _seeded(s, d, g)
    return bfs.distances(p.pairs, seeds, found)


def _nearest(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    p, found, seeds = _seeded(s, d, g)
    return bfs.nearest_seed(p.degrees.join(found.select("graph_id", "alias"), ["graph_id", "alias"], "left_anti"), p.pairs, seeds, found)


_add("seeds_auto_select", lambda s, d, g=_TRADES: (lambda p: bfs.auto_seeds(p.degrees, hubs.detect(p.degrees, g.split), g.seed_threshold))(g.make(s, d)), _with(_TRADE, _SEEDS) + "SELECT 'trade' AS graph_id, alias, out_degree FROM seeds")
_add("bfs_distances", _distances, _with(_TRADE, _SEEDS, _WALK, recursive=True) + "SELECT 'trade' AS graph_id, seed, alias, dist FROM dist")
_add("nearest_seed", _nearest, _with(_TRADE, _SEEDS, _WALK, _NEAR, recursive=True) + "SELECT 'trade' AS graph_id, k.alias, coalesce(b.seed, 'misc') AS seed, b.dist FROM kept k LEFT JOIN best b ON b.alias = k.alias")


def _suggested(s: SparkSession, d: str) -> DataFrame:
    names = adapters.table(s, d, "nation").select(F.lit("nation").alias("graph_id"), F.col("n_name").alias("alias"))
    unknown = names.select("graph_id", F.concat(F.substring("alias", 2, 99), F.lit("x")).alias("alias"))
    return bfs.suggestions(unknown, names)


_add(
    "seed_suggestions", _suggested,
    "WITH k AS (SELECT n_name AS alias FROM nation), u AS (SELECT alias[2:] || 'x' AS unknown FROM k), d AS (SELECT unknown, alias, CAST(levenshtein(unknown, alias) AS INTEGER) AS dist FROM u, k) SELECT 'nation' AS graph_id, unknown, alias, dist FROM (SELECT *, row_number() OVER (PARTITION BY unknown ORDER BY dist, alias) AS r FROM d WHERE dist <= 3) WHERE r <= 3",
)

# --- prefix, scalars ---------------------------------------------------------------


def _prefixed(s: SparkSession, d: str, minus_hubs: bool = False, g: _Source = _TRADES) -> tuple[plans.Prepared, DataFrame, DataFrame]:
    p = g.make(s, d)
    members = p.degrees.select("graph_id", "alias").join(p.classes.select("graph_id", "alias", "name"), ["graph_id", "alias"], "left")
    found = cut(hubs.detect(p.degrees, g.prefix))
    if minus_hubs:
        members = members.join(found.select("graph_id", "alias"), ["graph_id", "alias"], "left_anti")
    return p, prefix.prefix_clusters(members, 10), found


def _membership(s: SparkSession, d: str, minus_hubs: bool = False, g: _Source = _TRADES) -> tuple[plans.Prepared, DataFrame, DataFrame]:
    p, clusters, found = _prefixed(s, d, minus_hubs, g)
    return p, cut(plans.numbered(clusters.select("graph_id", F.col("cluster_name").alias("cluster_key"), "cluster_name", "alias"))), found


_PC = (_prefix_sql(10), _MEMBERS)
_PC_HUBS = (_HUB, _prefix_sql(10).replace("FROM nodes n LEFT JOIN", "FROM (SELECT * FROM nodes WHERE alias NOT IN (SELECT alias FROM hub)) n LEFT JOIN"), _MEMBERS)
_add("prefix_clusters", lambda s, d, g=_TRADES: _prefixed(s, d, g=g)[1].select("graph_id", "alias", "cluster_name"), _with(_TRADE, _prefix_sql(10)) + "SELECT 'trade' AS graph_id, alias, cluster_name FROM pc")
_add(
    "prefix_tokens", lambda s, d: adapters.table(s, d, "part").select("p_partkey", F.array_join(text.tokens(F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.upper("p_brand"), F.lit("X1")), ), ",").alias("tokens")),
    f"SELECT p_partkey, array_to_string({_TOKENS.format('n')}, ',') AS tokens FROM (SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') || upper(p_brand) || 'X1' AS n FROM part)",
)
_add("slugs", lambda s, d: adapters.table(s, d, "part").select("p_partkey", text.slug(F.concat(F.lit("--"), F.col("p_name"), F.lit(" / "), F.col("p_type"))).alias("slug")), f"SELECT p_partkey, {_SLUG.format('n')} AS slug FROM (SELECT p_partkey, '--' || p_name || ' / ' || p_type AS n FROM part)")
_add("edge_colors", lambda s, d: adapters.table(s, d, "supplier").select("s_suppkey", text.edge_color(F.col("s_suppkey")).alias("color")), """
    WITH h AS (SELECT s_suppkey, fmod(s_suppkey * CAST(137.508 AS DOUBLE), CAST(360 AS DOUBLE)) AS hue FROM supplier), x AS (SELECT s_suppkey, CAST(floor(hue / 60) AS INTEGER) AS s, CAST(0.52 AS DOUBLE) AS c, CAST(0.52 AS DOUBLE) * (1 - abs(fmod(hue / 60, CAST(2 AS DOUBLE)) - 1)) AS x, CAST(0.14 AS DOUBLE) AS m FROM h),
    p AS (SELECT s_suppkey, CASE s WHEN 0 THEN [c, x, 0] WHEN 1 THEN [x, c, 0] WHEN 2 THEN [0, c, x] WHEN 3 THEN [0, x, c] WHEN 4 THEN [x, 0, c] ELSE [c, 0, x] END AS v, m FROM x)
    SELECT s_suppkey, printf('#%02X%02X%02X', CAST(round((v[1] + m) * 255) AS INTEGER), CAST(round((v[2] + m) * 255) AS INTEGER), CAST(round((v[3] + m) * 255) AS INTEGER)) AS color FROM p""")
_add("html_escape", lambda s, d: adapters.table(s, d, "events").select("event_id", text.escape_html(F.concat(F.col("props"), F.lit("<&'>"))).alias("escaped")), "SELECT event_id, replace(replace(replace(replace(replace(props || '<&''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM events")

# --- accounting -----------------------------------------------------------------------


def _accounted(s: SparkSession, d: str, g: _Source = _TRADES) -> tuple[DataFrame, DataFrame, plans.Prepared]:
    p, membership, _ = _membership(s, d, True, g)
    return account.classify(p.relations, membership), membership, p


_ACC = _with(_TRADE, *_PC_HUBS, _CLASSIFIED)
_add("edge_accounting", lambda s, d, g=_TRADES: account.summary(_accounted(s, d, g)[0]), _ACC + "SELECT 'trade' AS graph_id, count(*) FILTER (kind = 'internal') AS internal_edges, count(*) FILTER (kind = 'inter') AS inter_cluster_edges, count(*) FILTER (kind = 'hub') AS hub_edges, count(*) AS total_edges FROM cl")
_add(
    "cluster_stats", lambda s, d, g=_TRADES: (lambda a: account.cluster_stats(a[0], a[1]))(_accounted(s, d, g)),
    _ACC + "SELECT 'trade' AS graph_id, m.cluster_id, m.cluster_name, count(*) AS size, (SELECT count(*) FROM cl WHERE kind = 'internal' AND fc = m.cluster_id) AS internal_edges, (SELECT count(*) FROM cl WHERE kind = 'inter' AND (fc = m.cluster_id OR tc = m.cluster_id)) AS external_edges FROM mem m GROUP BY m.cluster_id, m.cluster_name",
)
_add(
    "cluster_pair_counts", lambda s, d, g=_TRADES: account.pair_counts(_accounted(s, d, g)[0]),
    _ACC + "SELECT 'trade' AS graph_id, from_cluster, to_cluster, n, CAST(CASE WHEN most <= 1 THEN 1 ELSE 1 + round(CAST(n - 1 AS DOUBLE) / (most - 1) * 3) END AS INTEGER) AS thickness FROM (SELECT fc AS from_cluster, tc AS to_cluster, count(*) AS n, max(count(*)) OVER () AS most FROM cl WHERE kind = 'inter' GROUP BY fc, tc)",
)
_add("cut_edges_prefix", lambda s, d, g=_TRADES: (lambda m: account.cut_edges(m[0].adj, m[1]))(_membership(s, d, g=g)), _with(_TRADE, *_PC) + "SELECT 'trade' AS graph_id, count(*) FILTER (a.cluster_id <> b.cluster_id) AS cut FROM adj JOIN mem a ON a.alias = u JOIN mem b ON b.alias = v WHERE u < v")
_add("oversized_clusters", lambda s, d, g=_TRADES: (lambda a: account.oversized(account.cluster_stats(a[0], a[1]), 5))(_accounted(s, d, g)), _ACC + ", sz AS (SELECT cluster_id, cluster_name, count(*) AS size FROM mem GROUP BY ALL HAVING count(*) > 5) SELECT 'trade' AS graph_id, count(*) AS n_oversized, arg_min(cluster_name, (-size) * 100000 + cluster_id) AS largest_name, max(size) AS largest_size FROM sz HAVING count(*) > 0")

# --- maps -----------------------------------------------------------------------------


def _map_rows(s: SparkSession, d: str) -> DataFrame:
    n, r = adapters.table(s, d, "nation"), adapters.table(s, d, "region")
    own = n.join(small(r), n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("cluster_name"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("alias"))
    extra = own.select("cluster_name", F.lit("N1").alias("alias")).distinct()
    return own.unionByName(extra).unionByName(own.select("cluster_name", F.lit("Ghost").alias("alias")).distinct())


_MAP = "map AS (SELECT r_name AS cluster_name, 'N' || n_nationkey AS alias FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT r_name, 'N1' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT r_name, 'Ghost' FROM nation JOIN region ON r_regionkey = n_regionkey)"
_add("map_assign", lambda s, d: _geo(s, d).degrees.join(small(_map_rows(s, d).distinct()), "alias").select("graph_id", "cluster_name", "alias"), _with(_GEO, _MAP) + "SELECT DISTINCT 'geo' AS graph_id, cluster_name, alias FROM map JOIN nodes USING (alias)")
_add("map_unknown", lambda s, d: _map_rows(s, d).select("alias").distinct().join(_geo(s, d).degrees, "alias", "left_anti"), _with(_GEO, _MAP) + "SELECT DISTINCT alias FROM map WHERE alias NOT IN (SELECT alias FROM nodes)")
_add("map_fallback_nodes", lambda s, d: (lambda p: p.degrees.join(small(_map_rows(s, d).select("alias").distinct()), "alias", "left_anti").join(hubs.detect(p.degrees, SplitOptions()).select("alias"), "alias", "left_anti").select("graph_id", "alias"))(_geo(s, d)), _with(_GEO, _MAP) + "SELECT 'geo' AS graph_id, alias FROM nodes WHERE alias NOT IN (SELECT alias FROM map) AND in_degree < 8 AND out_degree < 20")
_add("map_conflicts", lambda s, d: mapfile.conflicts(_map_rows(s, d)), f"WITH {_MAP} SELECT alias, count(DISTINCT cluster_name) AS n_clusters FROM map GROUP BY alias HAVING count(DISTINCT cluster_name) > 1")
_add("map_repeats", lambda s, d: mapfile.repeats(_map_rows(s, d)), f"WITH {_MAP} SELECT cluster_name, alias, count(*) AS n FROM map GROUP BY ALL HAVING count(*) > 1")

# --- output tables ----------------------------------------------------------------------


def _files(s: SparkSession, d: str, g: _Source = _TRADES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, plans.Prepared]:
    p, membership, found = _membership(s, d, True, g)
    members = render.files_of_members(membership, found)
    edges = render.file_edges(p.relations, members, found)
    return members, edges, render.boundary(edges, members, found), found, p


_FILES = _with(
    _TRADE, *_PC_HUBS,
    f"fm AS (SELECT {_SLUG.format('cluster_name')} AS slug, alias FROM mem UNION ALL SELECT 'shared_types', alias FROM hub WHERE reason = 'out')",
    "fe AS (SELECT DISTINCT r.k, f.slug, r.source, r.target FROM (SELECT *, row_number() OVER () AS k FROM rel) r JOIN fm f ON f.alias = r.source OR f.alias = r.target)",
    "fb AS (SELECT DISTINCT e.slug, x.alias FROM fe e, LATERAL (SELECT unnest([e.source, e.target]) AS alias) x WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.slug = e.slug AND fm.alias = x.alias))",
    "bd AS (SELECT fb.slug, fb.alias, CASE WHEN hub.reason <> 'out' THEN 'shared' ELSE 'external' END AS kind, CASE WHEN hub.reason <> 'out' THEN NULL ELSE coalesce(fm.slug, 'external') END AS home FROM fb LEFT JOIN hub ON hub.alias = fb.alias LEFT JOIN fm ON fm.alias = fb.alias)",
)
_add("edge_files", lambda s, d, g=_TRADES: _files(s, d, g)[1].groupBy("graph_id", "slug", "source", "target").agg(F.count("*").alias("n")), _FILES + "SELECT 'trade' AS graph_id, slug, source, target, count(*) AS n FROM fe GROUP BY ALL")
_add("boundary_stubs", lambda s, d, g=_TRADES: _files(s, d, g)[2], _FILES + "SELECT 'trade' AS graph_id, slug, alias, kind, home FROM bd")
_add("shared_hubs", lambda s, d, g=_TRADES: _files(s, d, g)[0].where("title = 'shared-types'"), _FILES + "SELECT 'trade' AS graph_id, slug, 'shared-types' AS title, alias FROM fm WHERE slug = 'shared_types'")
_add("palette", lambda s, d, g=_TRADES: (lambda f: render.palette(f[1], f[0], f[2], "target"))(_files(s, d, g)), _FILES + "SELECT 'trade' AS graph_id, slug, key, CAST(row_number() OVER (PARTITION BY slug ORDER BY key) - 1 AS INTEGER) AS index FROM (SELECT slug, alias AS key FROM fm UNION SELECT slug, alias FROM fb)")
_add("cluster_slugs", lambda s, d, g=_TRADES: render.slugs(_membership(s, d, g=g)[1]).select("graph_id", "cluster_name", "slug"), _with(_TRADE, *_PC) + f"SELECT DISTINCT 'trade' AS graph_id, cluster_name, {_SLUG.format('cluster_name')} AS slug FROM mem")


def _overview_edges(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    p, membership, _ = _membership(s, d, True, g)
    made = render.overview(p.relations, membership, SplitOptions(layout="none"))
    lines = made.select("graph_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where("line LIKE '%-[thickness=%'")


_add(
    "overview_edges", _overview_edges,
    _with(_TRADE, *_PC_HUBS, f"sm AS (SELECT alias, {_SLUG.format('cluster_name')} AS slug FROM mem)", "pr AS (SELECT a.slug AS f, b.slug AS t, count(*) AS n FROM rel JOIN sm a ON a.alias = source JOIN sm b ON b.alias = target WHERE a.slug <> b.slug GROUP BY ALL)")
    + "SELECT 'trade' AS graph_id, '  ' || f || ' -[thickness=' || CAST(CASE WHEN most <= 1 THEN 1 ELSE 1 + round(CAST(n - 1 AS DOUBLE) / (most - 1) * 3) END AS INTEGER) || ']-> ' || t || ' : ' || n AS line FROM (SELECT *, max(n) OVER () AS most FROM pr)",
)

def _overview_file(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    p, membership, _ = _membership(s, d, True, g)
    return render.overview(p.relations, membership, SplitOptions(layout="none"))


#: The whole file: packages by slug, then links by both slugs.
_add(
    "overview_file", _overview_file,
    _with(_TRADE, *_PC_HUBS, f"sm AS (SELECT alias, cluster_name, {_SLUG.format('cluster_name')} AS slug FROM mem)", "pr AS (SELECT a.slug AS f, b.slug AS t, count(*) AS n FROM rel JOIN sm a ON a.alias = source JOIN sm b ON b.alias = target WHERE a.slug <> b.slug GROUP BY ALL)",
          "ln AS (SELECT '  ' || f || ' -[thickness=' || CAST(CASE WHEN most <= 1 THEN 1 ELSE 1 + round(CAST(n - 1 AS DOUBLE) / (most - 1) * 3) END AS INTEGER) || ']-> ' || t || ' : ' || n AS line, f, t FROM (SELECT *, max(n) OVER () AS most FROM pr))",
          "pk AS (SELECT '  package \"' || cluster_name || ' (' || count(*) || ')\" as ' || slug || ' {' || chr(10) || '  }' AS line, slug FROM sm GROUP BY cluster_name, slug)")
    + "SELECT 'trade' AS graph_id, 'overview.puml' AS file_name, '@startuml overview' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY slug) FROM pk) || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY f, t) FROM ln) || chr(10) || '@enduml' || chr(10) AS content",
)

# --- text -----------------------------------------------------------------------------

#: Lines of a diagram out of lineitem, the same expression in both engines.
_LINE = (
    "CASE l_linenumber % 7 WHEN 0 THEN '@startuml x' WHEN 1 THEN '  S' || l_suppkey || ' ..> P' || l_partkey WHEN 2 THEN '  S' || l_suppkey || ' \"1\" .[#336699].> \"\" P' || l_partkey || ' : ' || l_returnflag WHEN 3 THEN '  P' || l_partkey || ' <|-[thickness=2]-- S' || l_suppkey "
    "WHEN 4 THEN '  abstract class \"Part' || l_partkey || '\" as P' || l_partkey || ' <<x>> {' WHEN 5 THEN '  interface \"S' || l_suppkey || '\" as S' || l_suppkey ELSE '  P' || l_partkey || ' <|--- S' || l_suppkey END"
)
_KEYED = "l_orderkey, l_linenumber"


def _text(s: SparkSession, d: str) -> DataFrame:
    return adapters.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LINE).alias("text"))


_add("classify_lines", lambda s, d: _text(s, d).select("l_orderkey", "l_linenumber", diagrams.line_class(F.col("text")).alias("class")), f"SELECT {_KEYED}, CASE l_linenumber % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'relation' WHEN 2 THEN 'relation' WHEN 3 THEN 'relation' WHEN 4 THEN 'declaration' WHEN 5 THEN 'declaration' ELSE 'other' END AS class FROM lineitem")
_add(
    "parse_relations", lambda s, d: (lambda t: t.where(F.col("text").rlike(diagrams.RELATION)).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in diagrams.relation_columns(F.col("text")).items()]))(_text(s, d)),
    f"SELECT {_KEYED}, CASE WHEN k = 3 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS source, CASE k WHEN 1 THEN '..>' WHEN 2 THEN '.[#336699].>' ELSE '<|-[thickness=2]--' END AS arrow, CASE WHEN k = 3 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS target, "
    "CASE WHEN k = 2 THEN l_returnflag END AS label, CASE WHEN k = 2 THEN '1' END AS src_mult, CASE WHEN k = 2 THEN '' END AS dst_mult FROM (SELECT *, l_linenumber % 7 AS k FROM lineitem) WHERE k IN (1, 2, 3)",
)
_add(
    "parse_declarations", lambda s, d: (lambda t: t.where(F.col("text").rlike(diagrams.DECLARATION)).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in diagrams.declaration_columns(F.col("text")).items()]))(_text(s, d)),
    f"SELECT {_KEYED}, CASE k WHEN 4 THEN 'abstract class' ELSE 'interface' END AS kind, CASE k WHEN 4 THEN 'Part' || l_partkey ELSE 'S' || l_suppkey END AS name, CASE k WHEN 4 THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS alias, CASE k WHEN 4 THEN '<<x>> {{' ELSE '' END AS rest FROM (SELECT *, l_linenumber % 7 AS k FROM lineitem) WHERE k IN (4, 5)",
)
_ARROWS = "CASE l_linenumber % 8 WHEN 0 THEN '..>' WHEN 1 THEN '.[#AA].>' WHEN 2 THEN '-[x]->' WHEN 3 THEN 'o-[x]-' WHEN 4 THEN '*--' WHEN 5 THEN '<|-[x]--' WHEN 6 THEN '<|.[x]..' ELSE '==>' END"
_add("arrow_canonical", lambda s, d: adapters.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.base_arrow(F.expr(_ARROWS)).alias("arrow")), f"SELECT {_KEYED}, CASE l_linenumber % 8 WHEN 0 THEN '..>' WHEN 1 THEN '..>' WHEN 2 THEN '-->' WHEN 3 THEN 'o--' WHEN 4 THEN '*--' WHEN 5 THEN '<|--' WHEN 6 THEN '<|..' END AS arrow FROM lineitem")
_add("arrow_styled", lambda s, d: adapters.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.style_arrow(F.expr(_ARROWS), F.lit("#336699"), F.lit(2)).alias("arrow")), f"SELECT {_KEYED}, CASE l_linenumber % 8 WHEN 0 THEN '.[#336699,thickness=2].>' WHEN 1 THEN '.[#336699,thickness=2].>' WHEN 2 THEN '-[#336699,thickness=2]->' WHEN 3 THEN 'o-[#336699,thickness=2]-' WHEN 4 THEN '*-[#336699,thickness=2]-' WHEN 5 THEN '<|-[#336699,thickness=2]--' WHEN 6 THEN '<|.[#336699,thickness=2]..' ELSE '==>' END AS arrow FROM lineitem")
_add(
    "write_relations", lambda s, d, g=_TRADES: g.adapter(s, d)[1].select("source", "target", render.relation_line(F.col("source"), F.col("arrow"), F.col("target"), F.lit("sells"), F.lit("1"), F.lit(None).cast("string"), F.lit("#336699"), F.lit(None).cast("int")).alias("line")),
    f"WITH rel AS ({_TRADE}) SELECT source, target, '  ' || source || ' \"1\" .[#336699].> ' || target || ' : sells' AS line FROM rel",
)
_add("write_declarations", lambda s, d: adapters.table(s, d, "part").select("p_partkey", render.with_body(render.head_line(F.lit("class"), F.col("p_name"), F.concat(F.lit("P"), "p_partkey"), F.lit("<<part>>"), F.lit("x.svg"), F.lit("#DDDDDD")), F.array(F.concat(F.lit("    "), "p_brand"))).alias("text")), "SELECT p_partkey, '  class \"' || replace(p_name, '\"', '''') || '\" as P' || p_partkey || ' <<part>> [[x.svg]] #DDDDDD {' || chr(10) || '    ' || p_brand || chr(10) || '  }' AS text FROM part")


def _round_trip(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    """The trade graph as diagrams, one a supplier, parsed again: what comes back."""
    classes, relations = g.adapter(s, d)
    own = relations.withColumn("graph_id", F.col("source"))
    ends = own.select("graph_id", F.explode(F.array("source", "target")).alias("alias")).distinct()
    parsed = diagrams.parse(adapters.diagram_text(classes.drop("graph_id").join(ends, "alias").select(*classes.columns), own))
    return parsed.select("graph_id", F.size("classes").cast("long").alias("n_classes"), F.size("relations").cast("long").alias("n_relations"), F.size("warnings").cast("long").alias("n_warnings"))


_add("diagram_round_trip", _round_trip, _with(_TRADE) + "SELECT source AS graph_id, count(DISTINCT target) + 1 AS n_classes, count(*) AS n_relations, CAST(0 AS BIGINT) AS n_warnings FROM rel GROUP BY source")

# --- parser: documents whose every line depends on the lines before it -------------------------

#: The lines of a document for each supplier, the same expressions in both engines, and by number what the parser makes of them.
_DOCUMENT = [
    "'before the start'",
    "'@startuml S' || s_suppkey",
    "'title Supplier ' || s_suppkey",  # 3: a header
    "'legend right'",
    "'class \"No\" as No'",
    "'endlegend'",
    "'package \"Nation ' || s_nationkey || '\" as N' || s_nationkey || ' {'",
    "'  abstract class \"' || s_name || '\" as S' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' <<external>>' ELSE ' <<supplier>>' END || ' [[x.svg]] #DDDDDD {'",
    "'    +key'",
    "'    +balance : ' || s_nationkey",
    "'  }'",
    "'}'",
    "'enum \"E\" as E' || s_suppkey || ' {one}'",
    "'interface \"I\" as I' || s_suppkey || ' odd words'",  # 14: a warning
    "'class \"Again\" as S' || s_suppkey",  # 15: a warning
    "'S' || s_suppkey || ' \"1\" ..> \"many\" E' || s_suppkey || ' : uses it'",
    "'I' || s_suppkey || ' <|-- S' || s_suppkey",
    "'not a line'",  # 18: passed through, with a warning
    "'}'",  # 19: the same
    "CASE WHEN s_suppkey % 3 = 0 THEN 'legend' WHEN s_suppkey % 3 = 1 THEN 'class \"Open\" as Open {' ELSE '' END",  # 20: what never ends
    "'@enduml'",
    "'class \"After\" as After'",
]


def _parsed(s: SparkSession, d: str) -> DataFrame:
    content = F.expr(" || chr(10) || ".join(_DOCUMENT))
    return diagrams.parse(adapters.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("graph_id"), content.alias("content")))


_ID = "'S' || s_suppkey AS graph_id"
_add(
    "parsed_classes",
    lambda s, d: diagrams.classes(_parsed(s, d)).select("graph_id", "alias", "name", "kind", F.array_join("body", "|").alias("body"), "package", "stereotype", "decl_line", diagrams.is_external(F.col("stereotype")).alias("external")),
    f"SELECT {_ID}, 'S' || s_suppkey AS alias, s_name AS name, 'abstract class' AS kind, '    +key|    +balance : ' || s_nationkey AS body, 'Nation ' || s_nationkey AS package, CASE WHEN s_suppkey % 2 = 0 THEN '<<external>>' ELSE '<<supplier>>' END AS stereotype, 8 AS decl_line, s_suppkey % 2 = 0 AS external FROM supplier "
    f"UNION ALL SELECT {_ID}, 'E' || s_suppkey, 'E', 'enum', 'one', NULL, NULL, 13, false FROM supplier UNION ALL SELECT {_ID}, 'I' || s_suppkey, 'I', 'interface', NULL, NULL, NULL, 14, false FROM supplier "
    f"UNION ALL SELECT {_ID}, 'Open', 'Open', 'class', '', NULL, NULL, 20, false FROM supplier WHERE s_suppkey % 3 = 1",
)
_add(
    "parsed_relations", lambda s, d: diagrams.relations(_parsed(s, d)).drop("raw"),
    f"SELECT {_ID}, 0 AS rel_id, 'S' || s_suppkey AS source, '..>' AS arrow, 'E' || s_suppkey AS target, 'uses it' AS label, '1' AS src_mult, 'many' AS dst_mult FROM supplier UNION ALL SELECT {_ID}, 1, 'I' || s_suppkey, '<|--', 'S' || s_suppkey, NULL, NULL, NULL FROM supplier",
)
_add("parsed_headers", lambda s, d: _parsed(s, d).select("graph_id", "start_line", F.array_join("headers", "|").alias("headers")), f"SELECT {_ID}, '@startuml S' || s_suppkey AS start_line, 'title Supplier ' || s_suppkey AS headers FROM supplier")
_add("parsed_passthrough", lambda s, d: diagrams.passthrough(_parsed(s, d)), f"SELECT {_ID}, 18 AS line_no, 'not a line' AS text FROM supplier UNION ALL SELECT {_ID}, 19, '}}' FROM supplier")
_add(
    "parsed_warnings", lambda s, d: diagrams.warnings(_parsed(s, d)),
    f"SELECT {_ID}, seq, text FROM supplier, LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS seq, unnest(['Ignored trailing content after declaration on line 14: odd words', 'Duplicate alias \"S' || s_suppkey || '\" on line 15 ignored.', 'Unrecognized line 18: not a line', 'Unrecognized line 19: }}', "
    "CASE s_suppkey % 3 WHEN 0 THEN 'Unterminated legend block starting near line 20.' WHEN 1 THEN 'Unterminated class body: reached @enduml before a closing brace near line 20.' END]) AS text) WHERE text IS NOT NULL",
)

# --- anonymiser ---------------------------------------------------------------------------


def _declared(s: SparkSession, d: str) -> DataFrame:
    return adapters.table(s, d, "part").select(F.lit("parts").alias("graph_id"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit("P"), "p_partkey").alias("alias"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("display"))


def _no_packages(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "graph_id string, line_no int, k int, name string")


_TM = f"decl AS (SELECT p_partkey AS line_no, 'P' || p_partkey AS alias, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') AS display FROM part), cells AS (SELECT line_no, 0 AS k, unnest({_TOKENS.format('alias')}) AS token, generate_subscripts({_TOKENS.format('alias')}, 1) AS pos FROM decl UNION ALL SELECT line_no, 1, unnest({_TOKENS.format('display')}), generate_subscripts({_TOKENS.format('display')}, 1) FROM decl), tm AS (SELECT token, CAST(row_number() OVER (ORDER BY min(line_no * 1000000 + k * 1000 + pos)) AS INTEGER) AS n, count(*) OVER () AS total FROM cells GROUP BY token), named AS (SELECT token, n, 'Tok' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(total AS VARCHAR))) AS INTEGER), '0') AS pseudonym FROM tm)"
_add("token_map", lambda s, d: anonymize.token_map(_declared(s, d), _no_packages(s)), f"WITH {_TM} SELECT 'parts' AS graph_id, token, n, pseudonym FROM named")
_add(
    "anonymized_names", lambda s, d: (lambda dec, none: anonymize.name_map(dec, none, anonymize.token_map(dec, none)))(_declared(s, d), _no_packages(s)),
    f"WITH {_TM}, nm AS (SELECT alias AS name FROM decl UNION SELECT display FROM decl), pt AS (SELECT name, unnest({_TOKENS.format('name')}) AS token, generate_subscripts({_TOKENS.format('name')}, 1) AS pos FROM nm) SELECT 'parts' AS graph_id, name, string_agg(pseudonym, '' ORDER BY pos) AS new_name FROM pt JOIN named USING (token) GROUP BY name",
)
_add(
    "degree_sequence", lambda s, d, g=_TRADES: anonymize.degree_sequence(g.adapter(s, d)[1].select("graph_id", F.col("raw").alias("text"))).select("graph_id", "edges", F.array_join(F.transform("in_degrees", lambda x: x.cast("string")), ",").alias("in_degrees"), F.array_join(F.transform("out_degrees", lambda x: x.cast("string")), ",").alias("out_degrees")),
    _with(_TRADE) + "SELECT 'trade' AS graph_id, CAST(sum(out_degree) AS BIGINT) AS edges, string_agg(CAST(in_degree AS VARCHAR), ',' ORDER BY in_degree) AS in_degrees, string_agg(CAST(out_degree AS VARCHAR), ',' ORDER BY out_degree) AS out_degrees FROM nodes",
)

_add("token_signature", lambda s, d: anonymize.token_signature(_declared(s, d)), f"WITH {_TM}, own AS (SELECT token, row_number() OVER (ORDER BY min(line_no * 1000 + pos)) - 1 AS id FROM cells WHERE k = 0 GROUP BY token) SELECT 'parts' AS graph_id, line_no, string_agg(CAST(id AS VARCHAR), '-' ORDER BY pos) AS signature FROM cells JOIN own USING (token) WHERE k = 0 GROUP BY line_no")

#: A document for each nation, and what it is with made-up members; # stands for the nation's key.
_WITH_MEMBERS = ["@startuml", 'class "A" as A# {', "  +old", '  class "X" as X {', "}", 'enum "E" as E# {', "  one", "}", '  interface "I" as I# {', "  +more", "  }", "A# ..> E#", "A# ..> I# : x", "@enduml"]
_MADE_UP = ["@startuml", 'class "A" as A# {', "  +attr1 : ?E#", "  +attr2 : ?I#", "  +__construct(attr1, attr2)", "}", 'enum "E" as E# {', "}", '  interface "I" as I# {', "    +getElementName(elementType)", "  }", "A# ..> E#", "A# ..> I# : x", "@enduml"]


def _text_of(lines: list[str]) -> str:
    return " || chr(10) || ".join(f"replace('{line}', '#', CAST(n_nationkey AS STRING))" for line in lines)


def _nation_documents(s: SparkSession, d: str) -> DataFrame:
    return adapters.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("graph_id"), F.expr(_text_of(_WITH_MEMBERS)).alias("content"))


_add("scrubbed_members", lambda s, d: anonymize.scrub_members(_nation_documents(s, d)), f"SELECT 'N' || n_nationkey AS graph_id, {_text_of(_MADE_UP)} AS content FROM nation")

# --- splits: rows by their own rules, and invariants that SQL can state -----------------------


def _split(strategy: str) -> Callable[..., plans.Partition]:
    def run(s: SparkSession, d: str, g: _Source = _TRADES) -> plans.Partition:
        classes, relations, degrees = g.counted(s, d)
        return plans.partition(classes, relations, replace(g.split, strategy=strategy), degrees)

    return run


def _local_clusters(strategy: str) -> Query:
    """Communities of the components above 25 nodes, before refinement."""

    def run(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
        p = plans.prepare(*g.adapter(s, d))
        found = hubs.detect(p.degrees, g.split)
        return plans.numbered(plans.component_clusters(p, found, replace(g.split, strategy=strategy))[0])

    return run


def _seed_split(s: SparkSession, d: str, g: _Source = _TRADES) -> plans.Partition:
    classes, relations, degrees = g.counted(s, d)
    return plans.partition_by_seeds(classes, relations, replace(g.split, strategy="seeds", seed_threshold=g.seed_threshold), degrees)


def _map_split(s: SparkSession, d: str, g: _Source = _TRADES) -> plans.Partition:
    mapping = mapfile.MapFile({"first": [f"S{k}" for k in range(1, 6)], "second": [f"S{k}" for k in range(6, 9)]}, "auto")
    return plans.partition_by_map(*g.adapter(s, d), mapping, replace(g.split, strategy="map"))


_SPLITS = {"prefix": _split("prefix"), "louvain": _split("louvain"), "leiden": _split("leiden"), "auto": _split("auto"), "seeds": _seed_split}
for _n, _m in _SPLITS.items():
    _add(f"{_n}_partition", lambda s, d, g=_TRADES, m=_m: m(s, d, g).membership)
    _add(f"{_n}_cover", lambda s, d, g=_TRADES, m=_m: m(s, d, g).membership.groupBy("graph_id", "alias").agg(F.count("*").alias("n")), _with(_TRADE) + "SELECT 'trade' AS graph_id, alias, CAST(1 AS BIGINT) AS n FROM nodes WHERE NOT " + _IS_HUB)
    _add(f"{_n}_conservation", lambda s, d, g=_TRADES, m=_m: m(s, d, g).summary().select("graph_id", "total_edges", (F.col("internal_edges") + F.col("inter_cluster_edges") + F.col("hub_edges")).alias("accounted")), _with(_TRADE) + "SELECT 'trade' AS graph_id, count(*) AS total_edges, count(*) AS accounted FROM rel")
_add("map_partition", lambda s, d, g=_TRADES: _map_split(s, d, g).membership)
_add("map_partition_mapped", lambda s, d, g=_TRADES: _map_split(s, d, g).membership.where("cluster_name IN ('first', 'second')").select("cluster_name", "alias"), _with(_TRADE) + "SELECT CASE WHEN CAST(alias[2:] AS INTEGER) < 6 THEN 'first' ELSE 'second' END AS cluster_name, alias FROM nodes WHERE alias IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8')")
_add(
    "prefix_split", lambda s, d: _local_clusters("prefix")(s, d).select("graph_id", "cluster_name", "alias"),
    _with(_TRADE, _ONE, _prefix_sql(25).replace("FROM nodes n LEFT JOIN", "FROM (SELECT alias FROM hit JOIN nodes ON alias = b) n LEFT JOIN"), recursive=True)
    + "SELECT 'trade' AS graph_id, cluster_name, alias FROM pc UNION ALL SELECT 'trade', alias, alias FROM kept WHERE alias NOT IN (SELECT b FROM hit)",
)
_add("louvain_clusters", _local_clusters("louvain"))
_add("auto_clusters", _local_clusters("auto"))
_add("leiden_clusters", _local_clusters("leiden"))
_add("refined_partition", lambda s, d, g=_TRADES: plans.partition(*g.adapter(s, d), replace(g.split, strategy="leiden", one_task_nodes=0)).membership)
_add("auto_decisions", lambda s, d, g=_TRADES: _split("auto")(s, d, g).decisions)


def _disconnected(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    """Leiden clusters whose induced graph is not connected: none."""
    p = g.make(s, d)
    found = cut(hubs.detect(p.degrees, g.split))
    labels = cut(components.connected(p.degrees, p.pairs, found))
    members = cut(plans.numbered(plans.component_clusters(p, found, replace(g.split, strategy="leiden"), labels=labels)[0]))
    parts = plans.cluster_parts(p, members, labels, found)
    return parts.agg(F.count(F.when(F.col("parts") > 1, 1)).alias("n_disconnected"))


_add("leiden_disconnected_count", _disconnected, "SELECT CAST(0 AS BIGINT) AS n_disconnected")


def _output(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    options = replace(g.split, strategy="prefix")
    return render.output_files(plans.partition(*g.adapter(s, d), options), options)


_add("output_files", _output)
_add("index_page", lambda s, d, g=_TRADES: (lambda p: render.index_page(p.classes, p.membership, p.hubs))(_split("prefix")(s, d, g)))


def _output_parses(s: SparkSession, d: str, g: _Source = _TRADES) -> DataFrame:
    """Warnings of parsing all cluster files again: none."""
    files = _output(s, d, g).where("file_name <> 'overview.puml'").select(F.col("file_name").alias("graph_id"), "content")
    return diagrams.parse(files).agg(F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("n_warnings"))


_add("output_parses_clean", _output_parses, "SELECT CAST(0 AS BIGINT) AS n_warnings")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes are hubs, why, and what policy applies."""
    p = _orders(spark, sf_dir)
    return hubs.detect(p.degrees, SplitOptions()).orderBy("alias")


