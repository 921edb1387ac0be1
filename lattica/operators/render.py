"""Diagram text out of a partition: cluster files, the overview and the index page.

Every line of every file is a row with a place; an ordered aggregation by file
puts them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import edge_color, escape_html, is_inheritance, slug, style_arrow, thickness
from lattica.options import SplitOptions
from lattica.session import cut
from lattica.sources.mapfile import unique_names

#: Fixed values of the format: colours with and without styling, layout directives, legend words.
SHARED = {True: "#FFF3E0;line:E65100", False: "#LightYellow"}
EXTERNAL = {True: "#F5F5F5;line:9E9E9E;line.dashed;text:9E9E9E", False: "#DDDDDD"}
DIRECTIVES = {"elk": ["!pragma layout elk"], "graphviz": ["skinparam linetype polyline", "skinparam nodesep 20", "skinparam ranksep 30"], "none": []}
COLORED_BY = {"target": "by target class", "source": "by source class", "pair": "by source/target pair"}
SHARED_FILE = "shared_types"


def head_line(kind: Column, name: Column, alias: Column, stereotype: Column, link: Column, color: Column) -> Column:
    """A declaration without body; the link stands before the colour."""
    title = F.concat(F.lit("  "), kind, F.lit(' "'), F.replace(name, F.lit('"'), F.lit("'")), F.lit('" as '), alias)
    return F.concat_ws(" ", title, stereotype, F.concat(F.lit("[["), link, F.lit("]]")), color)


def declaration_line(kind: Column, name: Column, alias: Column) -> Column:
    none = F.lit(None).cast("string")
    return head_line(kind, name, alias, none, none, none)


def with_body(head: Column, body: Column) -> Column:
    """The lines of a declaration: its head alone if the body is null, else with braces."""
    return F.when(body.isNull(), head).otherwise(F.array_join(F.concat(F.array(F.concat(head, F.lit(" {"))), body, F.array(F.lit("  }"))), "\n"))


def relation_line(source: Column, arrow: Column, target: Column, label: Column, src_mult: Column, dst_mult: Column, color: Column, width: Column) -> Column:
    quoted = lambda c: F.coalesce(F.concat(F.lit(' "'), c, F.lit('"')), F.lit(""))
    return F.concat(F.lit("  "), source, quoted(src_mult), F.lit(" "), style_arrow(arrow, color, width), quoted(dst_mult), F.lit(" "), target, F.coalesce(F.concat(F.lit(" : "), label), F.lit("")))


def slugs(membership: DataFrame) -> DataFrame:
    """(graph_id, cluster_id, cluster_name, slug): unique in each graph, in cluster order.

    Names of one slug are rare: the first keeps it, and graphs where two meet
    are numbered one by one, since x_2 may be a name of its own.
    """
    heads = membership.select("graph_id", "cluster_id", "cluster_name").distinct().withColumn("base", slug(F.col("cluster_name")))
    meet = heads.groupBy("graph_id", "base").count().where("count > 1").select("graph_id").distinct()

    def number(frame):
        frame = frame.sort_values("cluster_id")
        return frame.assign(slug=unique_names(list(frame["base"])))[["graph_id", "cluster_id", "cluster_name", "slug"]]

    fixed = heads.join(meet, "graph_id", "left_semi").groupBy("graph_id").applyInPandas(number, "graph_id string, cluster_id int, cluster_name string, slug string")
    return heads.join(meet, "graph_id", "left_anti").select("graph_id", "cluster_id", "cluster_name", F.col("base").alias("slug")).unionByName(fixed)


def shared_slugs(named: DataFrame, hubs: DataFrame) -> DataFrame:
    """(graph_id, shared_slug) of graphs with hubs that have a file of their own; unique beside the clusters' slugs."""
    some = hubs.where("policy = 'separate'").select("graph_id").distinct()
    taken = named.where(F.col("slug").startswith(SHARED_FILE)).groupBy("graph_id").agg(F.collect_set("slug").alias("taken"))
    free = F.expr(f"filter(concat(array('{SHARED_FILE}'), transform(sequence(2, size(taken) + 2), k -> concat('{SHARED_FILE}_', k))), x -> NOT array_contains(taken, x))[0]")
    return some.join(taken, "graph_id", "left").select("graph_id", F.when(F.col("taken").isNull(), F.lit(SHARED_FILE)).otherwise(free).alias("shared_slug"))


def files_of_members(membership: DataFrame, hubs: DataFrame) -> DataFrame:
    """(graph_id, slug, title, alias): members of each file; separate hubs have one together."""
    named = cut(slugs(membership))
    own = membership.join(named, ["graph_id", "cluster_id", "cluster_name"]).select("graph_id", "slug", F.col("cluster_name").alias("title"), "alias")
    apart = hubs.where("policy = 'separate'").join(shared_slugs(named, hubs), "graph_id").select("graph_id", F.col("shared_slug").alias("slug"), F.lit("shared-types").alias("title"), "alias")
    return own.unionByName(apart)


def file_edges(relations: DataFrame, members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Relations by file: those with a member at an end and no excluded hub at either; an edge is in one file or two."""
    gone = hubs.where("policy = 'exclude'").select("graph_id", "alias")
    for c in ("source", "target"):
        relations = relations.join(gone.withColumnRenamed("alias", c), ["graph_id", c], "left_anti")
    ends = []
    for c in ("source", "target"):
        ends.append(relations.join(members.select("graph_id", "slug", F.col("alias").alias(c)), ["graph_id", c]))
    a, b = ends
    inside = members.select("graph_id", "slug", F.col("alias").alias("source"))
    # From the target's side only what the source's side has not given already.
    return a.unionByName(b.join(inside, ["graph_id", "slug", "source"], "left_anti"))


def boundary(edges: DataFrame, members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(graph_id, slug, alias, kind, home): ends that are no members, once a file: shared hubs, or external with the slug of their home."""
    ends = edges.select("graph_id", "slug", F.explode(F.array("source", "target")).alias("alias")).distinct()
    outside = ends.join(members.select("graph_id", "slug", "alias"), ["graph_id", "slug", "alias"], "left_anti")
    homes = members.select("graph_id", "alias", F.col("slug").alias("home"))
    policies = hubs.select("graph_id", "alias", "policy")
    known = outside.join(policies, ["graph_id", "alias"], "left").join(homes, ["graph_id", "alias"], "left")
    return known.select("graph_id", "slug", "alias", F.when(F.col("policy") == "duplicate", "shared").otherwise("external").alias("kind"), F.when(F.coalesce(F.col("policy") != "duplicate", F.lit(True)), F.coalesce("home", F.lit("external"))).alias("home"))


def palette(edges: DataFrame, members: DataFrame, outside: DataFrame, mode: str) -> DataFrame:
    """(graph_id, slug, key, index): the place of each coloured key of a file in their order."""
    if mode == "pair":
        keys = edges.where(~is_inheritance(F.col("arrow"))).select("graph_id", "slug", F.concat_ws("\0", "source", "target").alias("key")).distinct()
    else:
        keys = members.select("graph_id", "slug", F.col("alias").alias("key")).unionByName(outside.select("graph_id", "slug", F.col("alias").alias("key"))).distinct()
    return keys.withColumn("index", F.row_number().over(Window.partitionBy("graph_id", "slug").orderBy("key")) - 1)


def _rows(df: DataFrame, section: int, line: Column, *order: Column) -> DataFrame:
    keys = [*order, *[F.lit("")] * (4 - len(order))]
    return df.select("graph_id", "slug", F.struct(F.lit(section).alias("section"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(F.col("rel_id") if "rel_id" in df.columns else F.lit(0), F.lit(0)).alias("n"), line.alias("line")).alias("x"))


def _files(rows: DataFrame, name: Column) -> DataFrame:
    """(graph_id, file_name, content): the lines of each file in the order of their places."""
    body = rows.groupBy("graph_id", "slug").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return body.select("graph_id", name.alias("file_name"), F.concat(F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def _each(df: DataFrame, section: int, texts: list[str]) -> list[DataFrame]:
    return [_rows(df, section, F.lit(t), F.lit(f"{k:06d}")) for k, t in enumerate(texts)]


def _opening(slugs_: DataFrame, first: Column, headers: DataFrame | None, options: SplitOptions) -> list[DataFrame]:
    """Start line, the document's headers, layout directives, then the user's headers."""
    parts = [_rows(slugs_, 0, first)]
    if headers is not None:
        own = slugs_.join(headers.select("graph_id", F.posexplode("headers").alias("pos", "header")), "graph_id")
        parts.append(_rows(own, 1, F.col("header"), F.lpad(F.col("pos").cast("string"), 9, "0")))
    return parts + _each(slugs_, 2, DIRECTIVES[options.layout]) + _each(slugs_, 3, list(options.headers))


def cluster_files(classes: DataFrame, relations: DataFrame, membership: DataFrame, hubs: DataFrame, options: SplitOptions, headers: DataFrame | None = None) -> DataFrame:
    """(graph_id, file_name, content): a file a cluster, and one for separate hubs."""
    styled = options.layout != "none"
    members = cut(files_of_members(membership, hubs))
    edges = cut(file_edges(relations, members, hubs))
    outside = cut(boundary(edges, members, hubs))
    known = classes.select("graph_id", "alias", "name", "kind", "body")
    none, kind, name = F.lit(None).cast("string"), F.coalesce("kind", F.lit("class")), F.coalesce("name", "alias")
    declared = members.join(known, ["graph_id", "alias"], "left")
    beyond = outside.withColumnRenamed("kind", "role").join(known, ["graph_id", "alias"], "left")
    shared, external = beyond.where("role = 'shared'"), beyond.where("role = 'external'")
    all_files = members.select("graph_id", "slug").distinct()
    parts = _opening(all_files, F.concat(F.lit("@startuml cluster-"), "slug"), headers, options)
    parts.append(_rows(shared.select("graph_id", "slug").distinct(), 4, F.lit("hide <<shared>> members")))
    parts.append(_rows(declared, 5, with_body(head_line(kind, name, F.col("alias"), none, none, none), F.col("body")), F.col("alias")))
    parts.append(_rows(shared, 6, with_body(head_line(kind, name, F.col("alias"), F.lit("<<shared>>"), none, F.lit(SHARED[styled])), F.col("body")), F.col("alias")))
    link = F.concat(F.lit("cluster-"), "home", F.lit(".svg")) if styled else none
    parts.append(_rows(external, 7, head_line(kind, name, F.col("alias"), F.concat(F.lit("<<external: "), "home", F.lit(">>")), link, F.lit(EXTERNAL[styled])), F.col("alias")))
    drawn, color, width = edges, none, F.lit(None).cast("int")
    if options.edge_color != "none":
        key = {"source": F.col("source"), "target": F.col("target"), "pair": F.concat_ws("\0", "source", "target")}[options.edge_color]
        drawn = edges.withColumn("key", key).join(palette(edges, members, outside, options.edge_color), ["graph_id", "slug", "key"], "left")
        color = F.when(~is_inheritance(F.col("arrow")), edge_color(F.col("index")))
        width = F.when(is_inheritance(F.col("arrow")), F.lit(2))
    line = relation_line(F.col("source"), F.col("arrow"), F.col("target"), F.col("label"), F.col("src_mult"), F.col("dst_mult"), color, width)
    parts.append(_rows(drawn, 8, line, F.col("source"), F.col("target"), F.col("arrow"), F.coalesce("label", F.lit(""))))
    if options.legend:
        n_members = members.groupBy("graph_id", "slug").agg(F.count("*").alias("m"))
        n_edges = edges.groupBy("graph_id", "slug").agg(F.count("*").alias("e"))
        roles = outside.groupBy("graph_id", "slug").agg(F.max(F.col("kind") == "shared").alias("s"), F.max(F.col("kind") == "external").alias("x"))
        facts = n_members.join(n_edges, ["graph_id", "slug"], "left").join(roles, ["graph_id", "slug"], "left")
        legend = F.array_compact(
            F.array(
                F.lit("legend bottom"), F.concat(F.lit("  "), F.col("m"), F.lit(" classes, "), F.coalesce("e", F.lit(0)), F.lit(" edges")),
                F.lit(f"  Edge color: {COLORED_BY[options.edge_color]}") if options.edge_color != "none" else none,
                F.when(F.col("s"), "  <<shared>>: hub duplicated here"), F.when(F.col("x"), "  <<external>>: defined in another cluster"), F.lit("endlegend"),
            )
        )
        parts.append(_rows(facts, 9, F.array_join(legend, "\n")))
    parts.append(_rows(all_files, 10, F.lit("@enduml")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _files(rows, F.concat(F.lit("cluster-"), "slug", F.lit(".puml")))


def overview(relations: DataFrame, membership: DataFrame, options: SplitOptions, headers: DataFrame | None = None) -> DataFrame:
    """(graph_id, file_name, content): a package a cluster, and the relations between clusters counted."""
    named = cut(slugs(membership))
    sizes = membership.groupBy("graph_id", "cluster_id").agg(F.count("*").alias("size"))
    views = named.join(sizes, ["graph_id", "cluster_id"])
    whole = views.select("graph_id").distinct().withColumn("slug", F.lit("overview"))
    own = membership.join(named.select("graph_id", "cluster_id", "slug"), ["graph_id", "cluster_id"])
    a = own.select("graph_id", F.col("alias").alias("source"), F.col("slug").alias("from"))
    b = own.select("graph_id", F.col("alias").alias("target"), F.col("slug").alias("to"))
    pairs = relations.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"]).where("from <> to").groupBy("graph_id", "from", "to").agg(F.count("*").alias("count"))
    pairs = pairs.withColumn("t", thickness(F.col("count"), F.max("count").over(Window.partitionBy("graph_id")))).withColumn("slug", F.lit("overview"))
    link = F.concat(F.lit(" [[cluster-"), "slug", F.lit(".svg]]")) if options.layout != "none" else F.lit("")
    title = F.concat(F.lit('  package "'), F.replace("cluster_name", F.lit('"'), F.lit("'")), F.lit(" ("), "size", F.lit(')" as '), "slug", link, F.lit(" {\n  }"))
    packages = views.select("graph_id", F.lit("overview").alias("slug"), F.col("slug").alias("of"), title.alias("line"))
    parts = _opening(whole, F.lit("@startuml overview"), headers, options)
    parts.append(_rows(packages, 5, F.col("line"), F.col("of")))
    parts.append(_rows(pairs, 8, F.concat(F.lit("  "), "from", F.lit(" -[thickness="), "t", F.lit("]-> "), "to", F.lit(" : "), "count"), F.col("from"), F.col("to")))
    parts.append(_rows(whole, 10, F.lit("@enduml")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _files(rows, F.lit("overview.puml"))


_CSS = "body{font-family:sans-serif;margin:2rem}h2{border-bottom:1px solid #ddd}.size{color:#888}ul{columns:3}td,th{border:1px solid #ccc;padding:.2rem .5rem}object{max-width:100%}"


def index_page(classes: DataFrame, membership: DataFrame, hubs: DataFrame, svg: bool = False) -> DataFrame:
    """(graph_id, file_name, content): a page with each cluster's members by display name, and the hubs."""
    members = cut(files_of_members(membership, hubs))
    shown = members.join(classes.select("graph_id", "alias", "name"), ["graph_id", "alias"], "left").withColumn("item", F.struct("alias", escape_html(F.coalesce("name", "alias")).alias("text")))
    cards = shown.groupBy("graph_id", "slug", "title").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count("*").alias("size"))
    picture = F.concat(F.lit('<object data="cluster-'), escape_html(F.col("slug")), F.lit('.svg" type="image/svg+xml"></object>\n')) if svg else F.lit("")
    lis = F.array_join(F.transform("items", lambda x: F.concat(F.lit("<li>"), x["text"], F.lit("</li>"))), "\n")
    card = F.concat(F.lit('<section class="cluster">\n<h2>'), escape_html(F.col("title")), F.lit(' <span class="size">('), "size", F.lit(")</span></h2>\n"), picture, F.lit("<ul>\n"), lis, F.lit("\n</ul>\n</section>"))
    counts = members.groupBy("graph_id").agg(F.count_distinct("slug").alias("c")).join(hubs.groupBy("graph_id").agg(F.count("*").alias("h")), "graph_id", "left")
    top = F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>Diagram map</title>\n<style>{_CSS}</style>\n</head>\n<body>\n<h1>Diagram map</h1>\n<section><h2>Overview</h2>\n' + ('<object data="overview.svg" type="image/svg+xml"></object>\n' if svg else "") + "<p>"),
        "c", F.lit(" clusters, "), F.coalesce("h", F.lit(0)), F.lit(" hubs.</p>\n</section>"),
    )
    some = hubs.select("graph_id").distinct()
    row = F.concat(F.lit("<tr><td>"), escape_html(F.col("alias")), *[x for c in ("in_degree", "out_degree", "reason", "policy") for x in (F.lit("</td><td>"), F.col(c).cast("string"))], F.lit("</td></tr>"))
    at = lambda df: df.withColumn("slug", F.lit("index"))
    parts = [
        _rows(at(counts), 0, top), _rows(at(cards.select("graph_id", F.col("slug").alias("of"), card.alias("line"))), 1, F.col("line"), F.col("of")),
        _rows(at(some), 2, F.lit("<section><h2>Hubs</h2><table>\n<tr><th>Alias</th><th>In</th><th>Out</th><th>Reason</th><th>Policy</th></tr>")),
        _rows(at(hubs), 3, row, F.col("alias")), _rows(at(some), 4, F.lit("</table></section>")), _rows(at(counts), 5, F.lit("</body>\n</html>")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _files(rows, F.lit("index.html"))


def output_files(partition, options: SplitOptions, headers: DataFrame | None = None) -> DataFrame:
    """Cluster files and the overview of a partition."""
    p = partition
    return cluster_files(p.classes, p.relations, p.membership, p.hubs, options, headers).unionByName(overview(p.relations, p.membership, options, headers))
