import json
import re

import pytest
from graphs import clique, members, tables
from pyspark.sql import functions as F

from lattica import svg
from lattica.cli import main
from lattica.operators import anonymize, render
from lattica.operators.anonymize import scrub_members
from lattica.options import PartitionError, SplitOptions
from lattica.plans.partition import partition, partition_by_map, partition_by_seeds
from lattica.plans.report import plan_report
from lattica.sources import diagrams, mapfile
from lattica.streaming.degrees import degree_stream, windowed_degrees

PARTS = ("Header", "Line", "Tax")


def small_diagram():
    """Two families of three, a logger that all use, and two loose types."""
    lines = ["@startuml shop"]
    for family, field in (("Invoice", "amount"), ("Order", "qty")):
        lines += [x for p in PARTS for x in (f'  class "{family}{p}" as {family}{p} {{', f"    -{field} : int", "  }")]
    lines += ['  class "Logger" as Logger {', "    +log(msg)", "  }", '  abstract class "AbstractLine" as AbstractLine', '  interface "Payable" as Payable']
    for family in ("Invoice", "Order"):
        lines += [f"  {family}Header ..> {family}Line", f"  {family}Header ..> {family}Tax", f"  {family}Line ..> {family}Tax", *(f"  {family}{p} ..> Logger" for p in PARTS)]
    lines += ["  InvoiceHeader ..> OrderHeader : refs", "  InvoiceLine <|-- AbstractLine", "  OrderLine <|.. Payable", "@enduml", ""]
    return "\n".join(lines)


OPTIONS = SplitOptions(max_size=3, min_size=2, hub_threshold=5, strategy="prefix", layout="none", edge_color="none", legend=False)


@pytest.fixture(scope="module")
def shop(spark):
    parsed = diagrams.parse(diagrams.from_text(spark, small_diagram(), "shop")).cache()
    return diagrams.classes(parsed), diagrams.relations(parsed), parsed


@pytest.fixture(scope="module")
def shop_split(shop):
    return partition(shop[0], shop[1], OPTIONS)


def test_partition(shop_split):
    assert members(shop_split) == [("Invoice", ["InvoiceHeader", "InvoiceLine", "InvoiceTax"]), ("Order", ["OrderHeader", "OrderLine", "OrderTax"]), ("misc", ["AbstractLine", "Payable"])]
    s = shop_split.summary().first()
    assert (s["internal_edges"], s["inter_cluster_edges"], s["hub_edges"], s["total_edges"]) == (6, 3, 6, 15)
    report = plan_report(shop_split, OPTIONS)
    assert "15 / 15" in report and "Logger" in report


def test_files(shop, shop_split):
    files = {r["file_name"]: r["content"] for r in render.output_files(shop_split, OPTIONS, shop[2].select("graph_id", "headers")).collect()}
    assert set(files) == {"cluster-invoice.puml", "cluster-order.puml", "cluster-misc.puml", "overview.puml"}
    assert files["cluster-misc.puml"] == "\n".join([
        "@startuml cluster-misc", '  abstract class "AbstractLine" as AbstractLine', '  interface "Payable" as Payable', '  class "InvoiceLine" as InvoiceLine <<external: invoice>> #DDDDDD',
        '  class "OrderLine" as OrderLine <<external: order>> #DDDDDD', "  InvoiceLine <|-- AbstractLine", "  OrderLine <|.. Payable", "@enduml", "",
    ])
    invoice = files["cluster-invoice.puml"].split("\n")
    assert invoice[:2] == ["@startuml cluster-invoice", "hide <<shared>> members"]
    assert '  class "Logger" as Logger <<shared>> #LightYellow {' in invoice and "    +log(msg)" in invoice and "  InvoiceHeader ..> OrderHeader : refs" in invoice
    assert files["overview.puml"].split("\n")[1:-2] == ['  package "Invoice (3)" as invoice {', "  }", '  package "misc (2)" as misc {', "  }", '  package "Order (3)" as order {', "  }", "  invoice -[thickness=1]-> misc : 1", "  invoice -[thickness=1]-> order : 1", "  order -[thickness=1]-> misc : 1"]
    assert not any(diagrams.parse_text(c)["warnings"] for n, c in files.items() if n != "overview.puml")


def test_styled_files(shop, shop_split):
    options = SplitOptions(layout="elk", edge_color="target", legend=True, headers=("title T",))
    text = {r["file_name"]: r["content"] for r in render.output_files(shop_split, options).collect()}
    lines = text["cluster-misc.puml"].split("\n")
    assert lines[1:3] == ["!pragma layout elk", "title T"]
    assert '  class "OrderLine" as OrderLine <<external: order>> [[cluster-order.svg]] #F5F5F5;line:9E9E9E;line.dashed;text:9E9E9E' in lines
    assert "  InvoiceLine <|-[thickness=2]-- AbstractLine" in lines
    assert lines[-7:] == ["legend bottom", "  2 classes, 2 edges", "  Edge color: by target class", "  <<external>>: defined in another cluster", "endlegend", "@enduml", ""]
    assert "  InvoiceHeader .[#" in text["cluster-invoice.puml"] and '  package "misc (2)" as misc [[cluster-misc.svg]] {' in text["overview.puml"]
    for mode in ("source", "pair", "none"):
        made = render.cluster_files(shop[0], shop[1], shop_split.membership, shop_split.hubs, SplitOptions(layout="graphviz", edge_color=mode)).collect()
        assert len(made) == 3 and all("skinparam nodesep 20" in r["content"] for r in made)
    page = render.index_page(shop[0], shop_split.membership, shop_split.hubs, True).first()["content"]
    assert "<p>3 clusters, 1 hubs.</p>" in page and "<tr><td>Logger</td><td>6</td><td>0</td><td>in</td><td>duplicate</td></tr>" in page and page.count("<li>") == 8


def test_hub_policies_in_files(spark):
    classes, relations = tables(spark, [("A1", "A2"), ("A1", "B1"), ("A1", "Hd"), ("A1", "Hs"), ("A1", "He")])
    membership = spark.createDataFrame([("g", 1, "alpha", "A1"), ("g", 1, "alpha", "A2"), ("g", 2, "beta", "B1")], "graph_id string, cluster_id int, cluster_name string, alias string")
    hubs = spark.createDataFrame([("g", a, 1, 0, "forced", True, p) for a, p in (("Hd", "duplicate"), ("He", "exclude"), ("Hs", "separate"))], "graph_id string, alias string, in_degree long, out_degree long, reason string, forced boolean, policy string")
    files = {r["file_name"]: r["content"] for r in render.cluster_files(classes, relations, membership, hubs, OPTIONS).collect()}
    assert set(files) == {"cluster-alpha.puml", "cluster-beta.puml", "cluster-shared_types.puml"}
    alpha = files["cluster-alpha.puml"]
    assert "He" not in alpha and "<<external: shared_types>>" in alpha and '"Hd" as Hd <<shared>>' in alpha and "<<external: beta>>" in alpha
    assert "  A1 ..> Hs" in files["cluster-shared_types.puml"]


def test_slugs_are_unique(spark):
    rows = [("g", 1, "A b", "x"), ("g", 2, "a B", "y"), ("g", 3, "a_b_2", "z"), ("h", 1, "A b", "x")]
    out = render.slugs(spark.createDataFrame(rows, "graph_id string, cluster_id int, cluster_name string, alias string"))
    assert sorted((r["graph_id"], r["cluster_id"], r["slug"]) for r in out.collect()) == [("g", 1, "a_b"), ("g", 2, "a_b_2"), ("g", 3, "a_b_2_2"), ("h", 1, "a_b")]


@pytest.mark.parametrize("strategy", ["prefix", "louvain", "leiden", "auto"])
def test_strategies_cover_and_repeat(spark, strategy):
    edges = [*clique([f"Foo{k}" for k in range(20)]), *clique([f"Bar{k}" for k in range(20)]), ("Foo1", "Bar1"), ("Solo1", "Solo2")]
    classes, relations = tables(spark, edges, ["Alone"])
    options = SplitOptions(strategy=strategy, hub_threshold=1000, hub_out_threshold=1000)
    p = partition(classes, relations, options)
    found = members(p)
    assert sorted(m for _, ms in found for m in ms) == sorted(r["alias"] for r in classes.collect())
    assert all(len(ms) <= 25 for n, ms in found if n != "misc") and found == members(partition(classes, relations, options))
    assert p.summary().first()["total_edges"] == len(edges)


def test_seeds(spark):
    edges = [(f"X{k}", "Hub") for k in (1, 2, 3)] + [("Hub", f"Y{k}") for k in (1, 2, 3, 4)] + [("Root", f"Z{k}") for k in (1, 2, 3)] + [("Leaf", "W1")]
    p = partition_by_seeds(*tables(spark, edges), SplitOptions(strategy="seeds", min_size=1, hub_threshold=3, hub_out_threshold=100, seed_threshold=3))
    found = dict(members(p))
    assert "Z1" in found["Root"] and "Hub" not in found and "Leaf" not in found
    small = tables(spark, [("A", "B"), ("B", "C")])
    for options, said in ((SplitOptions(seed_threshold=1000), "highest is 1"), (SplitOptions(seeds=("DoesNotExist", "DoesNotExist")), r"1 alias\(es\)"), (SplitOptions(seeds=("misc",)), "reserved")):
        with pytest.raises(PartitionError, match=said):
            partition_by_seeds(*small, options)
    p = partition_by_seeds(*tables(spark, [("Root", f"Z{k}") for k in (1, 2, 3)]), SplitOptions(seeds=("Root",), hub_out_threshold=3, min_size=1))
    assert "Z1" in dict(members(p))["Root"]


def test_maps(spark, tmp_path):
    data = tables(spark, [("A", "B"), ("D", "E")])
    p = partition_by_map(*data, mapfile.MapFile({"x": ["A", "B", "Ghost"]}, "misc"))
    assert members(p) == [("misc", ["D", "E"]), ("x", ["A", "B"])] and any("Ghost" in w for w in p.warnings) and any("outside [3, 25]" in w for w in p.warnings)
    with pytest.raises(PartitionError, match="D, E"):
        partition_by_map(*data, mapfile.MapFile({"x": ["A", "B"]}, "error"))
    with pytest.raises(PartitionError, match="Ghost"):
        partition_by_map(*data, mapfile.MapFile({"x": ["A", "B", "Ghost"]}, "error"))
    callers = tables(spark, [(f"Caller{k}", "Hub1") for k in range(1, 9)])
    p = partition_by_map(*callers, mapfile.MapFile({"x": ["Hub1", *(f"Caller{k}" for k in range(1, 9))]}))
    assert p.hubs.isEmpty() and "Hub1" in dict(members(p))["x"]


def test_emit_and_replay(spark, shop, shop_split):
    replay = partition_by_map(shop[0], shop[1], mapfile.parse(mapfile.emit(shop_split.membership)), SplitOptions(strategy="map", hub_threshold=5))
    assert members(replay) == members(shop_split) and replay.summary().first() == shop_split.summary().first()


@pytest.mark.parametrize(
    ("content", "said"),
    [
        ("{not json", "Invalid JSON"), ('["a"]', "must be a JSON object"), ('{"fallback":"auto"}', '"clusters" object'), ('{"clusters":["A"]}', '"clusters" object'), ('{"clusters":{},"fallback":"bogus"}', "fallback"), ('{"clusters":{"a":"x"}}', "list of alias"),
        ('{"clusters":{"a":[123]}}', "non-string"), ('{"clusters":{"!!!":["X"]}}', "empty slug"), ('{"clusters":{"a":["X","X"]}}', "within one cluster: X"), ('{"clusters":{"a":["X","Y"],"b":["Y","X"]}}', "more than one cluster: X, Y"),
    ],
)
def test_bad_maps(content, said):
    with pytest.raises(PartitionError, match=said):
        mapfile.parse(content)


def test_good_maps(spark):
    assert mapfile.parse('{"clusters":{"a":["X"]}}').fallback == "auto" and mapfile.parse('{"clusters":{},"fallback":"misc"}').clusters == {}
    rows = [("g", 1, "misc", "b2"), ("g", 1, "misc", "b1"), ("g", 2, "misc", "a1")]
    out = json.loads(mapfile.emit(spark.createDataFrame(rows, "graph_id string, cluster_id int, cluster_name string, alias string")))
    assert out == {"clusters": {"misc": ["a1"], "misc_2": ["b1", "b2"]}, "fallback": "auto"}
    with pytest.raises(PartitionError, match="Cannot read"):
        mapfile.load("/nowhere/map.json")


@pytest.mark.parametrize("options", [{"strategy": "x"}, {"layout": "x"}, {"edge_color": "x"}, {"hub_policy": "x"}, {"policy_overrides": {"A": "x"}}, {"max_size": 0}, {"min_size": 30}])
def test_bad_options(options):
    with pytest.raises(PartitionError):
        SplitOptions(**options).validate()


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "shop.puml"
    source.write_text(small_diagram())
    args = ["split", str(source), "--strategy", "prefix", "--max-size", "3", "--min-size", "2", "--hub-threshold", "5", "--output", str(tmp_path / "out"), "--emit-map", str(tmp_path / "m" / "map.json")]
    assert main(args, spark) == 0
    assert "15 / 15" in capsys.readouterr().out and (tmp_path / "out" / "index.html").exists() and (tmp_path / "out" / "cluster-invoice.puml").exists() and (tmp_path / "m" / "map.json").exists()
    assert main(["split", str(tmp_path / "none.puml")], spark) == 1
    empty = tmp_path / "empty.puml"
    empty.write_text("@startuml\n@enduml\n")
    assert main(["split", str(empty)], spark) == 1 and "No class declarations" in capsys.readouterr().err
    assert main(["split", str(source), "--strategy", "map"], spark) == 1


def test_anonymiser(spark):
    docs = diagrams.from_text(spark, small_diagram(), "g")
    for scrub in (False, True):
        out = anonymize.anonymize(docs, scrub).first()["content"]
        assert "Invoice" not in out.replace("@startuml", "") and 'class "Tok001Tok002" as Tok001Tok002' in out and "Payable" not in out
    assert "+attr1 : ?" in out and "+__construct(attr1" in out
    broken = docs.select("graph_id", F.replace("content", F.lit("InvoiceHeader ..> OrderHeader"), F.lit("OrderTax ..> OrderHeader")).alias("content"))
    with pytest.raises(PartitionError, match="degree"):
        anonymize.verify(docs, broken)
    renamed = docs.select("graph_id", F.replace("content", F.lit("OrderTax"), F.lit("Tax")).alias("content"))
    with pytest.raises(PartitionError, match="token structure"):
        anonymize.verify(docs, renamed)


def test_svg_batches():
    calls = []

    def runner(command):
        calls.append(command)
        return svg.Ran(0, "", "")

    assert len(svg.render([f"{k}.puml" for k in range(120)], "bin", runner=runner)) == 120
    assert [len(c) - 2 for c in calls[1:]] == [50, 50, 20] and svg.render([], "bin", runner=runner) == []
    with pytest.raises(PartitionError):
        svg.render(["a.puml"], "bin", batch=0, runner=runner)
    with pytest.raises(PartitionError, match="not available"):
        svg.render(["a.puml"], "/no/such/binary")
    with pytest.raises(PartitionError, match="0 of 1"):
        svg.render(["a.puml"], "bin", runner=lambda c: svg.Ran(int("-tsvg" in c), "", "bad"))


def test_degree_stream(spark, tmp_path):
    _, relations = tables(spark, [("A", "B"), ("A", "C"), ("B", "C")])
    relations.write.parquet(str(tmp_path / "in"))
    stream = degree_stream(spark.readStream.schema(relations.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r["alias"], r["in_degree"], r["out_degree"]) for r in spark.table("degrees").collect()) == [("A", 0, 2), ("B", 1, 1), ("C", 2, 0)]


def test_windowed_degrees(spark, tmp_path):
    rows = [("2024-01-01 00:00:05", "A", "B"), ("2024-01-01 00:00:50", "A", "C"), ("2024-01-01 00:01:10", "B", "A")]
    spark.createDataFrame(rows, "at string, source string, target string").selectExpr("'g' AS graph_id", "CAST(at AS TIMESTAMP) AS at", "source", "target").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("graph_id string, at timestamp, source string, target string").parquet(str(tmp_path / "in"))
    query = windowed_degrees(stream, "at", "1 minute", "10 minutes").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = sorted((r["window"]["start"].minute, r["alias"], r["in_degree"], r["out_degree"]) for r in spark.table("windowed").collect())
    assert got == [(0, "A", 0, 2), (0, "B", 1, 0), (0, "C", 1, 0), (1, "A", 1, 0), (1, "B", 0, 1)]


def test_all_clusters_are_warned_of_and_reported(spark):
    names = [f"N{k:04}" for k in range(1001)]
    p = partition_by_map(*tables(spark, [(names[0], names[1])], names), mapfile.MapFile({f"c{n}": [n] for n in names}, "misc"))
    assert sum("it is left as mapped" in w for w in p.warnings) == 1001
    report = plan_report(p, SplitOptions(strategy="map")).split("\n")
    assert sum(line.startswith("cN") for line in report) == 1001


def test_scrubbed_members_by_brute_force(spark):
    """Bodies with nested openings, closings outside bodies, and documents that end inside one."""
    import random

    kinds = ['class "A" as A {', '  enum "B" as B {', '\tabstract class "C" as C{', 'interface "D" as D <<x>> {', "}", " }\r", "+member", "A ..> B", "  A ..> C : x", "B ..> A", "D ..> A", "", "note"]

    def brute(content):
        lines, out, inside = content.split("\n"), [], False
        uses = {}
        for x in lines:
            if m := re.match(r"\s*(\S+)\s+\.\.>\s+(\S+)", x):
                uses.setdefault(m[1], []).append(m[2])
        for x in lines:
            closes = x.strip() == "}"
            if inside and not closes:
                continue
            m = None if inside else re.match(r'(\s*)(abstract class|class|interface|enum) "[^"]*" as ([A-Z])\s*\{$', x)
            inside = bool(m)
            out.append(x)
            if m and m[2] != "enum":
                own = uses.get(m[3], [])
                out += [f"{m[1]}  +attr{k + 1} : ?{t}" for k, t in enumerate(own)]
                out.append(f"{m[1]}  " + (f"+__construct({', '.join(f'attr{k + 1}' for k in range(len(own)))})" if own else "+getElementName(elementType)"))
        return "\n".join(out)

    rng = random.Random(3)
    documents = {f"d{k}": "\n".join(rng.choice(kinds) for _ in range(rng.randrange(25))) for k in range(60)}
    got = scrub_members(spark.createDataFrame(list(documents.items()), "graph_id string, content string"))
    assert {r["graph_id"]: r["content"] for r in got.collect()} == {k: brute(c) for k, c in documents.items()}


def test_map_rows_have_all_regions(spark, tmp_path):
    from lattica.plans.queries import QUERIES

    spark.range(1200).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.range(1200).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert [(r["alias"], r["n_clusters"]) for r in QUERIES["map_conflicts"](spark, str(tmp_path)).orderBy("alias").collect()] == [("Ghost", 1200), ("N1", 1200)]
