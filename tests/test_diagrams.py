import pytest
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import render
from lattica.sources import diagrams


def parsed(*lines):
    return diagrams.parse_text("\n".join(lines))


ARROWS = ["..>", "-->", "o--", "*--", "<|--", "<|..", ".[#3388CC].>", "-[#3388CC]->", "o-[#3388CC]-", "*-[#3388CC]-", "<|-[thickness=2]--", "<|.[thickness=2].."]


@pytest.mark.parametrize("arrow", ARROWS)
def test_arrows(arrow):
    out = parsed("@startuml", f"A {arrow} B", "@enduml")
    assert [(r["source"], r["arrow"], r["target"]) for r in out["relations"]] == [("A", arrow, "B")] and not out["warnings"]


def test_unknown_arrow_warns():
    out = parsed("@startuml", 'class "A" as A', "A <|--- B", "@enduml")
    assert not out["relations"] and out["warnings"] == ["Unrecognized line 3: A <|--- B"] and out["passthrough"] == [{"line_no": 3, "text": "A <|--- B"}]


@pytest.mark.parametrize(("line", "expected"), [('A "1" ..> "*" B : owns', ("1", "*", "owns", "B")), ('A "" ..> B', ("", None, None, "B")), ('A ..> "*" B', (None, "*", None, "B")), ("A ..> B:owns", (None, None, None, "B:owns")), ("A ..> B: owns", (None, None, "owns", "B"))])
def test_multiplicities_and_labels(spark, line, expected):
    r = parsed("@startuml", line)["relations"][0]
    assert (r["src_mult"], r["dst_mult"], r["label"], r["target"]) == expected
    row = spark.createDataFrame([(line,)], "text string").select(*[c.alias(k) for k, c in diagrams.relation_columns(F.col("text")).items()]).first()
    assert (row["src_mult"], row["dst_mult"], row["label"], row["target"]) == expected


def test_bodies_headers_packages():
    out = parsed("@startuml x", "skinparam a", "", 'class "W" as W {}', 'interface "I" as I { +size : int }', 'enum "E" as E {', "  A", "}", 'package "Shared" as s [[x]] {', 'abstract class "B" as B <<s>> #AABBCC', "}", "", 'class "N" as N', "@enduml", 'class "Late" as Late')
    assert out["start_line"] == "@startuml x" and out["headers"] == ["skinparam a", ""]
    assert {c["alias"]: (c["kind"], c["body"], c["package"], c["stereotype"]) for c in out["classes"]} == {
        "W": ("class", [], None, None), "I": ("interface", ["+size : int"], None, None), "E": ("enum", ["  A"], None, None), "B": ("abstract class", None, "Shared", "<<s>>"), "N": ("class", None, None, None),
    }
    assert not out["warnings"]


def test_odd_documents():
    assert parsed('class "A" as A', "A ..> B")["relations"] and not parsed('class "A" as A')["warnings"]
    assert parsed("@startuml", 'class "A" as X', 'class "B" as X')["warnings"] == ['Duplicate alias "X" on line 3 ignored.']
    assert not parsed("@startuml", "legend bottom", "x", "endlegend", 'class "A" as A', "@enduml")["warnings"]
    bad = parsed("@startuml", "legend bottom", 'class "A" as A', "@enduml")
    assert bad["warnings"] == ["Unterminated legend block starting near line 2."] and not bad["classes"]
    assert parsed("@startuml", 'class "A" as A {', "x", "@enduml")["warnings"][0].startswith("Unterminated class body: reached @enduml")
    assert parsed("@startuml", 'class "A" as A', "}")["warnings"] == ["Unrecognized line 3: }"]
    assert parsed("@startuml", 'class "A" as A what')["warnings"] == ["Ignored trailing content after declaration on line 2: what"]
    assert parsed("")["classes"] == []


def test_parse_many(spark):
    docs = spark.createDataFrame([("a", '@startuml\r\nclass "A" as A\r\nA ..> B\r\n@enduml'), ("b", ""), ("c", None)], "graph_id string, content string")
    out = diagrams.parse(docs).cache()
    assert diagrams.classes(out).count() == 1 and diagrams.relations(out).first()["target"] == "B" and out.count() == 3
    lines = diagrams.lines(docs.where("graph_id = 'a'"))
    assert [r["c"] for r in lines.orderBy("line_no").select(diagrams.line_class(F.col("text")).alias("c")).collect()] == ["start", "declaration", "relation", "end"]


def test_arrow_styles(spark):
    df = spark.createDataFrame([(a,) for a in [*ARROWS, "==>"]], "a string")
    styled = {r["a"]: (r["b"], r["s"], r["n"]) for r in df.select("a", text.base_arrow(F.col("a")).alias("b"), text.style_arrow(F.col("a"), F.lit("#C"), F.lit(None).cast("int")).alias("s"), text.style_arrow(F.col("a"), F.lit(None).cast("string"), F.lit(None).cast("int")).alias("n")).collect()}
    assert styled["..>"] == ("..>", ".[#C].>", "..>") and styled["<|-[thickness=2]--"] == ("<|--", "<|-[#C]--", "<|-[thickness=2]--") and styled["<|.."] == ("<|..", "<|.[#C]..", "<|..")
    assert styled["o-[#3388CC]-"][1] == "o-[#C]-" and styled["*--"][1] == "*-[#C]-" and styled["==>"] == (None, "==>", "==>")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.tokens(F.lit("HTMLParserX1Tok001_a9"))) == ["HTML", "Parser", "X", "1", "Tok001", "a9"]
    assert [one(text.slug(F.lit(x))) for x in ("Order Line!", "__", "Ärger9")] == ["order_line", "cluster", "rger9"]
    assert [one(text.edge_color(F.lit(k))) for k in range(4)] == ["#A82424", "#24A84A", "#7124A8", "#A89824"]
    assert one(text.strip(F.lit("\t\x0b a \r\n"))) == "a"
    assert one(text.escape_html(F.lit("<a href=\"x\">&'"))) == "&lt;a href=&quot;x&quot;&gt;&amp;&#039;"
    assert [one(text.thickness(F.lit(n), F.lit(m))) for n, m in ((1, 1), (2, 2), (1, 3), (2, 3), (3, 3))] == [1, 4, 1, 3, 4]


def test_writers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none = F.lit(None).cast("string")
    head = render.head_line(F.lit("class"), F.lit('a "b"'), F.lit("A"), F.lit("<<s>>"), F.lit("l.svg"), F.lit("#C"))
    assert one(head) == "  class \"a 'b'\" as A <<s>> [[l.svg]] #C"
    assert one(render.with_body(F.lit("h"), F.lit(None).cast("array<string>"))) == "h"
    assert one(render.with_body(F.lit("h"), F.array().cast("array<string>"))) == "h {\n  }"
    assert one(render.relation_line(F.lit("A"), F.lit("..>"), F.lit("B"), F.lit("owns"), F.lit("1"), F.lit("*"), none, F.lit(None).cast("int"))) == '  A "1" ..> "*" B : owns'
