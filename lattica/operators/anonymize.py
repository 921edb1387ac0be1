"""Pseudonyms for diagrams: same structure, other names, and the proof of it.

Token maps are DataFrames; a document's text is rewritten whole, one document
a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import TOKEN, tokens
from lattica.options import PartitionError
from lattica.sources import diagrams

_TOKEN = re.compile(TOKEN)


def declarations(lines: DataFrame) -> DataFrame:
    """(graph_id, line_no, alias, display) of declaration lines."""
    d = diagrams.declaration_columns(F.col("text"))
    return lines.where(F.col("text").rlike(diagrams.DECLARATION)).select("graph_id", "line_no", d["alias"].alias("alias"), d["name"].alias("display"))


def packages(lines: DataFrame) -> DataFrame:
    """(graph_id, line_no, k, name) of packages and their aliases, each name at its first place."""
    text, pattern = F.col("text"), r'^\s*package\s+(?:"([^"]+)"|(\S+))(?:\s+as\s+(\S+))?\s*\{'
    one = lambda n: F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
    names = F.posexplode(F.array(F.coalesce(one(1), one(2)), one(3))).alias("k", "name")
    return lines.where(text.rlike(pattern)).select("graph_id", "line_no", names).where("name IS NOT NULL")


def token_map(declared: DataFrame, packaged: DataFrame) -> DataFrame:
    """(graph_id, token, n, pseudonym): tokens numbered as they first appear: each declaration's alias, then its display name, then packages."""
    alias, display = (declared.select("graph_id", F.lit(0).alias("part"), "line_no", F.lit(k).alias("k"), F.posexplode(tokens(F.col(c))).alias("pos", "token")) for k, c in enumerate(("alias", "display")))
    others = packaged.select("graph_id", F.lit(1).alias("part"), "line_no", "k", F.posexplode(tokens(F.col("name"))).alias("pos", "token"))
    first = alias.unionByName(display).unionByName(others).groupBy("graph_id", "token").agg(F.min(F.struct("part", "line_no", "k", "pos")).alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("graph_id").orderBy("at"))).withColumn("total", F.count("*").over(Window.partitionBy("graph_id")))
    return numbered.select("graph_id", "token", "n", F.concat(F.lit("Tok"), F.expr("lpad(cast(n as string), greatest(3, length(cast(total as string))), '0')")).alias("pseudonym"))


def recompose(name: str, mapping: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: mapping.get(m[0], m[0]), name)


def name_map(declared: DataFrame, packaged: DataFrame, mapped: DataFrame) -> DataFrame:
    """(graph_id, name, new_name) of all aliases, display names and packages.

    Runs of token and other characters are split, tokens are replaced by a
    join, and the runs are put together again.
    """
    names = declared.select("graph_id", F.col("alias").alias("name")).union(declared.select("graph_id", "display")).union(packaged.select("graph_id", "name")).distinct()
    runs = names.select("graph_id", "name", F.posexplode(F.regexp_extract_all("name", F.lit(f"{TOKEN}|[^A-Za-z0-9]+"), F.lit(0))).alias("pos", "token"))
    known = runs.join(mapped.select("graph_id", "token", "pseudonym"), ["graph_id", "token"], "left")
    parts = known.groupBy("graph_id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("pseudonym", "token").alias("t")))).alias("ts"))
    return names.join(parts, ["graph_id", "name"], "left").select("graph_id", "name", F.coalesce(F.array_join(F.transform("ts", lambda x: x["t"]), ""), "name").alias("new_name"))


def replace_names(content: str, names: dict[str, str]) -> str:
    """Whole words only, longest names first, so a short one never cuts a longer one."""
    if not names:
        return content
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")\b", re.A)
    return pattern.sub(lambda m: names[m[0]], content)


#: A declaration that opens a body on its own line: indent, keyword and alias.
OPENING = r'^(\s*)(abstract class|class|interface|enum)\s+"[^"]*"\s+as\s+(\S+?)\s*\{\s*$'
DEPENDS = r"^\s*(\S+)\s+\.\.>\s+(\S+)"


def scrub_members(documents: DataFrame) -> DataFrame:
    """(graph_id, content) with made-up bodies: an attribute for each class depended on, and a constructor of them, or a plain accessor; nothing in enums.

    Over the table of lines: the last opening or closing line before a line
    says whether it is in a body.  Those in bodies go, and the line that opens
    one brings what its block gets.
    """
    lines = documents.select("graph_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
    text = F.col("text")
    event = F.when(F.trim(F.regexp_replace(text, r"[\t\r\x0B\x00]", " ")) == "}", "close").when(text.rlike(OPENING), "open")
    earlier = Window.partitionBy("graph_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("event", event).withColumn("inside", F.coalesce(F.last("event", True).over(earlier) == "open", F.lit(False)))
    kept = marked.where(~F.col("inside") | (F.col("event") == "close"))
    opens = ~F.col("inside") & (F.coalesce("event", F.lit("")) == "open")
    kept = kept.withColumn("owner", F.when(opens & (F.regexp_extract(text, OPENING, 2) != "enum"), F.regexp_extract(text, OPENING, 3)))
    uses = lines.where(text.rlike(DEPENDS)).select("graph_id", "pos", F.regexp_extract(text, DEPENDS, 1).alias("owner"), F.regexp_extract(text, DEPENDS, 2).alias("target"))
    uses = uses.groupBy("graph_id", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("targets"))
    attributes = F.transform("targets", lambda t, k: F.concat(F.lit("attr"), (k + 1).cast("string")))
    typed = F.transform("targets", lambda t, k: F.concat(F.lit("+attr"), (k + 1).cast("string"), F.lit(" : ?"), t))
    made = F.concat(typed, F.array(F.concat(F.lit("+__construct("), F.array_join(attributes, ", "), F.lit(")"))))
    body = F.when(F.col("owner").isNotNull(), F.coalesce(made, F.array(F.lit("+getElementName(elementType)"))))
    indent = F.concat(F.regexp_extract(text, OPENING, 1), F.lit("  "))
    block = F.concat(F.array("text"), F.coalesce(F.transform(body, lambda m: F.concat(indent, m)), F.array().cast("array<string>")))
    blocks = kept.join(uses, ["graph_id", "owner"], "left").select("graph_id", F.struct("pos", block.alias("lines")).alias("block"))
    whole = blocks.groupBy("graph_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return whole.select("graph_id", F.array_join(F.flatten(F.transform("blocks", lambda b: b["lines"])), "\n").alias("content"))


def anonymize(documents: DataFrame, scrub: bool = False) -> DataFrame:
    """(graph_id, content) with pseudonyms; raises if degrees or token structure would change."""
    lines = diagrams.lines(documents)
    declared, packaged = declarations(lines), packages(lines)
    names = name_map(declared, packaged, token_map(declared, packaged))
    maps = names.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "new_name"))).alias("names"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [replace_names(c, dict(m) if m is not None else {}) for c, m in zip(frame["content"], frame["names"], strict=True)]
            yield pd.DataFrame({"graph_id": frame["graph_id"], "content": out})

    made = documents.join(maps, "graph_id", "left").select("graph_id", "content", "names").mapInPandas(run, "graph_id string, content string")
    made = scrub_members(made) if scrub else made
    verify(documents, made)
    return made


def degree_sequence(lines: DataFrame) -> DataFrame:
    """(graph_id, edges, in_degrees, out_degrees): sorted degree lists of the ends of relation lines."""
    r = diagrams.relation_columns(F.col("text"))
    ends = lines.where(F.col("text").rlike(diagrams.RELATION)).select("graph_id", r["source"].alias("s"), r["target"].alias("t"))
    each = ends.select("graph_id", F.col("s").alias("a"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(ends.select("graph_id", F.col("t").alias("a"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    nodes = each.groupBy("graph_id", "a").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.groupBy("graph_id").agg(F.sum("o").alias("edges"), F.array_sort(F.collect_list("i")).alias("in_degrees"), F.array_sort(F.collect_list("o")).alias("out_degrees"))


def token_signature(declared: DataFrame) -> DataFrame:
    """(graph_id, line_no, signature): each alias as the numbers of its tokens, by first appearance."""
    cells = declared.select("graph_id", "line_no", F.posexplode(tokens(F.col("alias"))).alias("pos", "token"))
    first = cells.groupBy("graph_id", "token").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    ids = first.withColumn("id", F.row_number().over(Window.partitionBy("graph_id").orderBy("at")) - 1).drop("at")
    parts = cells.join(ids, ["graph_id", "token"]).groupBy("graph_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("xs"))
    return declared.select("graph_id", "line_no").join(parts, ["graph_id", "line_no"], "left").select("graph_id", "line_no", F.coalesce(F.array_join(F.transform("xs", lambda x: x["id"].cast("string")), "-"), F.lit("")).alias("signature"))


def verify(before: DataFrame, after: DataFrame) -> None:
    """Equal degree sequences and equal token structure, line by declaration line, of every graph."""
    a, b = diagrams.lines(before), diagrams.lines(after)
    x, y = degree_sequence(a), degree_sequence(b)
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise PartitionError("verification failed: degree distributions differ")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("line_no"))
    s, t = (token_signature(declarations(z)).select("graph_id", rank.alias("k"), "signature") for z in (a, b))
    if not s.exceptAll(t).isEmpty() or not t.exceptAll(s).isEmpty():
        raise PartitionError("verification failed: token structure changed")

