"""Class diagrams as text: reading, line classes, and the parser.

Lines are classified by Columns, in the JVM.  What depends on the lines before
(packages, bodies, legends, headers) is a fold over one document, so a task
parses whole documents, many of them side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schema
from lattica.functions.text import strip

#: The line forms of the format, as patterns that read alike here and in the JVM.
DECLARATION = r'^\s*(abstract class|class|interface|enum)\s+"([^"]+)"\s+as\s+(\S+)\s*(.*?)\s*$'
ARROW = r"\.(?:\[[^\]]*\])?\.>|-(?:\[[^\]]*\])?->|<\|(?:-\[[^\]]*\])?--|<\|(?:\.\[[^\]]*\])?\.\.|o-(?:\[[^\]]*\])?-|\*-(?:\[[^\]]*\])?-"
MULTIPLICITY = r'(?:"([^"]*)"\s+)?'
RELATION = rf"^\s*(\S+)\s+{MULTIPLICITY}({ARROW})\s+{MULTIPLICITY}(\S+)(?:\s*:\s*(.+?))?\s*$"
PACKAGE = r'^\s*package\s+(?:"([^"]+)"|(\S+))(?:\s+as\s+(\S+))?(?:\s+\[\[[^\]]*\]\])?\s*\{\s*$'
DECORATION = r"^(?:<<[^>]*>>|#[0-9A-Za-z]+(?:[;:.][0-9A-Za-z]+)*|\[\[[^\]]*\]\]|\s)+$"
START = r"(?m)^\s*@startuml\b"
_WHITE = " \t\n\r\0\x0b"
_DECLARATION, _RELATION, _PACKAGE, _DECORATION, _START = (re.compile(p, re.A) for p in (DECLARATION, RELATION, PACKAGE, DECORATION, START))
_STEREOTYPE = re.compile("<<[^>]*>>")


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(graph_id, content): one row a file, by its path."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("graph_id"), F.col("value").alias("content"))


def from_text(spark: SparkSession, content: str, graph_id: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(graph_id, content)], "graph_id string, content string")


def lines(documents: DataFrame) -> DataFrame:
    """(graph_id, line_no, text), from 1; carriage returns at the end go."""
    cells = documents.select("graph_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
    return cells.select("graph_id", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("text", r"\r+$", "").alias("text"))


def line_class(text: Column) -> Column:
    """What a line is by itself: start, end, legend, endlegend, package, close, declaration, relation, blank or other."""
    trimmed = strip(text)
    return (
        F.when(trimmed.startswith("@startuml"), "start").when(trimmed == "@enduml", "end").when((trimmed == "legend") | trimmed.startswith("legend "), "legend").when(trimmed == "endlegend", "endlegend")
        .when(text.rlike(PACKAGE), "package").when(trimmed == "}", "close").when(text.rlike(DECLARATION), "declaration").when(text.rlike(RELATION), "relation").when(trimmed == "", "blank").otherwise("other")
    )


def _group(text: Column, pattern: str, n: int, present: str) -> Column:
    """A group of a match, null where it took no part: an empty match is not a missing one."""
    return F.when(text.rlike(present), F.regexp_extract(text, pattern, n))


def relation_columns(text: Column) -> dict[str, Column]:
    """source, arrow, target, label, src_mult and dst_mult of a relation line."""
    one = lambda n: F.regexp_extract(text, RELATION, n)
    return {
        "source": one(1), "arrow": one(3), "target": one(5), "label": F.nullif(one(6), F.lit("")),
        "src_mult": _group(text, RELATION, 2, rf'^\s*\S+\s+"[^"]*"\s+(?:{ARROW})\s'), "dst_mult": _group(text, RELATION, 4, rf'^\s*\S+\s+{MULTIPLICITY}(?:{ARROW})\s+"[^"]*"\s+\S'),
    }


def declaration_columns(text: Column) -> dict[str, Column]:
    one = lambda n: F.regexp_extract(text, DECLARATION, n)
    return {"kind": one(1), "name": one(2), "alias": one(3), "rest": one(4)}


class _Fold:
    """One document, line by line."""

    def __init__(self, content: str):
        self.lines = [x.rstrip("\r") for x in content.split("\n")]
        self.at = 0
        self.out: dict = {"start_line": "", "headers": [], "classes": [], "relations": [], "passthrough": [], "warnings": []}
        self.packages: list[str] = []
        self.aliases: set[str] = set()
        self.declared = False
        started = _START.search(content) is None
        while self.at < len(self.lines):
            line, trimmed = self.lines[self.at], self.lines[self.at].strip(_WHITE)
            self.at += 1
            if not started:
                if trimmed.startswith("@startuml"):
                    self.out["start_line"], started = line, True
            elif trimmed == "@enduml":
                break
            else:
                self.line(line, trimmed, self.at)

    def warn(self, text: str) -> None:
        self.out["warnings"].append(text)

    def unknown(self, line: str, trimmed: str, number: int) -> None:
        self.out["passthrough"].append({"line_no": number, "text": line})
        self.warn(f"Unrecognized line {number}: {trimmed}")

    def line(self, line: str, trimmed: str, number: int) -> None:
        if trimmed == "legend" or trimmed.startswith("legend "):
            self.legend(number)
        elif m := _PACKAGE.match(line):
            self.packages.append(m[1] if m[1] is not None else m[2] or "")
        elif trimmed == "}":
            if self.packages:
                self.packages.pop()
            else:
                self.unknown(line, trimmed, number)
        elif m := _DECLARATION.match(line):
            self.declaration(m, number)
        elif m := _RELATION.match(line):
            source, src, arrow, dst, target, label = m.groups()
            self.out["relations"].append({"rel_id": len(self.out["relations"]), "source": source, "arrow": arrow, "target": target, "label": label, "src_mult": src, "dst_mult": dst, "raw": line})
        elif not self.declared:
            self.out["headers"].append(line)
        elif trimmed:
            self.unknown(line, trimmed, number)

    def legend(self, number: int) -> None:
        """Skips to the legend's end; never past the diagram's, which the caller sees again."""
        while self.at < len(self.lines):
            trimmed = self.lines[self.at].strip(_WHITE)
            if trimmed == "@enduml":
                break
            self.at += 1
            if trimmed == "endlegend":
                return
        self.warn(f"Unterminated legend block starting near line {number}.")

    def body(self, number: int) -> list[str]:
        taken: list[str] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            trimmed = line.strip(_WHITE)
            if trimmed == "@enduml":
                self.warn(f"Unterminated class body: reached @enduml before a closing brace near line {number}.")
                return taken
            self.at += 1
            if trimmed == "}":
                return taken
            taken.append(line)
        self.warn(f"Unterminated class body starting near line {number}.")
        return taken

    def declaration(self, m: re.Match, number: int) -> None:
        self.declared = True
        kind, name, alias, rest = m.groups()
        head, brace, tail = rest.partition("{")
        body: list[str] | None = None
        if brace and tail.endswith("}"):
            inner = tail[:-1].strip(_WHITE)
            body = [inner] if inner else []
        elif brace:
            body = self.body(number)
        decoration, stereotype = head.strip(_WHITE), None
        if decoration:
            if _DECORATION.match(decoration):
                found = _STEREOTYPE.search(decoration)
                stereotype = found[0] if found else None
            else:
                self.warn(f"Ignored trailing content after declaration on line {number}: {decoration}")
        if alias in self.aliases:
            self.warn(f'Duplicate alias "{alias}" on line {number} ignored.')
            return
        self.aliases.add(alias)
        self.out["classes"].append({"alias": alias, "name": name, "kind": kind, "body": body, "package": self.packages[-1] if self.packages else None, "stereotype": stereotype, "decl_line": number})


def parse_text(content: str) -> dict:
    return _Fold(content).out


def parse(documents: DataFrame) -> DataFrame:
    """One row a document: start_line, headers, and arrays of classes, relations, passthrough lines and warnings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"graph_id": g, **parse_text(c or "")} for g, c in zip(frame["graph_id"], frame["content"], strict=True)], columns=schema.DOCUMENTS.names)

    return documents.select("graph_id", "content").mapInPandas(run, schema.DOCUMENTS)


def classes(parsed: DataFrame) -> DataFrame:
    return parsed.select("graph_id", F.inline("classes"))


def relations(parsed: DataFrame) -> DataFrame:
    return parsed.select("graph_id", F.inline("relations"))


def passthrough(parsed: DataFrame) -> DataFrame:
    return parsed.select("graph_id", F.inline("passthrough"))


def warnings(parsed: DataFrame) -> DataFrame:
    return parsed.select("graph_id", F.posexplode("warnings").alias("seq", "text"))


def is_external(stereotype: Column) -> Column:
    return F.coalesce(F.contains(stereotype, F.lit("external")), F.lit(False))
