"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, html, jaccard, mixing, quality, rules, sharding, toxicity, wavelet
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, "documents"))


def _pages(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, "pages"))


def _labelled(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprint": _documents(fingerprint.op1),
        "op2_quality": _labelled(quality.op2),
        "op3_toxicity": _labelled(toxicity.op3),
        "op4_jaccard": _documents(jaccard.op4),
        "op5_rules": _documents(rules.op5),
        "op6_wavelet": _documents(wavelet.op6),
        "op7_bpe": _documents(bpe.op7),
        "op8_sharding": _documents(sharding.op8),
        "op9_html": _pages(html.op9),
        "op10_mixing": _documents(mixing.op10),
    }


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _paragraphs(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '{fingerprint.PIECE}'), lambda x: sha256(x)), '')))"


def _sections(paragraphs: str) -> str:
    return f"string_split_regex(regexp_replace(array_to_string({paragraphs}, chr(10)), '{fingerprint.SECTION_END}', '\\0|', 'g'), '\\|\\n?')"


def _root(sections: str) -> str:
    return f"sha256(array_to_string(list_transform({sections}, lambda s: sha256(s)), chr(10)))"


def _fingerprints() -> str:
    pieces = lambda t: f"list_distinct(regexp_extract_all({t}, '{fingerprint.PIECE}'))"
    lacking = lambda x, y: f"list_distinct(flatten(list_transform(list_filter({x}, lambda s: NOT list_contains({y}, s)), lambda s: string_split(s, chr(10)))))"
    like = lambda x, y, f, g: f"CASE WHEN {f} = {g} THEN 1.0::DOUBLE WHEN len({x}) + len({y}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    x AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
    e AS (SELECT *, substring(text, 1, n - n // 3) || substring(nxt, 1, n // 3) AS edited FROM x),
    f AS (SELECT *, {_sections(_paragraphs("text"))} AS p, {_sections(_paragraphs("edited"))} AS q, {_root(_sections(_paragraphs("nxt")))} AS h, {pieces("text")} AS a, {pieces("edited")} AS b, {pieces("nxt")} AS c, string_split(text, chr(10)) AS l, string_split(edited, chr(10)) AS m FROM e),
    g AS (SELECT *, {_root("p")} AS f, {_root("q")} AS g, {lacking("p", "q")} AS lacks, {lacking("q", "p")} AS gains FROM f)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint, {like("a", "b", "f", "g")} AS near_edited, {like("a", "c", "f", "h")} AS near_next,
    CAST(list_position(list_transform(range(1, greatest(len(l), len(m)) + 1), lambda i: coalesce(l[i] = m[i], false)), false) - 1 AS BIGINT) AS first_edited_paragraph, len(list_filter(lacks, lambda x: NOT list_contains(gains, x))) AS edited_paragraphs FROM g"""


_JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= {jaccard.PERCENT} * (i.n + j.n - c)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""


def _rules() -> str:
    count = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in rules.RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
    v AS (SELECT doc_id, i, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS k FROM v) WHERE k > 1) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {count("#*$%&|<>")} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, {count("A-Z")} AS n_upper, {count("A-Za-z")} AS n_letters FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
    f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rules.BASE.mask} <> 0 AS base_failed, failed & {rules.BASE.mask | rules.CURRENT.mask} = 0 AS kept, failed FROM f"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that it can express; the others are tested against brute force."""
    return {"op1_fingerprint": _fingerprints(), "op4_jaccard": _JACCARD, "op5_rules": _rules()}
