"""Quality rules as a bitmask ledger.

Each rule is evaluated once a document.  The ledger stores the measurements
and, in one long, a bit for each rule that the document fails.  Policies are
versioned masks over those bits: applying another version, or asking what a
rule alone removes, reads the ledger and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _U64, append_columns, mix64, span_hashes, text_buffer, window_hashes, word_spans

#: Words in a window whose repetition counts.
WINDOW = 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask, never reused; fails: SQL over the measurements."""

    bit: int
    name: str
    fails: str


#: Both sides are whole numbers, so every engine decides ties alike.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(5, "long_words", "10 * word_chars > 200 * n_words"),
    Rule(6, "shouting", "100 * n_upper > 50 * n_letters AND n_letters >= 100"),
)


@dataclass(frozen=True)
class Policy:
    """A version's mask: a document goes if it fails any rule whose bit is set."""

    version: str
    mask: int


def mask_of(*names: str) -> int:
    by_name = {r.name: r.bit for r in RULES}
    return sum(1 << by_name[x] for x in names)


BASE = Policy("base", mask_of("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", mask_of("few_words", "repeated_windows", "symbols")), Policy("v2", mask_of(*(r.name for r in RULES))))}
#: The version that the query and the pipeline apply.
CURRENT = POLICIES["v2"]


def measure_batch(text: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text of a column, over its whole length."""
    buf, offsets = text_buffer(text)
    n = len(offsets) - 1
    starts, ends, rows = word_spans(buf, offsets)
    out = {"n_words": np.bincount(rows, minlength=n)}
    points = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    out["word_chars"] = np.bincount(rows, weights=points[ends] - points[starts], minlength=n)

    def inside(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(flag[buf], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    out["n_symbols"], out["n_upper"], out["n_letters"] = inside(_SYMBOL), inside(_UPPER), inside(_LETTER)
    # Lines: those with a word, by the first word that starts in them.
    breaks = np.flatnonzero(buf == 0x0A)
    head = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1]))
    head = head[head < len(buf)]
    tail = np.append(head[1:], len(buf))[: len(head)]
    tail = tail - (buf[tail - 1] == 0x0A)
    line_row = np.searchsorted(offsets, head, side="right") - 1
    full = np.searchsorted(starts, tail) > np.searchsorted(starts, head)
    head, tail, line_row = head[full], tail[full], line_row[full]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    key = mix64(span_hashes(buf, head, tail) + line_row.astype(_U64) * _U64(0x632BE59BD9B4E019))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first], minlength=n)
    # Words in windows that a text has twice or more.
    windows, at = window_hashes(span_hashes(buf, starts, ends), rows, WINDOW)
    key = mix64(windows + rows[at].astype(_U64) * _U64(0x632BE59BD9B4E019))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(rows, weights=np.cumsum(cover[:-1]) > 0, minlength=n)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def _measure() -> object:
    def work(part: pa.RecordBatch) -> list[pa.Array]:
        found = measure_batch(part.column(part.schema.get_field_index("text")))
        return [pa.array(found[k]) for k in MEASURES]

    return work


def failures() -> Column:
    """The bits of the rules that a row of measurements fails."""
    out: Column = F.lit(0).cast("long")
    for r in RULES:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and `failed`, the bits of the rules that fail.

    A null or empty text has no words, so it fails few_words.  Repeated rows
    are measured each; columns of docs named as a measurement are replaced.
    """
    base = docs.withColumn("text", F.col("text").cast("string"))
    return append_columns(base, _measure, [T.StructField(k, T.LongType(), False) for k in MEASURES]).withColumn("failed", failures())


def apply_policy(book: DataFrame, policy: Policy = CURRENT, out: str = "kept") -> DataFrame:
    """The ledger with a boolean: no rule of the policy fails."""
    return book.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that it alone removes, and those kept without it.

    One pass over the ledger: bits are counted by mask first, and there are at
    most 2 ** len(RULES) masks, so the rest works on a bounded table.
    """
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    rows = counts.select("failed", "n", each.alias("r")).select("failed", "n", "r.rule", "r.bit")
    fails, alone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy(F.lit(policy.version).alias("version"), "rule").agg(
        total(fails).alias("n_failed"), total(alone).alias("n_alone"), total((F.col("failed") == 0) | alone).alias("n_kept_without")
    )


def op5(docs: DataFrame) -> DataFrame:
    """The query's rows: measurements, base_failed and kept under the current policy."""
    book = ledger(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return apply_policy(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")
