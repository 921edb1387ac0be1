"""Document fingerprints: a Merkle tree of pieces, paragraphs and sections.

The leaves are pieces of up to five words, with the white space behind them, so
a paragraph's leaves are all of it.  A paragraph is a line; its node is the
SHA-256 of its leaves' hashes.  A section is a run of paragraphs that ends where
the paragraph's own node says so, about every eighth, or at an empty line, so
an edit moves no boundary far from it.  A section's node is the hash of its
paragraphs' nodes and the root that of the sections' nodes.  Equal roots mean
equal texts.

Edits are located from the root down: where roots differ, sections that the
other tree lacks are opened, and in these the paragraphs that it lacks.
Likeness is the share of leaves in common.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions_for

#: A hash that ends a section: one of 32 in 256 first bytes, or that of an empty line.
SECTION_END = r"(?m)^(?:[01][0-9a-f]{63}|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$"
#: A piece: up to five words of one line, no further than the end of a sentence, and the white space behind them; long words are cut.
PIECE = r"(?:[^ \t\n\x0B\f\r.!?]{1,48}[ \t\x0B\f\r]+){0,4}[^ \t\n\x0B\f\r.!?]{1,48}[.!?]*[ \t\x0B\f\r]*|[.!?]+[ \t\x0B\f\r]*|[ \t\x0B\f\r]+"
_LOWEST = -(1 << 63)


def paragraph_hashes(text: Column) -> Column:
    """The nodes of the paragraphs, from the hashes of their leaves."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(F.array_join(leaves(p), ""), 256))


def sections_of(paragraphs: Column) -> Column:
    """The sections, each as the nodes of its paragraphs, a line each."""
    return F.split(F.regexp_replace(F.array_join(paragraphs, "\n"), SECTION_END, "$0|"), r"\|\n?", -1)


def section_hashes(paragraphs: Column) -> Column:
    """The nodes of the sections, from those of the paragraphs."""
    return F.transform(sections_of(paragraphs), lambda s: F.sha2(s, 256))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, "\n"), 256)


def pieces(text: Column) -> Column:
    """The distinct leaves of a text, each as a short hash of its piece."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """From 0 to 1: twice the leaves in common over the leaves of both; 1 for equal roots."""
    both = F.size(a) + F.size(b)
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def first_difference(a: Column, b: Column) -> Column:
    """The first paragraph, from 0, whose nodes differ; null if all are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Distinct nodes of paragraphs of the first tree that the second lacks, looked for only in sections that it lacks."""
    own, other = sections_of(a), sections_of(b)
    inside = lambda sections: F.flatten(F.transform(sections, lambda s: F.split(s, "\n", -1)))
    return F.array_except(inside(F.array_except(own, other)), inside(F.array_except(other, own)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with `tree`: root, sections, paragraphs and pieces; a null text counts as empty.

    Columns of docs named tree are replaced; equal texts have equal trees.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumn("__paragraphs", paragraph_hashes(text)).withColumn("__sections", section_hashes(F.col("__paragraphs")))
    tree = F.struct(root(F.col("__sections")).alias("root"), F.col("__sections").alias("sections"), F.col("__paragraphs").alias("paragraphs"), pieces(text).alias("pieces"))
    return base.withColumn("tree", tree).drop("__paragraphs", "__sections")


def neighbours(rows: DataFrame) -> DataFrame:
    """(key, next_key, up_key, up_want) of each distinct key: the next lower one, the next higher, and what that wants.

    rows has key and want.  The order wraps around.  Keys are range-partitioned
    and written down once; only a row for each partition crosses its borders.
    """
    slim = rows.groupBy("key").agg(F.max("want").alias("want"))
    ranged = cut(slim.repartitionByRange(partitions_for(rows.sparkSession), "key").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min_by("want", "key").alias("low_want"))
    line, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = ends.select(
        "part",
        F.coalesce(F.lag("high").over(line), F.last("high").over(whole)).alias("border_next"),
        F.coalesce(F.lead("low").over(line), F.first("low").over(whole)).alias("border_up"),
        F.coalesce(F.lead("low_want").over(line), F.first("low_want").over(whole)).alias("border_want"),
    )
    own = Window.partitionBy("part").orderBy("key")
    return (
        ranged.withColumn("n", F.lag("key").over(own)).withColumn("u", F.lead("key").over(own)).withColumn("w", F.lead("want").over(own))
        .join(F.broadcast(borders), "part")
        .select("key", F.coalesce("n", "border_next").alias("next_key"), F.coalesce("u", "border_up").alias("up_key"), F.coalesce("w", "border_want").alias("up_want"))
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's tree against its edited text's and against the next document's.

    The edited text has the last third of the code points replaced by the
    beginning of the next document in descending doc_id, the first after the
    last.  A null id comes last; of rows with one id, the one with the least
    text is what others see as next; each row is compared.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    texts = docs.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    slim = cut(texts.select("key", third.alias("want")))
    repeated = slim.groupBy("key").count().where("count > 1").limit(1).count() > 0
    near = neighbours(slim).select(F.col("key").alias("of"), "up_key", "up_want")
    shown = texts.join(near, F.col("key") == F.col("of"))
    if repeated:
        shown = shown.groupBy("up_key", "up_want").agg(F.min("text").alias("text"))
    # What the document above sees of this one: the beginning that it takes over, and the tree.
    shown = shown.select("up_key", F.substring(F.col("text"), F.lit(1), F.col("up_want")).alias("beginning"), pieces(F.col("text")).alias("next_pieces"), root(section_hashes(paragraph_hashes(F.col("text")))).alias("next_fingerprint"))
    both = texts.join(shown, F.col("key") == F.col("up_key"))
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("beginning"), F.lit(1), third))
    both = both.select("key", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_pieces", "next_fingerprint")
    both = both.select(
        "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraph_hashes(F.col("text")).alias("p"), paragraph_hashes(F.col("edited")).alias("q"),
        pieces(F.col("text")).alias("a"), pieces(F.col("edited")).alias("b"), "next_pieces", "next_fingerprint",
    )
    both = both.select("*", root(section_hashes(F.col("p"))).alias("fingerprint"), root(section_hashes(F.col("q"))).alias("edited_fingerprint"))
    f, e, x = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return both.select(
        F.when(F.col("key") != _LOWEST, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b"), f, e).alias("near_edited"), likeness(F.col("a"), F.col("next_pieces"), f, x).alias("near_next"),
        first_difference(F.col("p"), F.col("q")).cast("long").alias("first_edited_paragraph"), F.size(edited_paragraphs(F.col("p"), F.col("q"))).cast("long").alias("edited_paragraphs"),
    )


def op1(docs: DataFrame) -> DataFrame:
    """The query's rows, with the paragraph where the edit begins and the number of those that it changes."""
    return compare_with_next(docs)
