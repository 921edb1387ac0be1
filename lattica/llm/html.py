"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one a block.  Pages are sorted by host and URL path;
a page's pair is the neighbour of its host whose path it shares longest.  Both
pages' lines are aligned by their longest common subsequence.  What they share
is taken for the site's if the host's pages bear it out: a line goes if
SITE_PAGES of them have it, a line inside an article only if ARTICLE_PAGES of
them and ARTICLE_SHARE of all have it, so passages that some articles repeat
stay.

What a site writes anew on every page no alignment finds: menus, adverts,
comments.  So lines have a zone: `drop` inside an element that by its name,
role, class or id is no article text, which goes; `article` inside an article
or main element; else `body`.  Body lines beside an article stay if the pair
doesn't have them; only where nothing is shared, so that differencing tells
nothing, does the article alone stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, partitions_for, shared_path, slices

DROP, BODY, ARTICLE = 0, 1, 2
#: Pages of a host that have a shared line if it is the site's, all of them if there are fewer; and, for a line inside an article, how many at least, and what share of all.
SITE_PAGES, ARTICLE_PAGES, ARTICLE_SHARE = 3, 10, 0.5
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag.
_RAW = frozenset("script style noscript textarea iframe template svg object title".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr ins del label img acronym".split())
_DROPPED = frozenset("head nav footer aside form button select dialog menu noscript fieldset datalist".split())
#: Page headers; a header inside an article is its own.
_DROPPED_OUTSIDE = frozenset(["header"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names in a class or id that say what an element is.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended widget pagination pager toolbar copyright".split()
)
_COMMENTS = frozenset("comment comments respond response responses disqus reply replies discussion".split())
#: Before such a name, it says what an element is beside, not what it is.
_BESIDE = frozenset("has no not non with without".split())
#: In an article these can be a part of it.
_AMBIGUOUS = frozenset("discussion respond response responses reply replies".split())
#: In an article these are its own whatever their names.
_OWN = frozenset("h1 h2 h3 h4 h5 h6 section figure figcaption table thead tbody tfoot tr td th pre blockquote math dl dt dd".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(value: str, tag: str, in_article: bool) -> str:
    """What a class or id says: 'comments', 'soft' or ''.  A name counts as a whole class or id, outside articles also as its last part.

    Articles and main elements are never dropped for a name, nor, in an
    article, headings, sections, figures, tables and quotations; only a section
    of comments is.
    """
    if tag in ("article", "main") or in_article and tag in _OWN and tag != "section":
        return ""
    found = ""
    for token in value.split():
        words = [w.lower() for w in _PART.findall(token)]
        if not words or in_article and len(words) > 1 or not _BESIDE.isdisjoint(words[:-1]):
            continue
        last = words[-1]
        if last in _COMMENTS and not (in_article and last in _AMBIGUOUS):
            return "comments"
        if last in _NAMES and not (in_article and tag == "section") or last == "header" and not in_article:
            found = "soft"
    return found


def _says(tag: str, attributes: str, in_article: bool) -> str:
    """What an element's start tag says: 'hard', 'soft' or 'comments' if it is no article text, 'article', or ''."""
    if tag in _DROPPED or tag in _DROPPED_OUTSIDE and not in_article:
        return "hard"
    found, role = "", ""
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                return "hard"
            if name == "role":
                role = value.lower()
            elif name in ("class", "id"):
                says = _named(value, tag, in_article)
                found = says if says == "comments" else found or says
    if role in _ROLES:
        return "hard"
    if found == "comments":
        return found
    if tag in ("article", "main") or role in ("main", "article"):
        return "article"
    return found


def lines_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; references decoded, white space one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # element, zone inside, whether an article may end the drop
    blocks: list[int] = []  # places in the stack of elements that aren't inline
    open_: dict[str, int] = {}
    zone, soft, parts = BODY, False, []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zone, text))

    def pop() -> None:
        nonlocal zone, soft
        name = stack.pop()[0]
        open_[name] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        zone, soft = (stack[-1][1], stack[-1][2]) if stack else (BODY, False)

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        m = _TOKEN.search(html, at) if at <= last else None
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if tag not in _INLINE:
            flush()
        if tag == "br":
            continue
        if closing:
            if open_.get(tag):
                was = zone
                while stack[-1][0] != tag:
                    pop()
                pop()
                if zone != was and parts:
                    # What an inline element held belongs to the zone that it ends.
                    now, zone = zone, was
                    flush()
                    zone = now
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in _VOID or attributes.rstrip().endswith("/"):
            continue
        if tag not in _INLINE and blocks and stack[blocks[-1]][0] == "p":
            # A block ends the paragraph around it, with all inline elements that are open in it.
            end = blocks[-1]
            while len(stack) > end:
                pop()
        says = _says(tag, attributes, zone == ARTICLE)
        inner, inner_soft = zone, soft
        if zone == DROP:
            if says == "article" and soft:
                inner, inner_soft = ARTICLE, False
        elif says == "article":
            inner = ARTICLE
        elif says:
            inner, inner_soft = DROP, says == "soft"
        if inner != zone:
            flush()
        if tag not in _INLINE:
            blocks.append(len(stack))
        stack.append((tag, inner, inner_soft))
        open_[tag] = open_.get(tag, 0) + 1
        zone, soft = inner, inner_soft
    flush()
    return out


def line_hash(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions of `own` in a longest common subsequence of both, by runs of matches in rising order."""
    a, b = 0, 0
    while a < len(own) and a < len(other) and own[a] == other[a]:
        a += 1
    while b < len(own) - a and b < len(other) - a and own[-1 - b] == other[-1 - b]:
        b += 1
    out = {*range(a), *range(len(own) - b, len(own))}
    places: dict[int, list[int]] = {}
    for j in range(len(other) - b - 1, a - 1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    tips: list[tuple | None] = []
    for i in range(a, len(own) - b):
        for j in places.get(own[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, tips[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tips.append(link)
            else:
                ends[k], tips[k] = j, link
    tip = tips[-1] if tips else None
    while tip is not None:
        out.add(tip[0])
        tip = tip[1]
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, without scheme, query and fragment; empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|^//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def pair_pages(pages: DataFrame) -> DataFrame:
    """(key, partner): for each page of a host with several, the sorted neighbour whose path it shares longest, the one before if equal.

    pages has key, host and path.  They are range-partitioned by all three;
    rows at the ends of the ranges, two a partition, are what crosses them.
    """
    order = ["host", "path", "key"]
    ranged = cut(pages.select(*order).repartitionByRange(partitions_for(pages.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    row = F.struct(*order)
    ends = ranged.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    line = Window.orderBy("part")
    borders = ends.select("part", F.lag("high").over(line).alias("border_before"), F.lead("low").over(line).alias("border_after"))
    own = Window.partitionBy("part").orderBy(*order)
    near = ranged.withColumn("b", F.lag(row).over(own)).withColumn("a", F.lead(row).over(own)).join(F.broadcast(borders), "part")
    near = near.withColumn("b", F.coalesce("b", "border_before")).withColumn("a", F.coalesce("a", "border_after"))
    # Leading path segments in common; a pair that differs in none is closest.
    same = "zip_with(split(path, '/'), split({0}.path, '/'), (x, y) -> coalesce(x = y, false))"
    common = "CASE WHEN {0}.host = host THEN coalesce(nullif(array_position(" + same + ", false), 0), 2147483647) END"
    near = near.withColumn("cb", F.expr(common.format("b"))).withColumn("ca", F.expr(common.format("a")))
    before = F.col("cb").isNotNull() & (F.col("ca").isNull() | (F.col("cb") >= F.col("ca")))
    return near.select("key", F.when(before, F.col("b.key")).when(F.col("ca").isNotNull(), F.col("a.key")).alias("partner")).where("partner IS NOT NULL")


_PARSED = T.StructType([
    *[T.StructField(*x) for x in (("key", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()), ("host", T.StringType()), ("path", T.StringType()))],
    T.StructField("zones", T.ArrayType(T.IntegerType())), T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType())),
])


def parse(pages: DataFrame) -> DataFrame:
    """Each page's lines: zones, hashes and texts, those of dropped lines empty; key numbers the rows and holds once they are written."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("key"), "page_id", "url", host.alias("host"), path.alias("path"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                zones, hashes, texts = [], [], []
                for html in part.column(5).to_pylist():
                    lines = lines_of(html or "")
                    zones.append([z for z, _ in lines])
                    hashes.append([line_hash(t) for _, t in lines])
                    texts.append([t if z else "" for z, t in lines])
                made = [pa.array(zones, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *made], names=_PARSED.names)

    return map_batches(rows, run, _PARSED)


_SHARED = "key long, host string, places array<int>, found array<long>, zones array<int>"


def align(parsed: DataFrame) -> DataFrame:
    """(key, host, places, found, zones) of pages that share lines with their pair: where the shared lines stand, what they are, in which zone.

    A pair with the same lines throughout is the same page again and tells nothing.
    """
    other = parsed.select(F.col("key").alias("partner"), F.col("lines").alias("partner_lines"))
    pairs = pair_pages(parsed).join(other, "partner").select(F.col("key").alias("of"), "partner_lines")
    both = parsed.select("key", "host", "zones", "lines").join(pairs, F.col("key") == F.col("of")).drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, host, zones, own, partner in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                shared = sorted(shared_lines(own, partner)) if own != partner else []
                if shared:
                    rows.append((key, host, shared, [own[k] for k in shared], [zones[k] for k in shared]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "host", "places", "found", "zones"])

    return map_batches(both, run, _SHARED)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def site_lines(parsed: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, gone) of every row of shared: the places of its shared lines that are the site's.

    Only lines that some pair shares are counted over the pages of their host.
    """
    cells = shared.select("key", "host", F.explode(F.arrays_zip("places", "found", "zones")).alias("x"))
    cells = cut(cells.select("key", "host", "x.places", "x.found", "x.zones").where(F.col("zones") != DROP))
    asked = cut(cells.select(F.col("host").alias("__h"), F.col("found").alias("__l")).distinct())
    each = parsed.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = each.join(_small(asked), (F.col("host") == F.col("__h")) & (F.col("line") == F.col("__l")), "left_semi").groupBy("host", "line").agg(F.count("*").alias("n"))
    pages = parsed.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "__h")
    counts = counts.join(_small(pages), F.col("host") == F.col("__h")).where(F.col("n") >= F.least(F.lit(SITE_PAGES), "pages"))
    counts = cut(counts.select(F.col("host").alias("__h"), F.col("line").alias("__l"), ((F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= F.col("pages") * ARTICLE_SHARE)).alias("most")))
    found = cells.join(_small(counts), (F.col("host") == F.col("__h")) & (F.col("found") == F.col("__l")))
    gone = found.where((F.col("zones") != ARTICLE) | F.col("most")).groupBy(F.col("key").alias("__k")).agg(F.collect_list("places").alias("gone"))
    return shared.select("key").join(gone, F.col("key") == F.col("__k"), "left").select("key", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    A null or empty html has an empty text; a null URL is the empty one.  Rows
    of one id or URL are pages each.  Without another page on its host, or with
    none but the same page again, a page shares nothing.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    at = shared_path(spark, "pages")
    parse(pages).write.parquet(at)
    parsed = spark.read.schema(_PARSED).parquet(at)
    gone = cut(site_lines(parsed, cut(align(parsed)))).select(F.col("key").alias("__k"), "gone")
    rows = parsed.join(_small(gone), F.col("key") == F.col("__k"), "left")
    alone = F.col("gone").isNull() & F.array_contains("zones", F.lit(ARTICLE))
    kept = F.filter("texts", lambda t, k: (t != "") & ((F.get("zones", k) == ARTICLE) | ~alone) & ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    text = F.array_join(kept, " ")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9(pages: DataFrame) -> DataFrame:
    """The query's rows."""
    return extract(pages)
