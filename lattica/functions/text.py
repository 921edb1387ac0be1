"""Scalar functions as Columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a name's tokens.
TOKEN = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z][a-z0-9]*|[0-9]+"
#: The canonical arrows, and those that mean inheritance.
ARROWS = ("..>", "-->", "o--", "*--", "<|--", "<|..")
INHERITANCE = ("<|--", "<|..")


def strip(c: Column) -> Column:
    """Without white space at both ends: space, tab, line ends, NUL and vertical tab."""
    return F.btrim(c, F.lit(" \t\n\r\0\x0b"))


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(TOKEN), F.lit(0))


def prefix_key(name: Column, alias: Column, n: int) -> Column:
    """The first n tokens of a name put together; the alias if it has none."""
    found = tokens(name)
    return F.when(F.size(found) == 0, alias).otherwise(F.array_join(F.slice(found, 1, n), ""))


def slug(name: Column) -> Column:
    """A file-safe name: lower case, other runs one underscore, none at the ends; `cluster` if nothing is left."""
    flat = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(flat == "", F.lit("cluster")).otherwise(flat)


def base_arrow(arrow: Column) -> Column:
    """The canonical form of a bare or styled arrow; null for others."""
    bare = F.regexp_replace(arrow, r"\[[^\]]*\]", "")
    base = F.when(arrow.rlike(r"^<\|-\[[^\]]*\]--$"), F.lit("<|--")).when(arrow.rlike(r"^<\|\.\[[^\]]*\]\.\.$"), F.lit("<|..")).otherwise(bare)
    one = arrow.rlike(r"^(\.(\[[^\]]*\])?\.>|-(\[[^\]]*\])?->|o-(\[[^\]]*\])?-|\*-(\[[^\]]*\])?-|<\|--|<\|\.\.|<\|-\[[^\]]*\]--|<\|\.\[[^\]]*\]\.\.)$")
    return F.when(one, base)


def style_arrow(arrow: Column, color: Column, thickness: Column) -> Column:
    """The arrow with [colour,thickness=n]; as it is if neither is given or the form is unknown."""
    style = F.concat(F.lit("["), F.concat_ws(",", color, F.when(thickness.isNotNull(), F.concat(F.lit("thickness="), thickness.cast("string")))), F.lit("]"))
    base = base_arrow(arrow)
    # The trunk opens after the head: two characters of an inheritance arrow, of o and * arrows two, else one.
    at = F.when(base.isin(*INHERITANCE), 3).when(base.isin("o--", "*--"), 2).otherwise(1)
    head = F.substring(base, F.lit(1), at)
    tail = F.when(base == "<|--", F.lit("--")).when(base == "<|..", F.lit("..")).otherwise(F.substring(base, at + 1, F.lit(9)))
    return F.when((color.isNull() & thickness.isNull()) | base.isNull(), arrow).otherwise(F.concat(head, style, tail))


def is_inheritance(arrow: Column) -> Column:
    return arrow.isin(*INHERITANCE)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def edge_color(index: Column) -> Column:
    """The index-th colour: hues by the golden angle, saturation 0.65, lightness 0.40."""
    hue = (index.cast("double") * F.lit(137.508)) % F.lit(360.0)
    chroma = F.lit((1 - abs(2 * 0.40 - 1)) * 0.65)
    x = chroma * (1 - F.abs((hue / 60.0) % 2.0 - 1))
    low = F.lit(0.40) - chroma / 2
    sixth = F.floor(hue / 60.0)
    none = F.lit(0.0)
    parts = ((chroma, x, none), (x, chroma, none), (none, chroma, x), (none, x, chroma), (x, none, chroma), (chroma, none, x))
    rgb = []
    for k in range(3):
        c = parts[5][k]
        for s in range(4, -1, -1):
            c = F.when(sixth == s, parts[s][k]).otherwise(c)
        rgb.append(F.round((c + low) * 255).cast("int"))
    return F.format_string("#%02X%02X%02X", *rgb)


def thickness(n: Column, most: Column) -> Column:
    """From 1 to 4, in proportion to the most frequent pair."""
    return F.when(most <= 1, F.lit(1)).otherwise(1 + F.round((n - 1) / (most - 1) * 3)).cast("int")
