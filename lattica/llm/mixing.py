"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, its
target's share of the source.  The whole part is certain; the fraction is an
inclusion probability.  The flight phase moves the probabilities of three
documents at a time along the one direction that keeps both the tokens and the
number of documents, until one of them is 0 or 1.  It runs in blocks; what a
block leaves, two documents or less, flies on with what other blocks left,
until a source has one block.  The landing decides its last dozen, of
all lengths, by the rounding that errs least.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, partitions_for

#: Fixed values of the mix: weights in turn, tokens taken in all, copies of a document at most.
WEIGHTS, SHARE, COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a block, and sources up to which their table is broadcast.
BLOCK, SOURCES = 512, 10_000
#: Documents of a source, of all lengths, that the landing decides with the two or less that flight leaves.
LANDING = 12
_EPS = 1e-9


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: float = COPIES) -> DataFrame:
    """(of, source_size, target) of each source: weights in code point order, null last; what is above the most goes to the others by weight.

    Of rows (source, size).  Sources stay in a table: they are numbered over
    range partitions, and a round of sharing is one aggregation that gives the
    words still to share and the weight still to share them by.  What a unit
    of weight gets only grows, so it alone tells whose target has stopped.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sums.repartitionByRange(partitions_for(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(ranged.join(F.broadcast(before), "part").select(F.col("source").alias("of"), "source_size", F.get(turn, F.pmod(number, F.lit(len(weights))).cast("int")).alias("weight")))
    each, n_over = 0.0, None
    while True:
        over = F.col("weight") * each > F.col("source_size") * copies
        total, stopped, free, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if not free or n == n_over:
            break
        each, n_over = (share * total - copies * (stopped or 0)) / free, n
    target = F.when(F.col("weight") * each > F.col("source_size") * copies, F.col("source_size") * copies).otherwise(F.col("weight") * each)
    return sources.select("of", "source_size", target.cast("double").alias("target"))


def fly(sizes: list[int], chance: list[float], rng: random.Random) -> list[float]:
    """The flight phase over units in their order: at most two stay between 0 and 1."""
    out = list(chance)
    active: list[int] = []
    for nxt in range(len(out)):
        if not _EPS < out[nxt] < 1 - _EPS:
            out[nxt] = float(round(out[nxt]))
            continue
        active.append(nxt)
        while len(active) >= 2:
            if len(active) >= 3:
                i, j, k = active[-3:]
                u = (sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i])
                units = [(i, u[0]), (j, u[1]), (k, u[2])] if any(u) else [(i, 1), (j, -1)]
            elif sizes[active[0]] == sizes[active[1]]:
                units = [(active[0], 1), (active[1], -1)]
            else:
                break
            scale = max(abs(d) for _, d in units)
            units = [(x, d / scale) for x, d in units if d]
            up = min((1 - out[x]) / d if d > 0 else out[x] / -d for x, d in units)
            down = min(out[x] / d if d > 0 else (1 - out[x]) / -d for x, d in units)
            move = up if rng.random() * (up + down) < down else -down
            for x, d in units:
                out[x] += move * d
                if not _EPS < out[x] < 1 - _EPS:
                    out[x] = float(round(out[x]))
            active = [x for x in active if 0 < out[x] < 1]
    return out


def land(sizes: list[int], chance: list[float]) -> list[float]:
    """Of all roundings of the units that flight left, the one whose tokens, and then documents, err least."""
    left = [i for i, x in enumerate(chance) if 0 < x < 1]
    out = list(chance)
    if left:
        size, share = np.array([sizes[i] for i in left], dtype=float), np.array([chance[i] for i in left])
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        tokens, count = np.abs((choices - share) @ size), np.abs((choices - share).sum(axis=1))
        best = choices[np.lexsort([np.arange(len(choices)), np.round(count, 6), np.round(tokens, 3)])[0]]
        for i, x in zip(left, best, strict=True):
            out[i] = float(x)
    return out


_FLOWN = T.StructType([T.StructField(*x) for x in (("doc_id", T.LongType()), ("source", T.StringType()), ("size", T.LongType()), ("base", T.LongType()), ("chance", T.DoubleType()))])


def _flight(level: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        if last:
            # Long documents are decided first; one of each length waits for the landing.
            wait = {round(i) for i in np.linspace(0, len(frame) - 1, min(LANDING, len(frame)))}
            frame = frame.iloc[[*(i for i in range(len(frame)) if i not in wait), *sorted(wait)]]
        source, block = frame["source"].iloc[0], int(frame["block"].iloc[0])
        rng = random.Random(zlib.crc32(f"{source}|{block}|{level}".encode()))
        sizes, chance = frame["size"].tolist(), frame["chance"].tolist()
        far = max(0, len(sizes) - LANDING) if last else len(sizes)
        out = [*fly(sizes[:far], chance[:far], rng), *chance[far:]]
        if last:
            out = land(sizes, out)
        return pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "size": frame["size"], "base": frame["base"], "chance": out})

    return run


def _fly_blocks(rows: DataFrame, level: int) -> tuple[DataFrame, bool]:
    """One level of flights; whether it was the last, with one block a source."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    last = (counts.agg(F.max("n")).first()[0] or 0) <= BLOCK
    order = F.xxhash64("doc_id", "size", F.lit(level))
    if last:
        dealt = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = counts.select(F.col("source").alias("of"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        joined = rows.join(F.broadcast(blocks) if counts.count() <= SOURCES else blocks, F.col("source").eqNullSafe(F.col("of")))
        dealt = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(1000 + level)), F.col("blocks")))
    dealt = dealt.select("doc_id", "source", "size", "base", "chance", "block", order.alias("order"))
    return dealt.groupBy("source", "block").applyInPandas(_flight(level, last), _FLOWN), last


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of the whole text, none for null."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs.

    A null source is a source, the last; documents without words and those of
    a source without words get no copies.  Repeated rows are drawn each.
    Draws depend on ids, sizes and sources only, so reruns agree.
    """
    rows = cut(sized(docs))
    table = source_targets(rows)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(COPIES), F.col("target") / F.col("source_size"))).otherwise(0.0)
    small = cut(table.withColumn("rate", rate).select("of", "source_size", "target", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("chance")))
    few = small.count() <= SOURCES
    small = F.broadcast(small) if few else small
    open_rows = rows.where("size > 0").join(small, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "base", "chance")
    still = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("base"), F.lit(0.0).alias("chance"))
    level, last, parts = 1, False, [still]
    while not last:
        flown, last = _fly_blocks(open_rows, level)
        flown = cut(flown)
        parts.append(flown if last else flown.where("chance = 0 OR chance = 1"))
        open_rows = flown.where("chance > 0 AND chance < 1")
        level += 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    copies = (F.col("base") + F.round("chance")).cast("long")
    totals = small.drop("base", "chance")
    return whole.join(F.broadcast(totals) if few else totals, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def apply_mix(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs, each as often as decided; rows alike in id, source and size share their copies in text order."""
    key = ["__id", "__source", "__size"]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # The row travels as one struct, so no column of docs can clash with the keys.
    left = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), size.alias("__size"), F.xxhash64("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    right = decisions.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    right = right.where("__copies > 0").select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__z"), "__copies", "__rows")
    both = left.join(right, F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("__text"))
    own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(turn <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    taken = both.withColumn("__own", own).where("__own > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__own").cast("int")))).select("__row.*")


def op10(docs: DataFrame) -> DataFrame:
    """The query's rows: taken is size times copies."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


