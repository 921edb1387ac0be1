"""Sharding by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries, and the records
are range-partitioned between them.  A key that several quantiles fall on has
more than its range can hold: its rows are dealt over that many ranges by
their ids.  Ranges are then measured, and those that came out overfull are
sampled again and subdivided.  Exact sizes of the ranges then place every record on one line of
bytes, which is cut into equal shards.  DataFrame functions only.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ranges: for each shard at least, rows of one, and at most; sampled rows a range.  The sample that reaches the driver has at most RANGES_MOST * SAMPLED rows or so.
RANGES_A_SHARD, ROWS_A_RANGE, RANGES_MOST, SAMPLED = 2, 50_000, 4096, 32
#: A range is overfull from so many times its share on; rounds of subdividing at most.
OVERFULL, ROUNDS = 2.0, 4
#: A group of equal texts stays together if it has at most one part in so many of a shard.
WHOLE = 50
OVERHEAD = 16


@dataclass(frozen=True)
class Splitters:
    """Distinct boundaries in ascending order, and how many quantiles fell on each."""

    keys: tuple[int, ...]
    times: tuple[int, ...]

    def added(self, more: Counter[int]) -> Splitters:
        """With further boundaries; one that is there already is fallen on so many times more."""
        times = Counter(dict(zip(self.keys, self.times, strict=True)))
        times.update(more)
        return Splitters(tuple(sorted(times)), tuple(times[k] for k in sorted(times)))

    def range_of(self, key: Column, spread: Column) -> Column:
        """The number of a record's range: boundaries below its key, found in two short scans, and for an overfull key its part."""
        if not self.keys:
            return F.lit(0).cast("long")
        step = math.isqrt(len(self.keys)) + 1
        blocks = [self.keys[i : i + step] for i in range(0, len(self.keys), step)]
        longs = lambda xs: f"array({', '.join(f'CAST({x} AS BIGINT)' for x in xs)})"
        first, ids = 0, []
        for t in self.times:
            ids.append(first)
            first += 1 + (t if t > 1 else 0)
        block = F.size(F.filter(F.expr(longs([b[-1] for b in blocks])), lambda b: b < key))
        inner = F.element_at(F.expr(f"array({', '.join(longs(b) for b in blocks)})"), F.least(block + 1, F.lit(len(blocks))))
        below = F.when(block == len(blocks), F.lit(len(self.keys))).otherwise(block * step + F.size(F.filter(inner, lambda b: b < key)))
        at = F.least(below + 1, F.lit(len(self.keys)))
        full = (below < len(self.keys)) & (F.element_at(F.expr(longs(self.keys)), at) == key) & (F.element_at(F.expr(longs(self.times)), at) > 1)
        base = F.element_at(F.expr(longs([*ids, first])), below + 1)
        return F.when(full, base + 1 + F.pmod(spread, F.element_at(F.expr(longs(self.times)), at))).otherwise(base)


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key): a null text has no bytes and is a group apart from the empty text."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _quantiles(sample: list[tuple[int, int]], parts: int) -> Counter[int]:
    """The keys that the inner quantiles of a sorted weighted sample fall on."""
    weight = sum(n for _, n in sample)
    out: Counter[int] = Counter()
    passed, k = 0, 1
    for key, n in sample:
        passed += n
        while k < parts and passed * parts >= k * weight:
            out[key] += 1
            k += 1
    return out


def _drawn(rate: float, salt: int) -> Column:
    """How often a row is drawn for a sample; that depends on its size and a hash."""
    return F.floor(F.col("size") * F.lit(rate) + F.pmod(F.xxhash64("doc_id", "key", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def choose_splitters(rows: DataFrame, n_ranges: int, total: int) -> Splitters:
    """Quantiles of a size-weighted sample of keys."""
    sample = rows.select("key", _drawn(n_ranges * SAMPLED / max(1, total), 7).alias("n")).where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Splitters((), ()).added(_quantiles(sorted((r["key"], r["n"]) for r in sample), n_ranges))


def subdivided(rows: DataFrame, split: Splitters, n_ranges: int, total: int) -> Splitters:
    """Splitters under which no range has more than OVERFULL times its share, as far as rows of it can be told apart.

    A round measures all ranges.  An overfull range gets the quantiles of a
    sample of its own as further boundaries; one that has a single key is dealt
    over more ranges.  What comes to the driver are sums of ranges and samples
    of overfull ones, SAMPLED rows for each share that they hold.
    """
    share = max(1.0, total / n_ranges)
    spread = F.xxhash64("doc_id", F.lit(11))
    for k in range(ROUNDS):
        dealt = rows.withColumn("range", split.range_of(F.col("key"), spread))
        sizes = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("most"), F.min("key").alias("low"), F.max("key").alias("high"))
        # A range whose one large record makes it overfull can't be cut.
        full = sizes.where(F.col("bytes") - F.col("most") > OVERFULL * share).collect()
        if not full:
            break
        parts = {r["range"]: -(-r["bytes"] // int(share)) for r in full}
        more: Counter[int] = Counter({r["low"]: parts[r["range"]] - 1 for r in full if r["low"] == r["high"] and r["low"] is not None})
        mixed = [r["range"] for r in full if r["low"] != r["high"]]
        if mixed:
            chosen = rows.sparkSession.createDataFrame([(x,) for x in mixed], "range long")
            drawn = dealt.join(F.broadcast(chosen), "range").select("range", "key", _drawn(SAMPLED / share, 13 + k).alias("n")).where("n > 0")
            samples: dict[int, list[tuple[int, int]]] = {}
            for r in drawn.groupBy("range", "key").agg(F.sum("n").alias("n")).collect():
                samples.setdefault(r["range"], []).append((r["key"], r["n"]))
            for x, sample in samples.items():
                more.update(_quantiles(sorted(sample), parts[x]))
        if not more:
            break
        split = split.added(more)
    return split


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for every row of docs, law `bytes`.

    A record, or a small group of equal texts, goes where its middle falls, so
    a shard misses its share by half a record or small group at either end.  Slots count from
    0 in each shard.  Null ids, null texts and repeated rows are records like
    others; an empty table gives none.
    """
    rows = cut(records(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = min(RANGES_MOST, max(RANGES_A_SHARD * shards, -(-n // ROWS_A_RANGE)))
    split = subdivided(rows, choose_splitters(rows, n_ranges, total), n_ranges, total)
    dealt = rows.withColumn("range", split.range_of(F.col("key"), F.xxhash64("doc_id", F.lit(11))))
    line = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "key")
    start = F.col("before") + F.sum("size").over(within) - F.col("size")
    placed = dealt.join(F.broadcast(offsets), "range").withColumn("start", start)
    placed = placed.withColumn("group_start", F.min("start").over(group)).withColumn("group_size", F.sum("size").over(group))
    alone = F.col("group_size") * (WHOLE * shards) > total
    middle = F.when(alone, 2 * F.col("start") + F.col("size")).otherwise(2 * F.col("group_start") + F.col("group_size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(1, 2 * total)))).cast("int")
    placed = cut(placed.select("doc_id", "size", "text_crc32", "key", "range", shard.alias("shard")))
    own = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("slots_before"))
    number = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "doc_id"))
    slot = (F.col("slots_before") + number - 1).cast("long")
    return placed.join(F.broadcast(slots), ["shard", "range"]).select("doc_id", "size", "text_crc32", "key", "shard", slot.alias("slot"))


def op8(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The query's rows, by the law `bytes`; grown_shard is for the law `key` only."""
    out = assign(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
