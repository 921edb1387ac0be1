"""N-gram Jaccard join by prefixes under several global orders.

A document's set holds the hashes of its distinct word shingles.  If two sets
of sizes x and y are as alike as asked, they have a token in common among the
first x - ceil(t x) + 1 and y - ceil(t y) + 1 of any order that holds for all
documents.  More: what they have in common in these prefixes, and what is left
behind them, must add up to the overlap that the sizes demand.

1. Tokens are counted in a table of fixed size.  The first and the second order
   put frequent tokens last and have each their own hash within a class of
   frequency; the third is a hash alone, whatever the frequency.
2. Prefixes under the first order meet by token.  In each bucket a few pivots
   are paired with the rest, so pairs grow as the bucket does.  Candidates are
   the pairs that share enough in the prefixes of all three orders; they are
   verified on whole sets, and linked ones become one component.  Another
   round has other pivots.
3. What remains are buckets with several components.  There all pairs of sets
   in different components are counted whose parity sketches allow a link: two
   sets differ in at least as many tokens as their sketches in bits.  Members
   of a bucket's largest component are paired with the others only.  So no
   link between different sets is lost, but those inside a component already
   known are not looked for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _U64, cut, doc_text, map_batches, mix64, shared_path, slices, span_hashes, text_buffer, window_hashes, word_spans
from .components import components

#: Fixed values of the query: words in a shingle, and the similarity in hundredths.
WORDS, PERCENT = 4, 85
#: Rounds of pivots, pivots of a bucket, 64-bit words of a parity sketch, tokens before one that go with it, ids that may be broadcast.
PIVOTS, FEW, SKETCH, BEFORE, BROADCAST_IDS = 2, 4, 8, 4, 1_000_000
#: Members of a bucket from which it is dealt by bands of size.
HOT = 1000
#: The count table has a power of two of counters, about one for so many tokens, between these bounds.
A_COUNTER, COUNTERS_LEAST, COUNTERS_MOST, SLICES = 64, 16, 22, 64
#: Tables that one task adds up; more are added in several levels.
FAN_IN = 256
_SEED = (_U64(0xA0761D6478BD642F), _U64(0xE7037ED1A0B428DB), _U64(0x8EBC6AF09C88C6E3))


def shingle_sets(text: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text, A-Z in lower case.

    A text with fewer words has its whole sequence as its one token; one
    without words, empty or null, has none.
    """
    buf, offsets = text_buffer(text)
    n = len(offsets) - 1
    starts, ends, rows = word_spans(buf, offsets)
    words = span_hashes(buf, starts, ends, fold=True)
    hashes, at = window_hashes(words, rows, size)
    counts = np.bincount(rows[at], minlength=n)
    stops = np.cumsum(counts)
    n_words = np.bincount(rows, minlength=n)
    firsts = np.cumsum(n_words) - n_words
    out = []
    for i in range(n):
        if counts[i]:
            out.append(np.unique(hashes[stops[i] - counts[i] : stops[i]]))
        elif n_words[i]:
            h = np.full(1, n_words[i], _U64)
            for w in words[firsts[i] : firsts[i] + n_words[i]]:
                h = mix64(h * _U64(0xD1342543DE82EF95) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, _U64))
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def ranked(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Where each token stands in one of the global orders: its class of frequency, then a hash; in the last order a hash alone."""
    hashed = mix64(tokens ^ _SEED[order])
    if order == len(_SEED) - 1:
        return hashed
    frequent = classes[(tokens & _U64(len(classes) - 1)).astype(np.int64)].astype(_U64)
    return frequent << _U64(58) | hashed >> _U64(6)


def ranked_prefix(tokens: np.ndarray, classes: np.ndarray, order: int, p: int) -> bytes:
    """The least p ranks of a set, ascending, cut to 32 bits."""
    rank = ranked(tokens, classes, order)
    rank = np.partition(rank, p - 1)[:p] if p < len(rank) else rank
    return (np.sort(rank) >> _U64(32)).astype("<u4").tobytes()


def token_classes(docs: DataFrame, size: int = WORDS) -> np.ndarray:
    """A class of frequency for each counter, from the tokens of all documents.

    Tasks count into a table of fixed size and hand on compressed slices; the
    sums have COUNTERS_MOST bits of index at most.  The classes only order
    tokens: a rare token that shares its counter costs time and nothing else.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(COUNTERS_MOST, max(COUNTERS_LEAST, int(n_bytes / 8 / A_COUNTER).bit_length()))
    m = 1 << bits
    width = m // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(m, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(0), size)
                if sets:
                    table += np.bincount((np.concatenate(sets) & _U64(m - 1)).astype(np.int64), minlength=m)
        if table.any():
            blobs = [zlib.compress(table[i * width : (i + 1) * width].astype("<i8").tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def add(frame):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for blob in frame["counts"]:
            total += np.frombuffer(zlib.decompress(blob), "<i8")
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "part": [frame["part"].iloc[0]], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    # A task adds FAN_IN tables at most, so its memory doesn't grow with the number of tasks.
    texts = docs.select("text")
    tables = map_batches(texts, count, "slice int, counts binary").withColumn("part", F.spark_partition_id())
    groups = texts.rdd.getNumPartitions()
    while True:
        groups = max(1, -(-groups // FAN_IN))
        tables = tables.withColumn("part", F.col("part") % groups).groupBy("slice", "part").applyInPandas(add, "slice int, part int, counts binary")
        if groups == 1:
            break
    table = np.zeros(m, np.int64)
    for row in tables.collect():
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    mean = max(1.0, table.sum() / m)
    return np.clip(np.floor(np.log2(np.maximum(table / (1.5 * mean), 0.5))) + 1, 0, 31).astype(np.uint8)


_SETS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType()),
    T.StructField("first", T.ArrayType(T.LongType())), T.StructField("second", T.BinaryType()), T.StructField("third", T.BinaryType()), *[T.StructField(f"p{k}", T.LongType()) for k in range(SKETCH)],
])


def text_key() -> Column:
    """What a row of documents is found again by: a hash of its id and all of its text."""
    return F.xxhash64("doc_id", "text")


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bit for each class of token hashes: whether a set has an odd number of it."""
    odd = np.bincount((mix64(tokens) >> _U64(40)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, classes: np.ndarray, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Each document's set size, its class (equal sets share one), its prefixes, tokens under the first order and ranks under the others, and its parity sketch.

    `id` numbers the rows, so a row without doc_id, or one of several with it,
    is one of its own.  It holds once the rows are written.  A task gives the
    prefixes of a class once.  Sets too small to be linked with a different one
    have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, ids, first, second, third, sketch = [], [], [], [], [], []
                for tokens in shingle_sets(part.column(3), size):
                    n = len(tokens)
                    cls = int(mix64(np.array([int(mix64(tokens).sum(dtype=_U64)) ^ n], _U64)).view(np.int64)[0]) if n else None
                    sizes.append(n)
                    ids.append(cls)
                    if cls in seen or 100 * n < percent * (n + 1):
                        for x in (first, second, third):
                            x.append(None)
                        sketch.append([None] * SKETCH)
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(cls)
                    p = prefix_size(n, percent)
                    rank = ranked(tokens, classes, 0)
                    near = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                    first.append(tokens[near[np.argsort(rank[near])]].view(np.int64))
                    second.append(ranked_prefix(tokens, classes, 1, p))
                    third.append(ranked_prefix(tokens, classes, 2, p))
                    sketch.append(parity(tokens).tolist())
                made = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.binary()), pa.array(third, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made, *[pa.array([x[k] for x in sketch], pa.int64()) for k in range(SKETCH)]], names=_SETS.names)

    return map_batches(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", text_key().alias("key"), "text"), run, _SETS)


def sizes_match(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def enough(common: str, a: str, b: str, percent: int) -> Column:
    """The count filter: common prefix tokens and what is left behind the prefixes reach the overlap that the sizes demand."""
    behind = lambda c: F.ceil(F.lit(percent) * F.col(c) / 100) - 1
    return (F.col(common) + F.greatest(behind(a), behind(b))) * (100 + percent) >= percent * (F.col(a) + F.col(b))


def order_allows(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, percent: int) -> bool:
    """The count filter under an order, on ranks cut to 32 bits: cutting can only add to what is in common."""
    end = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, end)], y[: np.searchsorted(y, end)]
    common = min(np.isin(x, y).sum(), np.isin(y, x).sum()) if len(x) and len(y) else 0
    most = int(common) + min(n_x - len(x), n_y - len(y))
    return most * (100 + percent) >= percent * (n_x + n_y)


def _attach(pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """pairs (a, b) with the named columns of values (id, ...) of both, as a_ and b_."""
    for side in ("b", "a"):
        own = values.select(F.col("id").alias("__id"), *[F.col(c).alias(f"{side}_{c}") for c in names])
        pairs = pairs.join(own, F.col(side) == F.col("__id")).drop("__id")
    return pairs


def _only(values: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of values whose id is among ids (__i), which are written down and distinct; values aren't shuffled if these are few."""
    return values.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("id") == F.col("__i"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("__i")).union(pairs.select(F.col("b").alias("__i"))).distinct())


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs that the first order admits those that the others admit too."""
    pairs = cut(pairs)
    values = sets.where(F.col("second").isNotNull()).select("id", "second", "third", F.col("n_shingles").alias("n"))
    both = _attach(pairs, _only(values, _ends(pairs)), ["second", "third", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
            keep = [
                k for k in range(batch.num_rows)
                if all(order_allows(np.frombuffer(col[f"a_{o}"][k], "<u4"), np.frombuffer(col[f"b_{o}"][k], "<u4"), col["a_n"][k], col["b_n"][k], percent) for o in ("third", "second"))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([col[c][k] for k in keep], pa.int64()) for c in ("a", "b")], names=["a", "b"])

    return map_batches(both, run, "a long, b long").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose whole sets are as alike as asked.  Only the texts of documents in pairs are read on."""
    keys = cut(_only(sets.select("id", "key"), _ends(pairs)))
    wanted = cut(keys.select(F.col("key").alias("__k")).distinct())
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select(text_key().alias("key"), "text").join(F.broadcast(wanted) if small else wanted, F.col("key") == F.col("__k"), "left_semi")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [s.astype("<u8").tobytes() for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "a_tokens", "b_tokens"))
            keep = []
            for k in range(batch.num_rows):
                s, t = np.frombuffer(x[k].as_buffer(), "<u8"), np.frombuffer(y[k].as_buffer(), "<u8")
                both = np.sort(np.concatenate([s, t]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    found = map_batches(texts, tokens_of, "key long, tokens binary")
    # Rows alike in id and text have one key; of their sets one is enough.
    again = sets.select("key").join(F.broadcast(wanted) if small else wanted, F.col("key") == F.col("__k"), "left_semi").groupBy("key").count().where("count > 1")
    if not again.isEmpty():
        found = found.dropDuplicates(["key"])
    named = _attach(pairs, keys, ["key"])
    for side in ("b", "a"):
        named = named.join(found.select(F.col("key").alias("__k"), F.col("tokens").alias(f"{side}_tokens")), F.col(f"{side}_key") == F.col("__k")).drop("__k")
    return map_batches(named.select("a", "b", "a_tokens", "b_tokens"), run, "a long, b long").distinct()


def _buckets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets; the classes of equal sets; and (token, id, n) of each class under each prefix token that several rows have."""
    spark = docs.sparkSession
    classes = token_classes(docs, size)
    at = shared_path(spark, "prefixes")
    prefixes(docs, classes, size, percent).write.parquet(at)
    sets = spark.read.schema(_SETS).parquet(at)
    # Each class has the least id of its documents, and the row that its prefixes are written with.
    lead = F.min(F.when(F.col("first").isNotNull(), F.col("id")))
    members = sets.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), lead.alias("lead"), F.min("id").alias("any"), F.max("n_shingles").alias("n"))
    members = cut(members.select("cls", "rep", F.coalesce("lead", "any").alias("place"), F.col("lead").isNotNull().alias("has_prefix"), "n"))
    each = sets.where(F.col("first").isNotNull()).select("id", F.explode("first").alias("token"))
    several = each.groupBy("token").agg(F.count("*").alias("__n")).where("__n > 1").select("token")
    # A class whose prefixes several tasks gave is in a bucket once.
    reps = members.where("has_prefix").select(F.col("place").alias("__p"), F.col("n").cast("int").alias("n"))
    met = each.join(several, "token", "left_semi").join(reps, F.col("id") == F.col("__p"))
    return sets, members, cut(met.select("token", "id", "n"))


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: every linked pair of different sets, verified, inside components too; a set goes by the least id of its documents.

    Nothing is skipped for being connected already, so the pairs grow with the
    square of a group of different near copies; join doesn't need them.  Sets
    that only rows without id have are left out.
    """
    docs = doc_text(docs)
    sets, members, met = _buckets(docs, size, percent)
    pairs = _all_pairs(met.withColumn("component", F.col("id")), sets, percent)
    found = _verify(cut(_candidates(pairs, sets, percent)), docs, sets, size, percent)
    named = _attach(found, members.where("rep IS NOT NULL").select(F.col("place").alias("id"), "rep"), ["rep"])
    return named.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Rows of one id are held together by the id, whatever their sets.  A row
    without id takes part like any other; a component is named by its least id,
    and by null if none of its rows has one.
    """
    docs = doc_text(docs)
    sets, members, met = _buckets(docs, size, percent)
    links = labels = None
    for k in range(pivots + 1):
        rows = met.withColumn("component", F.col("id")) if labels is None else _labelled(met, labels)
        if labels is not None:
            several = rows.groupBy("token").agg(F.min("component").alias("__x"), F.max("component").alias("__y")).where("__x < __y").select("token")
            rows = cut(rows.join(several, "token", "left_semi"))
        pairs = _pivot_pairs(rows, k, percent) if k < pivots else _all_pairs(rows, sets, percent)
        found = cut(_verify(cut(_candidates(pairs, sets, percent)), docs, sets, size, percent))
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    # Documents of one id with different sets are one.
    again = sets.where(F.col("doc_id").isNotNull() & F.col("cls").isNotNull()).groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select(F.col("doc_id").alias("__d"))
    if not again.isEmpty():
        own = sets.join(again, F.col("doc_id") == F.col("__d"), "left_semi").select("doc_id", F.col("cls").alias("__c")).distinct()
        ends = own.join(members.select("cls", "place"), F.col("cls") == F.col("__c")).select("doc_id", "place")
        heads = ends.groupBy("doc_id").agg(F.min("place").alias("a")).withColumnRenamed("doc_id", "__d")
        links = links.unionByName(ends.join(heads, F.col("doc_id") == F.col("__d")).select("a", F.col("place").alias("b")))
        labels = components(links)
    # Only classes that have a link need a name from others.
    linked = cut(members.join(labels.select(F.col("id").alias("__i"), "component"), F.col("place") == F.col("__i")).select("cls", "rep", "component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "__k")
    least = F.broadcast(least) if least.count() <= BROADCAST_IDS else least
    named = linked.join(least, F.col("component") == F.col("__k")).select(F.col("cls").alias("__c"), "least")
    alone = members.join(labels.select(F.col("id").alias("__i")), F.col("place") == F.col("__i"), "left_anti").select(F.col("cls").alias("__c"), F.col("rep").alias("least"))
    out = sets.select("doc_id", "n_shingles", "cls").join(named.unionByName(alone), F.col("cls") == F.col("__c"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    return met.join(labels.select(F.col("id").alias("__i"), F.col("component").alias("__k")), F.col("id") == F.col("__i"), "left").select("token", "id", "n", F.coalesce("__k", "id").alias("component"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _pivot_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """In each bucket, a few members with all of other components; pairs that share too few tokens this way wait for the last step."""
    # The least id with some bits turned over: other bits, another member, and what is aggregated is one number.
    salts = [int(x) for x in mix64(np.arange(FEW * turn + 1, FEW * turn + FEW + 1, dtype=_U64)).view(np.int64)]
    few = F.array_distinct(F.array(*[F.min(F.col("id").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in salts]))
    pivots = rows.groupBy("token").agg(few.alias("__few")).select(F.col("token").alias("__t"), F.explode("__few").alias("pivot"))
    nodes = cut(rows.select(F.col("id").alias("__i"), F.col("n").alias("pivot_n"), F.col("component").alias("pivot_component")).distinct())
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    pivots = pivots.join(nodes, F.col("pivot") == F.col("__i"))
    paired = rows.join(pivots, F.col("token") == F.col("__t")).where((F.col("component") != F.col("pivot_component")) & sizes_match("n", "pivot_n", percent))
    met = paired.select(*_ordered(F.col("pivot"), F.col("id")), F.least("pivot_n", "n").alias("s"), F.greatest("pivot_n", "n").alias("t"))
    # Two pivots meet twice in a bucket, which only lets their pair pass more easily.
    counted = met.groupBy("a", "b", "s", "t").agg(F.count("*").alias("common"))
    return counted.where(enough("common", "s", "t", percent)).select("a", "b")


def _all_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of members in different components that differ in no more tokens than a link may.

    Members meet by token, in buckets of over HOT members also by band of size:
    sets that can be linked are at most one band apart.  On one side of the
    join are the members outside the bucket's largest component only.  The
    sketches bound the difference before a pair leaves the join.  A pair leaves
    it in the bucket of its first common token, and hardly in others: a token
    is passed over if one of the few before it is common too, since the pair is
    then met there.
    """
    words = [f"p{k}" for k in range(SKETCH)]
    main = rows.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token")
    main = main.agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("total")).withColumnRenamed("token", "__t")
    values = _only(sets.where(F.col("first").isNotNull()).select("id", "first", *words), cut(rows.select(F.col("id").alias("__i")).distinct())).withColumnRenamed("id", "__d")
    at = F.array_position("first", F.col("token")).cast("int")
    before = F.slice("first", F.greatest(at - BEFORE, F.lit(1)), F.greatest(F.least(at - 1, F.lit(BEFORE)), F.lit(0)))
    # A band is a little wider than sizes of linked sets can differ, so rounding can't put them two bands apart.
    band = F.floor(F.log(F.col("n")) / F.lit(max(math.log(100 / percent), 1e-9) * (1 + 1e-9))).cast("long")
    band = F.when(F.col("total") > HOT, band)
    rows = rows.join(main, F.col("token") == F.col("__t")).join(values, F.col("id") == F.col("__d"))
    rows = rows.select("token", "id", "n", "component", (F.col("component") != F.col("main")).alias("odd"), band.alias("band"), before.alias("before"), *words)
    own = ["id", "n", "component", "odd", "before", *words]
    side = lambda x, band: [F.col("token"), band.alias("band"), *[F.col(c).alias(f"{x}_{c}") for c in own]]
    left = rows.where("odd").select(*side("a", F.coalesce("band", F.lit(-1).cast("long"))))
    near_bands = F.when(F.col("band").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    right = rows.select(*side("b", F.explode(near_bands)))
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    # 2 * overlap is n + n less the difference.
    near = (F.col("a_n") + F.col("b_n") - differ) * (100 + percent) >= 2 * percent * (F.col("a_n") + F.col("b_n"))
    apart = (~F.col("b_odd") | (F.col("a_id") < F.col("b_id"))) & (F.col("a_component") != F.col("b_component"))
    first = ~F.arrays_overlap("a_before", "b_before")
    met = left.join(right, ["token", "band"]).where(apart & sizes_match("a_n", "b_n", percent) & near & first)
    return met.select(*_ordered(F.col("a_id"), F.col("b_id"))).distinct()


def op4(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return join(docs)
