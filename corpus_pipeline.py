"""From documents to token ids in five stages; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, jaccard, mixing, quality, rules
from lattica.llm.common import aside, cut, discard, read_table, shared_path

#: Near duplicates: words in a shingle, similarity in hundredths, rows of keys that may be broadcast.
SHINGLE, SIMILARITY, BROADCAST_IDS = 5, 80, 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all columns as they are.

    A null or empty text has the score that the calibration gives for nothing;
    repeated rows are judged alike; an empty table stays empty.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    rows, again = aside(docs, ["__quality"])
    return again(quality.score(rows, model, "__quality").where(F.col("__quality") >= quality.THRESHOLD))


def keep_ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy, with all columns as they are, also those named as a measurement.

    A null or empty text has too few words and goes; repeated rows are judged
    alike; an empty table stays empty.
    """
    rows, again = aside(docs, [*rules.MEASURES, "failed", "__kept"])
    return again(rules.apply_policy(rules.ledger(rows), rules.CURRENT, "__kept").where("__kept"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id, null being the greatest; all columns as they are.

    A row takes part as itself: rows of one id stay if their texts are no near
    duplicates, rows without id are compared like others, and of rows alike in
    id and text one stays.  Documents without words are no duplicates.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut(jaccard.join(docs.select(key.alias("doc_id"), "text"), SHINGLE, SIMILARITY).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")))
    copies = found.distinct()
    several = copies.groupBy("component").count().where("count > 1").select("component")
    members = cut(copies.join(_few(several), "component", "left_semi"))
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    named = ids.join(_few(members), "key")
    stays = cut(named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select(F.col("x.key").alias("__k")))
    gone = cut(members.select("key").join(_few(stays), F.col("key") == F.col("__k"), "left_anti"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    left = rows.join(_few(gone), "key", "left_anti")
    repeated = cut(found.groupBy("key").count().where("count > 1").select("key"))
    if repeated.isEmpty():
        return left.select("row.*")
    repeated = _few(repeated)
    one = left.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(repeated, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, with all columns as they are.

    A null source is a source of its own; documents without words are taken
    not at all; an empty table stays empty.
    """
    return mixing.apply_mix(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded bytes.

    A null or empty text has no ids; repeated rows are encoded each.  doc_id
    and source are those of docs, whatever other columns it has.
    """
    return bpe.encode_documents(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("rules", keep_ruled),
    ("near_duplicates", keep_one_of_each),
    ("mix", take_mix),
    ("bpe", encode),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again, and go when the next one's are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)
