"""Quality by compression.

Two zstandard dictionaries, one of text labelled good and one of text labelled
bad, make the pieces of a text smaller the more they look like it.  The score
is a calibrated function of the difference of both sizes, summed over all
pieces of the whole text and normalised by its length; of nothing else.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, doc_text, held_out

#: Bound of what is learned from: documents of a class, each with its whole text.
SAMPLE_DOCS = 1500
#: Bytes of a dictionary, of a piece that it is trained on, and of a piece that is compressed; the level of compression.
DICTIONARY_BYTES, TRAINED_BYTES, PIECE_BYTES, LEVEL = 262144, 512, 1024, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration; small, so it goes to executors with the task."""

    good: bytes
    bad: bytes
    trained: bool
    weights: tuple[float, ...]

    def kernel(self):
        import zstandard

        kind = zstandard.DICT_TYPE_AUTO if self.trained else zstandard.DICT_TYPE_RAWCONTENT
        made = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


def difference(data: bytes, good, bad) -> float:
    """The difference of the sizes by both dictionaries, summed over all pieces, for each byte of the text: above 0 if the good one makes them smaller."""
    g = b = 0
    for i in range(0, len(data), PIECE_BYTES):
        piece = data[i : i + PIECE_BYTES]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / max(1, len(data))


def _design(differences: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(differences)), differences * 20])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * weight.sum()
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * weight.sum() * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """(doc_id, label, whole text) of a bounded sample of labelled rows that aren't held out, and how many rows each class has.

    Rows are drawn by a hash of the id, so reruns agree; contradicting labels
    of one id count as the larger, and of the texts of one id the least by hash
    stands for it.
    """
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = train.where(F.col("y") == y).select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))
    base = doc_text(docs).where(F.col("text").isNotNull() & (F.col("text") != ""))
    rows = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    return sorted((r["doc_id"], r["y"], r["text"]) for r in rows), counts


def fit_from_sample(sample: list[tuple[int, int, str]], counts: dict[int, int]) -> QualityModel:
    """Dictionaries from half of the sample, the calibration from the other half, weighted to the classes' true shares."""
    import zstandard

    texts: dict[int, list[bytes]] = {0: [], 1: []}
    # In an order that has nothing to do with how the documents came.
    for _, y, text in sorted(sample, key=lambda r: (zlib.crc32(str(r[0]).encode()), r)):
        texts[y].append(text.encode("utf-8", "replace"))
    if not texts[0] or not texts[1]:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        return QualityModel(b"good text", b"bad text", False, (float(np.log((share + 0.01) / (1.01 - share))), 0.0))
    dictionaries, rest, raw, trained = {}, {}, {}, True
    for y in (0, 1):
        half = (len(texts[y]) + 1) // 2
        learn, rest[y] = texts[y][:half], texts[y][half:] or texts[y]
        pieces = [data[i : i + TRAINED_BYTES] for data in learn for i in range(0, len(data), TRAINED_BYTES)]
        try:
            dictionaries[y] = zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            trained = False
        raw[y] = b"".join(pieces)[:DICTIONARY_BYTES]
    if not trained:
        dictionaries = raw
    model = QualityModel(dictionaries[1], dictionaries[0], trained, ())
    good, bad = model.kernel()
    rows = [(difference(data, good, bad), y, max(1, counts.get(y, 1)) / len(rest[y])) for y in (0, 1) for data in rest[y]]
    found, ys, weight = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    w = _logistic(_design(found), ys, weight / weight.mean())
    return QualityModel(model.good, model.bad, trained, tuple(float(x) for x in w))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> QualityModel:
    """Learns from labels.quality of rows that aren't held out, at most per_class of each."""
    sample, counts = sample_labelled(docs, labels, "quality", per_class)
    return fit_from_sample(sample, counts)


def score(docs: DataFrame, model: QualityModel, out: str = "quality_score") -> DataFrame:
    """docs with a score from 0 to 1, higher for good text.

    A null or empty text has a difference of 0 and gets what the calibration
    gives for it.  Repeated rows are scored each, equal texts alike.
    """
    weights = np.array(model.weights)

    def kernel():
        good, bad = model.kernel()

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = np.array([difference((t or "").encode("utf-8"), good, bad) for t in part.column(part.schema.get_field_index("text")).to_pylist()])
            z = _design(found) @ weights
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return work

    return append_columns(docs.withColumn("text", F.col("text").cast("string")), kernel, [T.StructField(out, T.DoubleType(), False)])


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score and predicted."""
    scored = score(doc_text(docs), fit(docs, labels), "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
