"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks at fixed places, each of which reaches into the
next.  A chunk is a row of its own: it is pre-tokenised and its pre-tokens are
encoded in whatever task it is in.  Then the chunks of a text meet in their
order.  Pre-tokenising goes from left to right and knows nothing but where it
stands, so once two neighbours have a boundary in common they go on alike: in
each overlap such a boundary is the stitch, and the ids up to it come from one
chunk, those behind it from the other.  Decoding puts the bytes of the ids
together.

Short texts are one chunk.  A text whose chunks have no boundary in common, or
with characters that this Python's tables don't know, is encoded whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, doc_text, map_batches, partitions_for, without

#: Code points of a chunk, and by how many it reaches into the next.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Where a boundary may be a stitch: pre-tokens that must agree on both sides of it.
AGREE = 3


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


#: Pre-tokens whose ids a task remembers.
REMEMBERED = 1 << 18


class Pieces:
    """Pre-tokens of chunks and their ids."""

    def __init__(self, enc):
        self._encode, self._known = enc._encode_single_piece, {}

    def of(self, chunk: str) -> tuple[list[int], list[int], list[int]]:
        """Where each pre-token begins, how many ids it has, and all ids."""
        starts, counts, ids = [], [], []
        for m in _pattern().finditer(chunk):
            piece = m.group()
            own = self._known.get(piece)
            if own is None:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                own = self._known[piece] = self._encode(piece)
            starts.append(m.start())
            counts.append(len(own))
            ids += own
        return starts, counts, ids


def known_to_tables(text: str) -> bool:
    """Whether every character is assigned in this Python's Unicode tables: of others the two pattern libraries may think differently."""
    return all(unicodedata.category(c) != "Cn" for c in set(text))


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text, each but the last with the beginning of the next."""
    return [text[a : a + chunk + overlap] for a in range(0, max(1, len(text) - overlap), chunk)]


def stitch(own: list[int], other: list[int], head: str, overlap: int) -> int | None:
    """Where two chunks are stitched, counted from the second one's beginning.

    own and other are the boundaries of both from there on, head the text.  A
    boundary counts if both chunks have it and the AGREE after it, away from
    the end of the first, where missing text could move them, and if it stands
    between two characters that aren't white space, or before the one space
    that leads a word.
    """
    both = sorted(x for x in set(own) & set(other) if 0 < x < overlap)
    at_own, at_other = ({x: k for k, x in enumerate(xs)} for xs in (own, other))
    for x in both[:-AGREE]:
        firm = not head[x - 1].isspace() and (not head[x].isspace() or head[x] == " " and not head[x + 1 : x + 2].isspace())
        i, j = at_own[x], at_other[x]
        if firm and own[i : i + AGREE + 1] == other[j : j + AGREE + 1]:
            return x
    return None


def stitched(parts: list[tuple[list[int], list[int], np.ndarray]], heads: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray | None:
    """The ids of a text from (starts, counts, ids) of its chunks in order; None if two of them can't be stitched.

    heads are the beginnings of the chunks, a little longer than the overlap.
    """
    out, begin = [], 0
    for k, (starts, counts, ids) in enumerate(parts):
        end = None
        if k + 1 < len(parts):
            own = [x - chunk for x in starts[bisect.bisect_left(starts, chunk) :]]
            end = stitch(own, parts[k + 1][0], heads[k + 1], overlap)
            if end is None:
                return None
        first = bisect.bisect_left(starts, begin)
        last = len(starts) if end is None else bisect.bisect_left(starts, chunk + end)
        before = int(np.sum(counts[:first]))
        out.append(ids[before : before + int(np.sum(counts[first:last]))])
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def encode(text: str, enc, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of one text, chunk after chunk: what encode_documents does with many tasks."""
    chunks = chunks_of(text, chunk, overlap)
    if len(chunks) > 1 and known_to_tables(text):
        pieces = Pieces(enc)
        parts = [(s, c, np.array(i, np.int32)) for s, c, i in map(pieces.of, chunks)]
        ids = stitched(parts, [c[: overlap + 2] for c in chunks], chunk, overlap)
        if ids is not None:
            return ids.tolist()
    return enc.encode_ordinary(text)


def decode(ids: list[int], enc) -> bytes:
    """The raw bytes of the ids, put together."""
    return b"".join(enc.decode_bytes(ids[i : i + 65536]) for i in range(0, len(ids), 65536))


_FIELDS = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), True), True), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]


def _digests(lists: list[np.ndarray], enc, names: list[str], with_ids: bool) -> list[pa.Array]:
    """The columns of _FIELDS, without the ids if they aren't asked for."""
    counts = [len(ids) for ids in lists]
    ids_sha = [hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest() for ids in lists]
    bytes_sha = [hashlib.sha256(decode(ids, enc)).hexdigest() for ids in lists]
    made = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
    if not with_ids:
        return made
    ends = pa.array(np.cumsum([0, *counts]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32))), *made]


def _names(enc) -> list[str]:
    return [str(i) for i in range(max(enc._mergeable_ranks.values()) + 1)]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with token_ids, n_tokens, ids_sha256 and decoded_sha256.

    A null text counts as empty: no ids, and the digests of nothing.  Repeated
    rows are encoded each; columns of docs with these names are replaced.  The
    chunks of long texts are dealt over all tasks.
    """
    path = path or ranks_path()
    fields = _FIELDS if with_ids else _FIELDS[1:]
    docs = without(docs.withColumn("text", F.col("text").cast("string")), [f.name for f in _FIELDS] if with_ids else [f.name for f in fields])
    long = F.char_length(F.coalesce("text", F.lit(""))) > chunk + overlap

    def kernel():
        enc = encoder(path)
        names = _names(enc)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            return _digests([enc.encode_ordinary(t or "") for t in texts], enc, names, with_ids)

        return work

    return append_columns(docs.where(~long), kernel, fields).unionByName(_encode_long(docs.where(long), path, with_ids, fields, chunk, overlap))


def _encode_long(docs: DataFrame, path: str, with_ids: bool, fields: list[T.StructField], chunk: int, overlap: int) -> DataFrame:
    """encode_documents for texts of several chunks."""
    others = [c for c in docs.columns if c.lower() != "text"]
    text = next(c for c in docs.columns if c.lower() == "text")
    # The other columns of a row travel with its first chunk.
    rest = F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in others])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), F.col(f"`{text}`").alias("text"))
    rest_field = T.StructField("rest", rows.schema["rest"].dataType, True)
    cut_schema = T.StructType([T.StructField("row", T.LongType()), rest_field, T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])
    more = [T.StructField("head", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())]
    piece_schema = T.StructType([*cut_schema.fields, *more])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(2).to_pylist()):
                chunks, n = chunks_of(t, chunk, overlap), len(chunks_of(t, chunk, overlap))
                at = pa.array([i, *[None] * (n - 1)], pa.int32())
                row = pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([row, batch.column(1).take(at), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(chunks, pa.string())], names=cut_schema.names)

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(encoder(path))
        for batch in batches:
            found = [pieces.of(t) if known_to_tables(t) else (None, None, None) for t in batch.column(4).to_pylist()]
            heads = [t[: overlap + 2] for t in batch.column(4).to_pylist()]
            ids = [None if i is None else np.array(i, "<i4").tobytes() for _, _, i in found]
            made = [pa.array(heads, pa.string()), pa.array([s for s, _, _ in found], pa.list_(pa.int32())), pa.array([c for _, c, _ in found], pa.list_(pa.int32())), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=piece_schema.names)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = _names(enc)
        held: list[dict] = []
        kept = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("k", "n", "text", "head", "starts", "counts", "ids")}
                if own["k"] == 0:
                    kept = batch.column(1).slice(i, 1)
                held.append(own)
                if own["k"] + 1 < own["n"]:
                    continue
                whole = "".join([*(h["text"][:chunk] for h in held[:-1]), own["text"]])
                ids = None
                if all(h["ids"] is not None for h in held):
                    ids = stitched([(h["starts"], h["counts"], np.frombuffer(h["ids"], "<i4")) for h in held], [h["head"] for h in held], chunk, overlap)
                ids = enc.encode_ordinary(whole) if ids is None else ids.tolist()
                held = []
                yield pa.RecordBatch.from_arrays([kept, pa.array([whole], pa.string()), *_digests([ids], enc, names, with_ids)], names=["rest", text, *[f.name for f in fields]])

    tasks = partitions_for(docs.sparkSession)
    chunks = map_batches(rows, cut_up, cut_schema).repartition(tasks, "row", "k")
    encoded = map_batches(chunks, pre_tokenise, piece_schema).repartition(tasks, "row").sortWithinPartitions("row", "k")
    out = map_batches(encoded, put_together, T.StructType([rest_field, T.StructField(text, T.StringType()), *fields]))
    return out.select(*[F.col(f"`{text}`") if c == text else F.col(f"rest.`{c}`") for c in docs.columns], *[f.name for f in fields])


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's rows: n_tokens and the two digests of each document."""
    return encode_documents(doc_text(docs), path, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
