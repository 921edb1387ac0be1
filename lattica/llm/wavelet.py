"""Token ids as wavelet matrices: one compressed file a shard.

Each bit of the ids is a plane over the shard's tokens.  A plane holds the bit
of every token in the order that the planes before it leave: first the tokens
whose bit was 0, then those whose bit was 1.  A directory has the ones before
every RANK_BITS bits, so rank counts the bits of one such run and select
searches the directory: the token at a position, how often an id occurs, where
it occurs, all from the file alone.  Blocks are compressed each by itself, so
an answer opens one block of each plane.

The file, all integers little-endian: MAGIC; then version, planes, tokens,
documents, tokens of the same range of documents before this file, bytes of
the documents' part, 0 (seven 64-bit integers); the documents' part,
compressed: ids, flags of null ids and token counts; for each plane the zeros
in it (64 bits), the bytes of each block (32 bits) and the ones before each run
of RANK_BITS (32 bits); then the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, doc_text, map_batches, partitions_for, same_spans, shared_path, slices, span_hashes, text_buffer, word_spans

MAGIC = b"WVLTMX02"
#: Bits of a plane that are compressed together, bits that the directory has one entry for, and tokens from which a shard's file is closed.
BLOCK_BITS, RANK_BITS, SHARD_TOKENS = 1 << 17, 1 << 9, 1 << 21
LEVEL = 1
END_ID = 2
#: Pieces whose ids a task remembers; and what the vocabulary writes at the end of a pre-token.
REMEMBERED, WORD_END = 1 << 20, "</w>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_file(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], before: int = 0, planes: int = 16) -> bytes:
    """The file of one shard: ids of all its documents in order, each document's id and its number of tokens."""
    import zstandard

    if len(ids) >> 32:
        raise ValueError("a file holds less than 2 ** 32 tokens")
    comp = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    docs = comp.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(counts, "<i8").tobytes())
    heads, bodies = [], []
    order = np.ascontiguousarray(ids)
    for k in range(planes - 1, -1, -1):
        bit = ((order >> order.dtype.type(k)) & order.dtype.type(1)).astype(bool)
        packed = np.packbits(bit)
        ones = _run_ones(packed)
        data = [comp.compress(packed[i : i + BLOCK_BITS // 8].tobytes()) for i in range(0, len(packed), BLOCK_BITS // 8)]
        heads.append(struct.pack("<q", len(bit) - int(ones.sum())) + np.array([len(d) for d in data], "<u4").tobytes() + (np.cumsum(ones) - ones).astype("<u4").tobytes())
        bodies += data
        order = np.concatenate([order[~bit], order[bit]])
    return b"".join([MAGIC, struct.pack("<7q", 2, planes, len(ids), len(doc_ids), before, len(docs), 0), docs, *heads, *bodies])


def _run_ones(packed: np.ndarray) -> np.ndarray:
    """The ones in each run of RANK_BITS bits."""
    counts = np.zeros(-(-len(packed) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.int64)
    counts[: len(packed)] = np.bitwise_count(packed)
    return counts.reshape(-1, RANK_BITS // 8).sum(axis=1)


class WaveletFile:
    """Rank and select over one shard's file."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        self._open = zstandard.ZstdDecompressor().decompress
        _, self.planes, self.n, n_docs, self.before, docs_len, _ = struct.unpack_from("<7q", data, 8)
        at = 8 + 56
        docs = self._open(data[at : at + docs_len])
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs)
        self.null_ids = np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        at += docs_len
        n_blocks, n_runs = -(-self.n // BLOCK_BITS), -(-self.n // RANK_BITS)
        self.zeros, self.ones, sizes = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<q", data, at)[0])
            sizes.append(np.frombuffer(data, "<u4", n_blocks, at + 8))
            self.ones.append(np.frombuffer(data, "<u4", n_runs, at + 8 + 4 * n_blocks))
            at += 8 + 4 * n_blocks + 4 * n_runs
        self._data, self._at = data, []
        for s in sizes:
            ends = at + np.cumsum(s, dtype=np.int64)
            self._at.append(list(zip((ends - s).tolist(), ends.tolist(), strict=True)))
            at = int(ends[-1]) if len(ends) else at
        self._block = lru_cache(maxsize=64)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        """The packed bits of a block."""
        a, b = self._at[plane][block]
        return np.frombuffer(self._open(self._data[a:b]), np.uint8)

    def _run(self, plane: int, at: int) -> np.ndarray:
        """The bits of the run of the directory that a position is in."""
        block, rest = divmod(at, BLOCK_BITS)
        first = rest // RANK_BITS * (RANK_BITS // 8)
        return np.unpackbits(self._block(plane, block)[first : first + RANK_BITS // 8])

    def _bit(self, plane: int, at: int) -> int:
        return int(self._run(plane, at)[at % RANK_BITS])

    def _rank1(self, plane: int, at: int) -> int:
        """Ones before a position of a plane."""
        if at >= self.n:
            return self.n - self.zeros[plane]
        before, rest = int(self.ones[plane][at // RANK_BITS]), at % RANK_BITS
        return before + (int(self._run(plane, at)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th such bit of a plane, from 0."""
        ones = self.ones[plane]
        low, high = 0, len(ones)
        while high - low > 1:
            mid = (low + high) // 2
            before = int(ones[mid]) if bit else mid * RANK_BITS - int(ones[mid])
            low, high = (mid, high) if before <= k else (low, mid)
        at = low * RANK_BITS
        before = int(ones[low]) if bit else at - int(ones[low])
        return at + int(np.flatnonzero(self._run(plane, at) == bit)[k - before])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, at), self._rank1(p, at)
            out = out << 1 | bit
            at = self.zeros[p] + ones if bit else at - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before a position stand behind the last plane."""
        if token >> self.planes:
            return 0, 0
        a, b = 0, end
        for p in range(self.planes):
            x, y = self._rank1(p, a), self._rank1(p, b)
            if token >> (self.planes - 1 - p) & 1:
                a, b = self.zeros[p] + x, self.zeros[p] + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id, before a position if one is given."""
        a, b = self._range(token, self.n if end is None else max(0, min(end, self.n)))
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of an id, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            at = self._select(p, 1, at - self.zeros[p]) if bit else self._select(p, 0, at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: from the last plane to the first, each puts its tokens back where they stood before it."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            packed = np.concatenate([self._read_block(p, b) for b in range(len(self._at[p]))]) if self.n else np.zeros(0, np.uint8)
            bit = np.unpackbits(packed, count=self.n).astype(bool)
            back = np.empty(self.n, kind)
            back[~bit] = out[: self.zeros[p]]
            back[bit] = out[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            out = back
        return out


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its class (white space, letter, digit, other), and whether its word must be encoded whole."""
    kind = np.full(256, OTHER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[[c for c in range(128) if chr(c).isalpha()]] = LETTER
    kind[128:] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    whole = np.zeros(256, bool)
    whole[[c for c in (*range(0x20), 0x27, 0x7F) if kind[c] != SPACE]] = True
    whole[0xC0:] = True
    whole[[0xC3, 0xC4, 0xC5]] = False
    return kind, whole


SPACE, LETTER, DIGIT, OTHER = range(4)
_KIND, _WHOLE = _byte_classes()
#: Of the two-byte Latin letters these are none, or have no one small letter.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def pre_tokens(buf: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of the pieces of all texts: runs of letters, single digits, runs of other characters.

    Pieces are pre-tokens of the tokenizer where a word has only ASCII
    characters and Latin letters, no apostrophe, which may join letters, and
    none of the added tokens.  Any other word, up to white space, is one piece
    of class SPACE.
    """
    kind = _KIND[buf]
    new = np.empty(len(buf), bool)
    new[:1] = True
    new[1:] = kind[1:] != kind[:-1]
    new |= kind == DIGIT
    new[offsets[:-1][offsets[:-1] < len(buf)]] = True
    slow = _WHOLE[buf]
    for lead, last in _NO_LETTERS:
        slow[:-1] |= (buf[:-1] == lead) & (buf[1:] == last)
    data = buf.tobytes() if added else b""
    for token in added:
        at = data.find(token)
        while at >= 0:
            slow[at] = True
            at = data.find(token, at + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buf))
    kinds = kind[starts]
    full = kinds != SPACE
    starts, ends, kinds = starts[full], ends[full], kinds[full]
    if slow.any():
        first, last, _ = word_spans(buf, offsets)
        seen = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(slow, out=seen[1:])
        odd = seen[last] > seen[first]
        first, last = first[odd], last[odd]
        at = np.searchsorted(first, starts, side="right") - 1
        kept = (at < 0) | (starts >= last[np.maximum(at, 0)]) if len(first) else np.ones(len(starts), bool)
        starts, ends, kinds = np.concatenate([starts[kept], first]), np.concatenate([ends[kept], last]), np.concatenate([kinds[kept], np.full(len(first), SPACE, np.uint8)])
        order = np.argsort(starts, kind="stable")
        starts, ends, kinds = starts[order], ends[order], kinds[order]
    return starts, ends, kinds


def _folded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z, but as they are in words that are one piece."""
    out = FOLD[buf]
    whole = kinds == SPACE
    if whole.any():
        depth = np.zeros(len(buf) + 1, np.int8)
        depth[starts[whole]] += 1
        depth[ends[whole]] -= 1
        inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
        out[inside] = buf[inside]
    return out


def _same_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece a number that pieces of the same bytes share, and the first piece of each number.

    Pieces meet by hash, and their bytes are compared; if hashes deceive, the
    bytes themselves are what they meet by.
    """
    import pandas as pd

    codes, first = _numbered(pd.factorize(span_hashes(buf, starts, ends))[0])
    length = ends - starts
    if np.array_equal(length, length[first][codes]) and same_spans(buf, starts, starts[first][codes], length):
        return codes, first
    data = buf.tobytes()
    return _numbered(pd.factorize(np.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))[0])


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.empty(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each different piece once and not each occurrence.

    No token crosses white space or the border of a piece, and capitals count
    as small letters.  Pieces are known again by all their bytes.  New runs of
    letters are encoded many in one text, and told apart by the ids that end a
    word; other new pieces one by one.  The library's added tokens, such as
    special ones, count wherever a text has them, as they do in the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if hasattr(self._tokenizer.model, "_resize_cache"):
            self._tokenizer.model._resize_cache(0)  # each piece is asked for once
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.planes = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2") if self.planes <= 16 else np.dtype("<u4")
        self._ends = np.zeros(size, bool)
        self._ends[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        added = self._tokenizer.get_added_tokens_decoder().values()
        # Added tokens of other kinds may reach over white space or into words.
        if any(t.lstrip or t.rstrip or t.normalized or t.single_word or not t.content or any(c.isspace() for c in t.content) for t in added):
            raise ValueError("the vocabulary has added tokens that depend on what is around them")
        self._added = tuple(t.content.encode("utf-8") for t in added)
        self._forget()

    def _forget(self) -> None:
        """What a piece stands for: its number; and by number the place and count of its ids in the pool."""
        self._number: dict[bytes, int] = {}
        self._place, self._count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self._pool, self._used = np.zeros(1 << 18, self.kind), 0

    def _learn(self, pieces: list[bytes], lists: list[np.ndarray]) -> None:
        n, m = len(self._number), len(pieces)
        counts = np.array([len(x) for x in lists], np.int64)
        total = int(counts.sum())
        while n + m > len(self._place):
            self._place, self._count = np.concatenate([self._place, self._place]), np.concatenate([self._count, self._count])
        while self._used + total > len(self._pool):
            self._pool = np.concatenate([self._pool, self._pool])
        if m:
            self._pool[self._used : self._used + total] = np.concatenate(lists)
            self._place[n : n + m] = self._used + np.cumsum(counts) - counts
            self._count[n : n + m] = counts
            self._used += total
            self._number.update(zip(pieces, range(n, n + m), strict=True))

    def _letters(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            e = self._tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0]
            ids = np.array(e.ids, self.kind)
            stops = np.flatnonzero(self._ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a run of letters is not one pre-token")
            a = 0
            for b in stops.tolist():
                out.append(ids[a:b])
                a = b
        return out

    def _others(self, pieces: list[bytes]) -> list[np.ndarray]:
        encoded = self._tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in encoded]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        starts, ends, kinds = pre_tokens(buf, offsets, self._added)
        shown = _folded(buf, starts, ends, kinds)
        codes, first = _same_pieces(shown, starts, ends)
        if len(self._number) + len(first) > REMEMBERED:
            self._forget()
        data = shown.tobytes()
        pieces = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        numbers = np.array([self._number.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(numbers < 0)
        letters = kinds[first[new]] == LETTER
        for some, encode in ((letters, self._letters), (~letters, self._others)):
            where = new[some]
            own = [pieces[k] for k in where.tolist()]
            numbers[where] = np.arange(len(self._number), len(self._number) + len(where))
            self._learn(own, encode(own))
        number = numbers[codes]
        counts = self._count[number]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        ids = self._pool[np.repeat(self._place[number] - (stops - counts), counts) + np.arange(total)]
        upto = np.append(0, stops)[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker process, with what it remembers."""
    return WordEncoder(path)


_FILES = T.StructType([T.StructField(*x) for x in (("range_key", T.LongType()), ("first_doc", T.LongType()), ("n_tokens", T.LongType()), ("n_docs", T.LongType()), ("file", T.BinaryType()))])


def encode_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The files of all shards, a row each, documents in ascending doc_id, null ids first.

    range_key numbers the ranges of documents that tasks encode, in order; the
    tokens of that range before a file are in its header.  Rows of one id, and
    those without, are in order of a hash of their texts, so many of them are
    several ranges.  A null text is an end id alone.
    """
    path = path or tokenizer_path()
    lowest = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        enc = word_encoder(path)
        parts: list[np.ndarray] = []
        ids: list[int | None] = []
        counts: list[int] = []
        own_range, before, held = TaskContext.get().partitionId(), 0, 0

        def close() -> pa.RecordBatch:
            nonlocal before, held
            data = write_file(np.concatenate(parts), ids, counts, before, enc.planes)
            row = [[own_range], [lowest if ids[0] is None else ids[0]], [held], [len(ids)], [data]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_FILES.names)
            before, held = before + held, 0
            for x in (parts, ids, counts):
                x.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                encoded, sizes = enc.encode(*text_buffer(part.column(1)))
                # The end id of each document goes behind its ids.
                stops = np.cumsum(sizes)
                parts.append(np.insert(encoded, stops, enc.kind.type(end_id)))
                own = part.column(0).to_pylist()
                ids += own
                counts += (sizes + 1).tolist()
                held += len(encoded) + len(own)
                if held >= SHARD_TOKENS:
                    yield close()
        if ids:
            yield close()

    rows = doc_text(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions_for(docs.sparkSession), *order).sortWithinPartitions(*order)
    return map_batches(ordered, run, _FILES)


_DOCS = T.StructType([T.StructField(*x) for x in (("range_key", T.LongType()), ("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))])


def read_documents(files: DataFrame) -> DataFrame:
    """(range_key, doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; start counts within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, key in enumerate(keys):
                file = WaveletFile(batch.column(1)[k].as_py())
                data = memoryview(file.ids().astype("<u4").tobytes())
                ends = np.cumsum(file.counts)
                starts = ends - file.counts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(crc), key, np.int64)), pa.array(file.doc_ids, pa.int64(), mask=file.null_ids),
                    pa.array(starts + file.before, pa.int64()), pa.array(file.counts, pa.int64()), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_DOCS.names)

    return map_batches(files.select("range_key", "file"), run, _DOCS)


def op6(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's rows: writes the files to the shared folder and reads them back.

    The ranges' token totals, a row for each partition, give each range its
    start; they are the only thing that is gathered.
    """
    spark = docs.sparkSession
    at = shared_path(spark, "wavelet")
    encode_shards(docs, path).write.option("compression", "none").parquet(at)
    files = spark.read.schema(_FILES).parquet(at)
    totals = sorted((r["range_key"], r["n"]) for r in files.groupBy("range_key").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for key, n in totals:
        starts.append((key, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "range_key long, offset long"))
    return read_documents(files).join(offsets, "range_key").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
