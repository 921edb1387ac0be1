"""Shared helpers: Arrow text kernels, bounded slices, range order, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes that are neither a space nor 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 2 << 20
ROWS_A_BATCH = 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U64 = np.uint64
#: A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] = FOLD[ord("a") : ord("z") + 1]
#: Bytes of a span that are hashed in blocks of eight for all spans at once; longer spans are hashed one by one.
SHORT = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U64)
_ODD = (_U64(0x9E3779B97F4A7C15), _U64(0xD1342543DE82EF95))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of each row, and the row that it is in."""
    space = _SPACE[buf]
    first, last = ~space, ~space
    if len(buf):
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        full = offsets[:-1] < offsets[1:]
        heads = offsets[:-1][full]
        tails = offsets[1:][full] - 1
        first[heads] = ~space[heads]
        last[tails] = ~space[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of a buffer on, as one integer; zeros stand behind its end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span; with fold, A-Z count as a-z.

    Each block of eight bytes goes through the finaliser with what came before
    it, so unlike in a polynomial no pattern of repetitions cancels out.
    """
    import xxhash

    buf = FOLD[buf] if fold else buf
    blocks, length = _blocks(buf), ends - starts
    out = mix64(length.astype(_U64) * _ODD[0] ^ blocks[starts] & _MASK[np.minimum(length, 8)])
    live = np.flatnonzero((length > 8) & (length <= SHORT))
    for k in range(8, SHORT, 8):
        live = live[length[live] > k]
        if not len(live):
            break
        out[live] = mix64(out[live] ^ (blocks[starts[live] + k] & _MASK[np.minimum(length[live] - k, 8)]))
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]])
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, others: np.ndarray, length: np.ndarray) -> bool:
    """Whether each span has the bytes of the other span of its length."""
    blocks = _blocks(buf)
    if ((blocks[starts] ^ blocks[others]) & _MASK[np.minimum(length, 8)]).any():
        return False
    live = np.flatnonzero((length > 8) & (starts != others))
    for k in range(8, SHORT, 8):
        live = live[length[live] > k]
        if not len(live):
            return True
        mask = _MASK[np.minimum(length[live] - k, 8)]
        if ((blocks[starts[live] + k] ^ blocks[others[live] + k]) & mask).any():
            return False
    return all(np.array_equal(buf[starts[i] : starts[i] + length[i]], buf[others[i] : others[i] + length[i]]) for i in live[length[live] > SHORT].tolist())


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `size` words within one row, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    out = np.full(len(inside), size, dtype=_U64)
    for k in range(size):
        out = (out ^ words[inside + k]) * _ODD[1]
        out ^= out >> _U64(29)
    return mix64(out), inside


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have `limit` bytes together, or one row with a longer text."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator that, at its end, gives memory that it doesn't use any more back to the machine: worker processes live on."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: unless the session says otherwise, ROWS_A_BATCH of them go to Python at once, not Spark's 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS_A_BATCH))


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in small batches, with memory given back at the end of each task."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names, whatever their case."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names, whatever their case, under others, and what gives any rows of it the columns of df again."""
    taken, known = {x.lower() for x in names}, {c.lower() for c in df.columns}
    own = []
    for c in df.columns:
        other, k = c, 0
        while other.lower() in taken:
            k += 1
            other = f"__{k}_{c}"
            if other.lower() in known:
                other = c
        known.add(other.lower())
        own.append(other)
    return df.toDF(*own), lambda out: out.select(*[F.col(f"`{x}`").alias(c) for x, c in zip(own, df.columns, strict=True)])


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append_columns(df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], text: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """df with the columns that kernel()(slice) makes; columns of the same names are replaced.

    kernel is called once a task, on the executor, and may set up what it needs.
    """
    if text.lower() in {f.name.lower() for f in fields}:
        raise ValueError("the text column can't be replaced")
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, text, limit):
                work = work or kernel()
                made = work(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *[f.name for f in fields]])

    return map_batches(base, run, schema)


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table of documents, as long and string."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % 5 == 0


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir of the session; only where none is set, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df from a reliable checkpoint: its lineage ends in files that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
