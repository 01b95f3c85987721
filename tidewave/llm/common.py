"""Shared helpers of the training-data operators: durable tables, Arrow text buffers, vectorised words and hashes.

Texts reach Python as Arrow buffers and stay one flat byte array with offsets, so that one numpy call works on
hundreds of documents. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: The white space that ends a word: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Span hashes are polynomials modulo this prime (2 ** 31 - 1): arithmetic modulo a power of two has texts that agree for any base.
PRIME = (1 << 31) - 1
#: Bytes that one table of powers covers (longer buffers use it block by block), and how many numpy works on at once, in cache.
BLOCK, CHUNK = 1 << 20, 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir). Only a session on one machine may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"{tempfile.gettempdir()}/tidewave-checkpoints"
    return folder.rstrip("/")


#: Spark's setting by which a query removes its shuffle files when it ends, and not when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors. tidy: the shuffle files behind it go
    as soon as it is written; nothing reads them again, as the table stands in for them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._cut_path = path
    return again


def discard(df: DataFrame) -> None:
    """Remove the table that cut() wrote for df; nothing that is still to run may read it."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Columns of documents that operators look at; they go under their own names, all others under numbers (see any_columns).
NAMED = ("doc_id", "text", "lang", "n_chars")


def any_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function from documents to documents that callers may give columns of any name: those that aren't NAMED have names inside that
    no helper column has, and come back under their own."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        inside = {c: c if c in NAMED else f"column {n}" for n, c in enumerate(docs.columns)}
        out = stage(docs.select(*(F.col(quoted(c)).alias(name) for c, name in inside.items())), *args, **options)
        return out.select(*(F.col(quoted(name)).alias(c) for c, name in inside.items()))

    return run


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names (and __tie, see with_tie); a null text becomes an empty one."""
    tie = ["__tie"] if "__tie" in df.columns else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *tie)


def with_tie(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with the column __tie, and whether any is not 0. Rows of one doc_id and one text have the same pair (doc_id, __tie),
    others have different ones: it is a hash of the text where a doc_id stands in several rows, or is null, and 0 elsewhere."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    several = docs.groupBy(F.col("doc_id").cast("long").alias("__several")).agg(F.count("*").alias("__many")).where("__many > 1 OR __several IS NULL")
    several = cut(several, "repeated-ids")
    if several.isEmpty():
        return docs.withColumn("__tie", F.lit(0).cast("long")), False
    joined = docs.join(several, F.col("doc_id").cast("long").eqNullSafe(F.col("__several")), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.when(F.col("__many").isNotNull(), text).otherwise(F.lit(0).cast("long")).alias("__tie")), True


def exact_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from 1 on for each span: equal spans have equal numbers, and different ones different numbers."""
    size = end - start
    key = short_keys(raw, start, end)
    long = np.flatnonzero(size > 7)
    if len(long):
        key[long] = Spans(raw, byte_table(51), 0x5851F42D4C957F2D)(start[long], end[long]) | np.uint64(1 << 63)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    back = back.reshape(-1)
    model = first[back[long]]
    same = size[model] == size[long]
    same[same] = same_bytes(raw, start[long[same]], raw, start[model[same]], size[long[same]])
    out = back + 1
    others: dict[bytes, int] = {}
    for at in long[~same].tolist():  # one hash, other bytes
        out[at] = others.setdefault(raw[start[at] : end[at]].tobytes(), len(first) + 1 + len(others))
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of documents of about `size` bytes together."""
    for batch in batches:
        raw, offs = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + size, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start), raw[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
            start = end


#: Cached functions whose values are large, of the modules that a worker has loaded.
LARGE: list = []


def large(cached: Callable) -> Callable:
    """A cached function whose values lean tasks let go of."""
    LARGE.append(cached)
    return cached


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns freed memory to the machine, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return what Arrow and numpy keep for later arrays to the machine: the next stage's workers are the same processes."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def let_go() -> None:
    """Drop the tables that tasks of other operators left in this worker; they are built again where they are needed."""
    held = [f for f in LARGE if f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that begins without other operators' tables, and gives back its memory when it ends. Workers wait for their next
    task beside the JVM's shuffles and sorts, with all they still hold."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from run(batches)
        finally:  # all that run held is gone with its frame
            give_back()

    return task


#: Rows that passed_on gives at once.
PASSED_ON = 1 << 16


def passed_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces: the JVM holds a piece as a whole."""
    for k in range(0, batch.num_rows, PASSED_ON):
        yield batch.slice(k, PASSED_ON)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """Two random numbers under PRIME for each byte value; lower: A to Z count as a to z."""
    with np.errstate(over="ignore"):
        table = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).reshape(2, 256) % np.uint64(PRIME)
    if lower:
        table[:, 65:91] = table[:, 97:123]
    return table


def fold(x: np.ndarray, times: int = 1) -> np.ndarray:
    """Make x smaller, in place, without changing its remainder modulo PRIME: three times, and it is PRIME at most."""
    for _ in range(times):
        high = x >> np.uint64(31)
        x &= np.uint64(PRIME)
        x += high
    return x


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place."""
    fold(x, 3)
    x[x == PRIME] = 0
    return x


@functools.cache
def powers(base: int) -> np.ndarray:
    """base ** i modulo PRIME for i < BLOCK."""
    row = np.ones(BLOCK, np.uint64)
    filled = 1
    while filled < BLOCK:
        take = min(filled, BLOCK - filled)
        row[filled : filled + take] = row[:take] * np.uint64(pow(base, filled, PRIME)) % np.uint64(PRIME)
        filled += take
    return row.astype(np.uint32)


class Spans:
    """Hashes of any byte spans of one buffer, in constant time each, from prefix sums of two polynomials modulo a prime. Two
    different spans of n bytes agree with a chance of at most (n / PRIME) ** 2."""

    def __init__(self, raw: np.ndarray, table: np.ndarray, base: int):
        self.bases = [mix(np.array([base + k], np.uint64))[0] % np.uint64(PRIME - 2) + np.uint64(2) for k in (0, 1)]
        self.sums = np.zeros((2, len(raw) + 1), np.uint64)
        for sums, values, b in zip(self.sums, table, map(int, self.bases), strict=True):
            up = powers(b)
            for at in range(0, len(raw), CHUNK):
                part = raw[at : at + CHUNK]
                value = values[part]
                value *= up[at % BLOCK : at % BLOCK + len(part)]
                if at >= BLOCK:
                    value = reduce(value) * np.uint64(pow(b, at // BLOCK * BLOCK, PRIME))
                fold(value)[0] += sums[at]
                np.cumsum(value, out=sums[at + 1 : at + 1 + len(part)])

    def _lane(self, k: int, start: np.ndarray | slice, total: np.ndarray) -> np.ndarray:
        """Sums of spans, moved to the front of the buffer."""
        inverse = pow(int(self.bases[k]), -1, PRIME)
        down = powers(inverse)
        fold(total, 2)
        if self.sums.shape[1] <= BLOCK:
            total *= down[start]
            return reduce(total)
        if isinstance(start, slice):
            start = np.arange(start.start, start.stop)
        blocks = np.array([pow(inverse, at, PRIME) for at in range(0, self.sums.shape[1], BLOCK)], np.uint64)
        total *= down[start % BLOCK]
        return reduce(reduce(total) * blocks[start // BLOCK])

    @staticmethod
    def _joined(one: np.ndarray, two: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        return mix((one << np.uint64(31) | two) ^ np.multiply(size, np.uint64(0x9E3779B97F4A7C15)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), CHUNK):
            a, b = start[at : at + CHUNK], end[at : at + CHUNK]
            out[at : at + CHUNK] = self._joined(*(self._lane(k, a, s[b] - s[a]) for k, s in enumerate(self.sums)), (b - a).astype(np.uint64))
        return out

    def sliding(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size."""
        out = np.empty(max(0, self.sums.shape[1] - size), np.uint64)
        for at in range(0, len(out), CHUNK):
            to = min(at + CHUNK, len(out))
            out[at:to] = self._joined(*(self._lane(k, slice(at, to), s[at + size : to + size] - s[at:to]) for k, s in enumerate(self.sums)), np.uint64(size))
        return out


def short_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans of up to seven bytes as numbers: their bytes, and their length in the highest byte."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    size = (end - start).astype(np.uint64)
    word = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[start]
    return word & ((np.uint64(1) << np.uint64(8) * size) - np.uint64(1)) | size << np.uint64(56)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_start : a_start + size] equals b[b_start : b_start + size], for each row."""
    full = np.flatnonzero(size)
    out = np.ones(len(size), bool)
    if len(full):
        size = size[full]
        equal = a[ragged(a_start[full], size)] == b[ragged(b_start[full], size)]
        out[full] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return out


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's first word (n + 1)."""
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(SPACE[raw], out=inside[:-1])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    return start, end, np.searchsorted(start, offs)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the documents' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, for all i after one another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    out += np.repeat(starts - at, lengths)
    return out
