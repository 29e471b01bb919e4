"""Shared pieces: vectorised tokenising of Arrow text, hashing, checkpoints, folds.

Text kernels work on the UTF-8 buffer of an Arrow column and never on one Python
object per word.  A batch is cut into slices of about `SLICE_BYTES`, so that the
temporary arrays stay bounded; one text longer than that makes one slice.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: A word is a run of characters other than these (the contract's `[^\x20\x09-\x0D]+`).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Words of 64 bits that a sieve broadcasts at most.
SIEVE_WORDS = 1 << 18

_U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def give_back() -> None:
    """Hands freed memory back to the machine.

    Spark's workers outlive their tasks, and would otherwise keep it beside stages that need no Python.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    """256 odd-looking 64-bit values, one per byte; with `lower`, A-Z share those of a-z."""
    values = mix64(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95) + _U64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES = byte_values(False)
VALUES_LOWER = byte_values(True)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i modulo 2**64 for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            factors = [np.full(m, k, _U64) for k in (_MULT, _MULT_INV)]
            for f in factors:
                f[0] = 1
            _powers[:] = [np.cumprod(f, dtype=_U64) for f in factors]
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows that hold `limit` bytes at most, or one row."""
    data, offsets = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def boundaries(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True, none of which crosses a row."""
    n = len(flag)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | first[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, _U64)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, _U64)
        total[0] = 0
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (n+1 values)."""
    starts, ends = boundaries(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; 0 for empty segments."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def remainder(column: str, modulus: int) -> Column:
    """crc32(id as text) mod `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint directory, which all executors share.

    Only where the session names none and runs on one machine a temporary folder becomes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage: written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def forget(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for `frames`; nothing may still be computed from them."""
    for df in frames:
        if path := getattr(df, "_folder", None):
            remove_folder(df.sparkSession, path)


def split_join(left: DataFrame, right: DataFrame, key: str, spread: str, shares: int = 1000) -> DataFrame:
    """left inner join right on `key`, frequent keys of `left` in parts.

    A key with more than 1/shares of all rows of `left` is cut into parts of about that size by a
    hash of column `spread`, and its rows of `right` are repeated for each part.  There are fewer
    than `shares` such keys, so the table of them is broadcast, and at most 2 * shares parts.
    """
    counts = stored(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("__n") * shares > max(total, 100 * shares)).select(F.col(key).alias("__key"), F.ceil(F.col("__n") * shares / F.lit(max(total, 1))).cast("int").alias("__parts"))
    hot = F.broadcast(stored(hot))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__parts")))
    one = left.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", part.cast("int")).drop("__key", "__parts")
    all_parts = F.when(F.col("__parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    other = right.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", F.explode(all_parts)).drop("__key", "__parts")
    return one.join(other, [key, "__part"]).drop("__part")


def sieve(rows: DataFrame, by: Column, found: DataFrame, among: Column, words: int = SIEVE_WORDS) -> DataFrame:
    """The rows whose hash `by` may be among the hashes `among` of `found`, without moving them.

    What is broadcast is a table of bits, one for each remainder of a hash, of a size that doesn't
    grow with `found`.  No row is lost; of the others as many stay as the share of bits that are set.
    """
    word = lambda h: F.pmod(h, F.lit(words))
    bit = lambda h: F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    bits = found.select(word(among).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(among)).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumn("__hash", by).withColumn("__word", word(F.col("__hash")))
    return marked.join(F.broadcast(bits), "__word").filter(F.getbit("__bits", bit(F.col("__hash"))) == 1).select(*rows.columns)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def summed_blocks(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """Adds up binary float64 vectors: (slot int, part int, data binary) to one row a slot.

    Two levels, so that no task reads more than the square root of all partial vectors at once;
    vectors of one slot have one length.  `part` must be a function of the vector, so that reruns agree.
    """
    schema = "slot int, part int, data binary"

    def add(key, table):
        total = None
        for x in sorted(table.column("data").to_pylist()):  # sums of doubles depend on the order
            v = np.frombuffer(x, np.float64)
            total = v.copy() if total is None else np.add(total, v, out=total)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    some = rows.select("slot", (F.abs(F.col("part")) % fan_in).cast("int").alias("part"), "data")
    return some.groupBy("slot", "part").applyInArrow(add, schema).groupBy("slot").applyInArrow(add, schema)
