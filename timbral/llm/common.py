"""Shared helpers of the training-data operators: written tables in the cluster's
shared folder, Arrow text buffers, and vectorised word hashing.

The word kernels work on the UTF-8 bytes of a whole Arrow batch at once, so the
cost per word is a few NumPy passes rather than a Python call.  Hashes are 64 bit.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS = 2000
#: Arrays of all tasks are merged so many at a time.
FAN = 64
#: Bits of the filters that keep most unwanted rows from being shuffled.
BITMAP_BITS = 23
#: Text is handled in pieces of about this many bytes, which bounds the temporary arrays.
CHUNK_BYTES = 1 << 20
#: Longer strings get a hash of another kind: of a polynomial modulo a power of two, equal pairs of 1,024 bytes are known.
LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which ``substring_hash`` takes the hash of any substring."""
    up, _ = _power_tables(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), of under 512 bytes each; equal for equal bytes."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def string_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings [start, end) of any length."""
    h = substring_hash(prefix_hash(data), start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, offsets by text) of the lower-cased words; no word spans two texts."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[low]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, string_hash(low, starts, ends), np.searchsorted(starts, offs)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to this one word."""
    b = _LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(string_hash(b, np.array([0]), np.array([len(b)]))[0])


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words at each start (len(h) - k + 1 of them)."""
    out = np.full(max(len(h) - k + 1, 0), k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash for a whole word sequence, as an array of one."""
    return shingle_hashes(h, len(h))


# Workers and columns ------------------------------------------------------------------------


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when its task ends, as the worker lives on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return wrapped


def _give_back() -> None:
    # not in wrapped, which is sent to the workers with the values of all globals that it names
    if _powers and len(_powers[0]) > 2 * CHUNK_BYTES:
        _powers.clear()  # they were made for a very long text
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str], of: DataFrame | None = None) -> list[F.Column]:
    """Columns by their exact names, dots and backticks included."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return [F.col(c) if of is None else of[c] for c in quoted]


def map_all(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow for tables with columns of any name, which mapInArrow itself takes for paths where they hold a dot."""
    own, names = df.columns, schema.names

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(own) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(names))])

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(own)))).mapInArrow(lean(plain), kinds).toDF(*names)


# Shared folder ------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all tasks
    run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="timbral-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/timbral/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def gather(pieces: DataFrame, tasks: int, merge: Callable, pack: Callable, unpack: Callable, last: Callable) -> np.ndarray:
    """Merge the arrays of all tasks, which come in packed pieces (piece, task, counts); the result, of the pieces as
    ``last`` takes them, has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = reduce(merge, map(unpack, table.column("counts").to_pylist()))
        return table.slice(0, 1).set_column(2, "counts", pa.array([pack(total)], pa.binary()))

    while tasks > 1:  # in levels, so that no merge gathers more than FAN pieces
        pieces = pieces.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("piece", "task").applyInArrow(add, "piece int, task bigint, counts binary")
        tasks = math.ceil(tasks / FAN)
    return np.concatenate([last(r.counts) for r in sorted(pieces.collect(), key=lambda r: r.piece)])  # a row a piece


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, as longs, with the bits of all keys (bigint) set: what it does not hold is not among
    the keys.  A full one lets everything through, so it may only come before an exact join."""
    n = 1 << (BITMAP_BITS - 6)
    key = named(keys.columns)[0]
    bit = F.expr(f"shiftleft(1L, cast(shiftright(key, {BITMAP_BITS - 6}) & 63 as int))")
    longs = keys.select(key.alias("key")).groupBy(F.col("key").bitwiseAND(F.lit(n - 1)).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # n rows at most
    out = np.zeros(n, np.int64)
    out[longs.column("at").to_numpy()] = longs.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64) a bitmap may hold."""
    return bits[keys & (len(bits) - 1)] >> (keys >> (BITMAP_BITS - 6) & 63) & 1 == 1


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star steps.

    Returns (node, root): root is the least node of the component.  Every step is a grouped
    minimum and a join, so a node with many edges is neither collected nor held in one task.
    """
    e = stash(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("m").alias("u"), "v")
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
        joined = large.join(least, F.col("v") == F.col("k"))
        small = joined.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        e = stash(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root").unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        last = now
