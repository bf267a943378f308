"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id, place in the input).  A size-weighted sample of keys
gives quantile boundaries that cut this order into many ranges; exact bytes are then counted for every
range, ranges that turn out overfull are cut again by a sample of their own, and the rows of a range
get their byte position from a running sum inside it.  Shard k of n takes the positions from k/n to
(k + 1)/n of all bytes (law ``bytes``), so sizes differ by about one group of equal texts at most.

Equal texts follow each other and stay in one shard while they are small (``WHOLE`` of a shard's bytes);
a group that is larger is cut by doc_id, and its ranges too, so no group is ever one task's.

The size of a row is the UTF-8 length of its text plus one; null text has length 0 and counts as an
empty text.  Null doc_ids sort first.  Repeated rows are told apart by their place in the input.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, read, stash

SHARDS = 8
#: Keys sampled for the boundaries, about; they go to the driver.
SAMPLE = 20_000
#: Ranges: this many, or one for every RANGE_BYTES if that is more.
RANGES = 512
RANGE_BYTES = 4 << 30
#: A range of more than this many times the mean is cut again, until none is left or none can be cut.
OVERFULL = 2.0
#: Equal texts stay together up to this share of a shard.
WHOLE = 0.01

_LEAST = -(1 << 63)
_KEY = ("g", "id", "row")


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.monotonically_increasing_id().alias("row"))


def _sample(rows: DataFrame, want: float, bytes_: int) -> list[tuple[int, int, int]]:
    """Sorted keys, each drawn with a chance in proportion to the row's size."""
    share = F.col("size") * F.lit(want / max(bytes_, 1))
    dice = F.shiftrightunsigned(F.xxhash64(F.lit(7), *_KEY), 11) / F.lit(float(1 << 53))
    return sorted(tuple(r) for r in rows.filter(dice < share).select(*_KEY).collect())


def _quantiles(keys: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    """Up to parts - 1 boundaries; one that is alone in its group of equal texts moves to the group's start."""
    picked = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    groups = [k[0] for k in picked]
    return sorted({k if i and groups[i - 1] == k[0] else (k[0], _LEAST, _LEAST) for i, k in enumerate(picked)})


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """Adds column r, the number of boundaries not above the row's key."""
    shared = rows.sparkSession.sparkContext.broadcast(_edges(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            key = np.empty(batch.num_rows, cuts.dtype)
            for c in _KEY:
                key[c] = batch.column(c).to_numpy()
            yield batch.append_column("r", pa.array(np.searchsorted(cuts, key, "right").astype(np.int64)))

    return rows.mapInArrow(lean(run), rows.select("*", F.lit(0).cast("long").alias("r")).schema)


def _edges(keys: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array(keys, dtype=[(c, np.int64) for c in _KEY])


def _bytes(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> dict[int, int]:
    """Exact bytes of every range that has rows."""
    return {r.r: r.b for r in _ranged(rows, cuts).groupBy("r").agg(F.sum("size").alias("b")).collect()}


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = documents.sparkSession
    rows = stash(_rows(documents), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(RANGES, math.ceil(total / RANGE_BYTES))
    cuts = _quantiles(_sample(rows, max(SAMPLE, 40 * ranges), total), ranges)
    bytes_of = _bytes(rows, cuts)
    while True:
        full = {r: b for r, b in bytes_of.items() if b > OVERFULL * total / ranges}
        inside = _ranged(rows, cuts).join(F.broadcast(spark.createDataFrame([(r,) for r in full], "r bigint")), "r")
        again = _sample(inside, 40 * sum(math.ceil(b * ranges / total) for b in full.values()), sum(full.values())) if full else []
        if not again:
            break
        place = np.searchsorted(_edges(cuts), _edges(again), "right")  # ascends, as the keys do
        at = {r: np.searchsorted(place, [r, r + 1]).tolist() for r in full}
        new = [k for r, b in full.items() for k in _quantiles(again[slice(*at[r])], math.ceil(b * ranges / total))]
        if {*new} <= {*cuts}:
            break  # nothing left to cut: single rows
        cuts = sorted({*cuts, *new})
        bytes_of = _bytes(rows, cuts)
    offset = list(zip(range(len(cuts) + 1), np.cumsum([0, *(bytes_of.get(r, 0) for r in range(len(cuts)))]).tolist(), strict=True))
    begins = F.broadcast(spark.createDataFrame(offset, "r bigint, begins bigint"))  # a row for each range
    by_key = Window.partitionBy("r").orderBy(*_KEY)
    group = Window.partitionBy("r", "g")
    placed = _ranged(rows, cuts).join(begins, "r").withColumn("at", F.col("begins") + F.sum("size").over(by_key) - F.col("size")).withColumn("n", F.row_number().over(by_key))
    small = F.sum("size").over(group) <= F.lit(WHOLE * total / shards)
    place = F.when(small, F.min("at").over(group)).otherwise(F.col("at"))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(place * F.lit(shards) / F.lit(max(total, 1)))).cast("int"))
    placed = stash(placed.select("doc_id", "size", "text_crc32", "r", "n", "shard"), "placed")
    counts = sorted((r.shard, r.r, r.c, r.n) for r in placed.groupBy("shard", "r").agg(F.count("*").alias("c"), F.min("n").alias("n")).collect())
    base, slots = {}, []
    for s, r, c, n in counts:
        slots.append((s, r, base.get(s, 0) - n))
        base[s] = base.get(s, 0) + c
    start = F.broadcast(spark.createDataFrame(slots, "shard int, r bigint, start bigint"))  # a row for each range and cut
    return placed.join(start, ["shard", "r"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n")).alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents to ``path``/shard=k, ordered by slot inside each of many files.

    doc_id must be a key of the table here."""
    where = shard(documents, shards).select("doc_id", "shard", "slot")
    documents.drop("shard", "slot").join(where, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
