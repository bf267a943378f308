"""Queries whose oracle is SQL of another making: the engine's functions on one side, and on the other what must come
out, worked out by a closed form, a recursion or the input itself."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import celt, rangecoder, silk
from ..operators import codebook
from ..sources import ogg
from .catalogue import BLOCK, views
from .dialect import Duck

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_V = views(Duck)


def _query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, i, x: the view sig."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return e.select(F.col("user_id").alias("stream"), i.alias("i"), F.round(F.col("value") * 100).cast("long").alias("x"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, block, xs: the samples of each block of at most BLOCK, in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return _samples(spark, sf_dir).groupBy("stream", F.floor(F.col("i") / BLOCK).cast("long").alias("block")).agg(own.alias("xs"))


def _each(blocks: DataFrame, kernel: Callable[[np.ndarray], list], kind: str) -> DataFrame:
    """stream, block, p and the values v that a kernel makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [list(kernel(np.array(xs, np.int64))) for xs in batch.column("xs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block"), pa.array(out, pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["stream", "block", "vs"])

    made = blocks.mapInArrow(run, f"stream bigint, block bigint, vs array<{kind}>")
    return made.select("stream", "block", F.posexplode("vs").alias("p", "v")).withColumn("p", F.col("p").cast("long"))


# Gains ---------------------------------------------------------------------------------------

#: Fixed values of the format: levels, least and greatest step, and the scale from a level to a logarithm in 1/128.
_LEVELS, _LEAST, _MOST, _OFFSET, _SLOPE, _TOP = 64, -4, 36, 2 * 128 // 6 + 16 * 128, 65536 * ((88 - 2) * 128 // 6) // 63, 3967


def _next_level(before: Column, index: Column, first: Column) -> Column:
    """A level from the one before: an absolute index may fall by 16 at most, a step above a bound counts double."""
    step, bound = index + _LEAST, before + (2 * _MOST - _LEVELS)
    moved = F.when(first, F.greatest(index, before - 16)).otherwise(before + F.when(step > bound, 2 * step - bound).otherwise(step))
    return F.least(F.greatest(moved, F.lit(0)), F.lit(_LEVELS - 1)).cast("long")


def _linear(level: Column) -> Column:
    """The gain of a level: 2^(its logarithm), the fraction by a parabola in whole numbers."""
    low = _SLOPE & 0xFFFF
    log = F.least(F.shiftright(level * low, 16) + level * (_SLOPE >> 16) + _OFFSET, F.lit(_TOP)).cast("long")
    part = log.bitwiseAND(F.lit(127))
    bend = part + F.shiftright(part * (128 - part) * -174, 16)
    one = F.pow(F.lit(2.0), F.shiftright(log, 7)).cast("long")
    near = F.when(log < 2048, one + F.shiftright(one * bend, 7)).otherwise(one + F.shiftright(one, 7) * bend)
    return F.when(log >= _TOP, F.lit((1 << 31) - 1).cast("long")).otherwise(near)


@_query(
    _V + f""", steps as (select stream, block, p, case when p = 0 then x % 64 else x % 41 end as x from blk),
    levels as (with recursive l as (select stream, block, p, least(63, greatest(0, greatest(x, -16))) as level from steps where p = 0
    union all select s.stream, s.block, s.p, least(63, greatest(0, l.level + case when s.x - 4 > 8 + l.level then 2 * (s.x - 4) - (8 + l.level) else s.x - 4 end)) from l join steps s on s.stream = l.stream and s.block = l.block and s.p = l.p + 1) select * from l),
    logs as (select *, least(3967, (level * 1907825 >> 16) + 2090) as q from levels), parts as (select *, q & 127 as f, cast(pow(2, q >> 7) as bigint) as one from logs)
    select stream, block, p, cast(level as bigint) as level, case when q >= 3967 then 2147483647 when q < 2048 then one + (one * (f + (f * (128 - f) * -174 >> 16)) >> 7) else one + (one >> 7) * (f + (f * (128 - f) * -174 >> 16)) end as gain from parts"""
)
def gain_dequant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain levels and gains of each block: its first sample gives an absolute index, the others steps."""
    found = F.aggregate(F.sequence(F.lit(1), F.size("xs")), F.array().cast("array<bigint>"), lambda done, k: F.array_append(done, _next_level(F.coalesce(F.get(done, k - 2), F.lit(0)), F.when(k == 1, F.get("xs", k - 1) % 64).otherwise(F.get("xs", k - 1) % 41), k == 1)))
    rows = _blocks(spark, sf_dir).select("stream", "block", F.posexplode(found).alias("p", "level"))
    return rows.select("stream", "block", F.col("p").cast("long").alias("p"), "level", _linear(F.col("level")).cast("long").alias("gain"))


# FLAC ----------------------------------------------------------------------------------------

_SUMS = "list_sum(list_transform(range(1, len({0}) + 1), lambda k: abs({0}[k] - case when k = 1 then 0 else {0}[k - 1] end)))"


@_query(
    _V + f""", pairs as (select stream, i // {BLOCK} as block, list(l order by i) as l, list(r order by i) as r from stereo group by all),
    four as (select stream, block, l, r, list_transform(range(1, len(l) + 1), lambda k: (l[k] + r[k]) >> 1) as m, list_transform(range(1, len(l) + 1), lambda k: l[k] - r[k]) as s, cast(len(l) as double) as n from pairs),
    cost as (select stream, block, {", ".join(f"n * greatest(0, log2(1 + {_SUMS.format(c)} / n))" + (" + n" if c == "s" else "") + f" as {c}" for c in "lrms")} from four)
    select stream, block, case when l + r <= least(l + s, s + r, m + s) then 'left_right' when l + s <= least(s + r, m + s) then 'left_side' when s + r <= m + s then 'side_right' else 'mid_side' end as mode from cost"""
)
def stereo_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each block of a pair of streams is coded: estimated bits from the first differences, of which the first is
    from zero; the side costs one more bit a sample.  The first of the least wins."""
    x = _samples(spark, sf_dir)
    left = x.filter("stream % 2 = 0").select((F.col("stream") / 2).cast("long").alias("stream"), "i", F.col("x").alias("l"))
    right = x.filter("stream % 2 = 1").select(((F.col("stream") - 1) / 2).cast("long").alias("stream"), "i", F.col("x").alias("r"))
    both = left.join(right, ["stream", "i"]).withColumn("block", F.floor(F.col("i") / BLOCK).cast("long")).withColumns({"m": F.shiftright(F.col("l") + F.col("r"), 1), "s": F.col("l") - F.col("r")})
    along = Window.partitionBy("stream", "block").orderBy("i")
    both = both.select("stream", "block", *(F.abs(F.col(c) - F.lag(c, 1, 0).over(along)).alias(c) for c in "lrms"))
    n = F.count("*").cast("double")
    cost = both.groupBy("stream", "block").agg(*((n * F.greatest(F.lit(0.0), F.log2(1 + F.sum(c) / n)) + (n if c == "s" else 0.0)).alias(c) for c in "lrms"))
    sums = [("left_right", F.col("l") + F.col("r")), ("left_side", F.col("l") + F.col("s")), ("side_right", F.col("s") + F.col("r")), ("mid_side", F.col("m") + F.col("s"))]
    least = F.array_min(F.array(*(F.struct(c.alias("cost"), F.lit(k).alias("k")) for k, (_, c) in enumerate(sums))))["k"]
    return cost.select("stream", "block", F.element_at(F.array(*(F.lit(name) for name, _ in sums)), least + 1).alias("mode"))


@_query(
    _V + """select distinct n, p, case when least(p, n - 1 - p) < floor((n - 1) / 4.0) then round(pow(sin(pi() * least(p, n - 1 - p) / (0.5 * (n - 1))), 2), 6) + 0.0 else 1.0 end as w from blk"""
)
def tukey_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapered cosine of half the block, on a whole number of samples on each side, for each length of block."""
    at = F.least(F.col("p"), F.col("n") - 1 - F.col("p"))
    edge = F.floor(F.lit(0.5) * (F.col("n") - 1) / 2)
    rise = 0.5 * (1 - F.cos(2 * math.pi * at / (0.5 * (F.col("n") - 1))))
    sizes = _blocks(spark, sf_dir).select(F.size("xs").cast("long").alias("n")).distinct()
    return sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("p")).select("n", "p", (F.round(F.when(at < edge, rise).otherwise(1.0), 6) + 0.0).alias("w"))


@_query(
    _V + """, words as (select stream, i, (x - 25000 + 65536) % 65536 as w from sig)
    select stream, md5(unhex(string_agg(printf('%02x%02x', w & 255, w >> 8), '' order by i))) as md5 from words group by stream"""
)
def stream_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of each stream's samples as 16-bit words, low byte first.  The digest of a stream is sequential, so the two
    bytes of each of its samples meet in one row."""
    w = F.pmod(F.col("x") - 25000, F.lit(65536))
    hexed = F.lpad(F.hex(w.bitwiseAND(F.lit(255)) * 256 + F.shiftright(w, 8)), 4, "0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", hexed.alias("b")))), lambda s: s["b"])
    return _samples(spark, sf_dir).groupBy("stream").agg(F.md5(F.unhex(F.array_join(parts, ""))).alias("md5"))


# Transforms ----------------------------------------------------------------------------------


def _pair(e: str, k: str) -> str:
    return f"round((cast({e}[{k}] as double) {{0}} cast({e}[{k} + 1] as double)) * sqrt(0.5), 5) + 0.0"


@_query(f"select vec_id, cast(2 * k as bigint) as j, {_pair('embedding', '2 * k + 1').format('+')} as low, {_pair('embedding', '2 * k + 1').format('-')} as high from embeddings cross join unnest(range(0, 32)) t(k)")
def haar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences of neighbours, scaled to keep the energy."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct((2 * k).cast("long").alias("j"), F.get("embedding", 2 * k).cast("double").alias("a"), F.get("embedding", 2 * k + 1).cast("double").alias("b")))
    scale = math.sqrt(0.5)
    return e.select("vec_id", F.inline(pairs)).select("vec_id", "j", (F.round((F.col("a") + F.col("b")) * scale, 5) + 0.0).alias("low"), (F.round((F.col("a") - F.col("b")) * scale, 5) + 0.0).alias("high"))


@_query("select vec_id, cast(j as bigint) as j, round(cast(embedding[j + 1] as double), 4) + 0.0 as y from embeddings cross join unnest(range(16, 48)) t(j)")
def mdct_tdac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed blocks of 32 that start every 16 components, to 16 coefficients and back: where two overlap, their
    aliasing cancels and the input comes back."""
    from ..operators import mdct

    n, window = 16, mdct.power_window(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            out = np.zeros_like(x)
            for at in range(0, x.shape[1] - n, n):
                out[:, at : at + 2 * n] += mdct.inverse(mdct.forward(x[:, at : at + 2 * n] * window)) * window
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((np.round(out[:, n : 3 * n], 4) + 0.0).tolist(), pa.list_(pa.float64()))], ["vec_id", "ys"])

    made = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, ys array<double>")
    return made.select("vec_id", F.posexplode("ys").alias("j", "y")).select("vec_id", (F.col("j") + 16).cast("long").alias("j"), "y")


@_query(
    _V + f"""select a.stream, a.block, a.p, round(sum((b.x - 25000) * pow(0.85000610, a.p - b.p)) / 32768, 5) + 0.0 as y
    from blk a join blk b on a.stream = b.stream and a.block = b.block and b.p <= a.p group by all"""
)
def deemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The de-emphasis filter over each block, from rest; the oracle is its impulse response."""
    rows = _each(_blocks(spark, sf_dir), lambda x: celt.deemphasis(x - 25000)[0].tolist(), "double")
    return rows.select("stream", "block", "p", (F.round("v", 5) + 0.0).alias("y"))


# Codes ---------------------------------------------------------------------------------------


def _through(put: Callable, take: Callable) -> Callable:
    """Kernel that encodes a block's values and decodes them from the bytes."""

    def kernel(x: np.ndarray) -> list:
        coder = rangecoder.Encoder()
        for p, v in enumerate(x.tolist()):
            put(coder, p, v)
        decoder = rangecoder.Decoder(coder.bytes())
        return [take(decoder, p) for p in range(len(x))]

    return kernel


@_query(_V + "select stream, block, p, x % 25 - 12 as v from blk")
def laplace_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of -12 to 12 through the Laplace code, with another model at each place of a block."""
    model = lambda p: ((40 + 9 * p) << 7, (20 + 6 * p) << 6)
    kernel = _through(lambda c, p, v: celt.laplace_encode(c, v % 25 - 12, *model(p)), lambda c, p: celt.laplace_decode(c, *model(p)))
    return _each(_blocks(spark, sf_dir), kernel, "bigint")


@_query(
    _V + """, steps as (select stream, block, p, x % 7 - 3 as q from blk)
    select stream, block, p, round(q + (1 - 4915 / 32768.0) * coalesce(sum(q) over (partition by stream, block order by p rows between unbounded preceding and 1 preceding), 0), 4) + 0.0 as energy from steps"""
)
def coarse_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse log energies of an intra frame whose bands are the samples of a block; the oracle adds up the steps."""
    model = [(60 + 2 * i, 100 - 3 * i) for i in range(celt.BANDS)]

    def kernel(x: np.ndarray) -> list:
        coder = rangecoder.Encoder()
        for p, v in enumerate(x.tolist()):
            celt.laplace_encode(coder, v % 7 - 3, model[p][0] << 7, model[p][1] << 6)
        data = coder.bytes(64)
        found = celt.coarse_energy(rangecoder.Decoder(data), np.zeros((1, celt.BANDS)), range(len(x)), 3, True, model, 8 * len(data))
        return found[0, : len(x)].astype(float).tolist()

    return _each(_blocks(spark, sf_dir), kernel, "double").select("stream", "block", "p", (F.round("v", 4) + 0.0).alias("energy"))


@_query(_V + "select stream, block, p, x % 5 - 2 as v from blk where n >= 2")
def pvq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pyramid vectors of up to eight whole numbers, through their number and the range coder."""

    def kernel(x: np.ndarray) -> list:
        out = []
        for part in np.array_split(x % 5 - 2, -(-len(x) // 8)) if len(x) > 1 else []:
            coder = rangecoder.Encoder()
            celt.vector_encode(coder, part.tolist())
            out += celt.vector_decode(rangecoder.Decoder(coder.bytes()), len(part), int(np.abs(part).sum()))
        return out

    return _each(_blocks(spark, sf_dir), kernel, "bigint")


def _log2_up(v: Column) -> Column:
    """log2 in eighths as the format rounds it: the mantissa has 16 bits, rounded up, and is squared four times."""
    whole = F.length(F.bin(v)) - 1
    power = F.pow(F.lit(2.0), whole).cast("long")
    wide = F.pow(F.lit(2.0), F.greatest(whole - 15, F.lit(0))).cast("long")
    mantissa = F.when(whole > 15, F.ceil((v / wide))).otherwise(v * F.pow(F.lit(2.0), F.greatest(15 - whole, F.lit(0))).cast("long")).cast("long")

    def square(state: Column, left: Column) -> Column:
        over = F.when(state["m"] >= 65536, 1).otherwise(0)
        m = F.when(over == 1, F.floor((state["m"] + 1) / 2)).otherwise(state["m"])
        return F.struct((state["l"] + over * F.pow(F.lit(2.0), left)).cast("long").alias("l"), F.floor((m * m + 32767) / 32768).cast("long").alias("m"))

    end = F.aggregate(F.array(*(F.lit(k) for k in (3, 2, 1, 0))), F.struct((8 * whole).cast("long").alias("l"), mantissa.alias("m")), square, lambda s: s["l"] + F.when(s["m"] > 32768, 1).otherwise(0))
    return F.when(power == v, (8 * whole).cast("long")).otherwise(end.cast("long"))


_LOG2 = """, norm as (select *, length(bin(v)) - 1 as w from {0}),
start as (select *, case when w > 15 then (v + (1::bigint << (w - 15)) - 1) >> (w - 15) else v << (15 - w) end as m0 from (select * replace (cast(v as bigint) as v, cast(w as int) as w) from norm) q),
a as (select *, (((m0 + (m0 >> 16)) >> (m0 >> 16)) * ((m0 + (m0 >> 16)) >> (m0 >> 16)) + 32767) >> 15 as m1, 8 * w + 8 * (m0 >> 16) as l1 from start),
b as (select *, (((m1 + (m1 >> 16)) >> (m1 >> 16)) * ((m1 + (m1 >> 16)) >> (m1 >> 16)) + 32767) >> 15 as m2, l1 + 4 * (m1 >> 16) as l2 from a),
c as (select *, (((m2 + (m2 >> 16)) >> (m2 >> 16)) * ((m2 + (m2 >> 16)) >> (m2 >> 16)) + 32767) >> 15 as m3, l2 + 2 * (m2 >> 16) as l3 from b),
e as (select *, (((m3 + (m3 >> 16)) >> (m3 >> 16)) * ((m3 + (m3 >> 16)) >> (m3 >> 16)) + 32767) >> 15 as m4, l3 + (m3 >> 16) as l4 from c)
"""
_EIGHTHS = "cast(case when v = 1::bigint << w then 8 * w else l4 + case when m4 > 32768 then 1 else 0 end end as bigint)"


@_query(_V + ", u as (select distinct x as v from sig where x > 0)" + _LOG2.format("u") + f"select v as x, {_EIGHTHS} as eighths from e")
def log2_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2 of each sample in eighths, bit by bit as the format rounds it."""
    return _samples(spark, sf_dir).filter("x > 0").select("x").distinct().select("x", _log2_up(F.col("x")).alias("eighths"))


_N, _K, _FULL = 24, 40, (1 << 32) - 1


@_query(
    f"""with recursive v as (select 0 as n, [case when k = 0 then 1::hugeint else 0::hugeint end for k in range(0, {_K} + 1)] as r
    union all select n + 1, list_reduce(list_transform(range(2, {_K} + 2), lambda k: [r[k] + r[k - 1]]), lambda a, b: a || [a[len(a)] + b[1]], [1::hugeint]) from v where n < {_N}),
    u as (select n, k, least({_FULL}::hugeint, r[k + 1]) as v from v cross join unnest(range(1, {_K} + 1)) t(k) where n >= 1)"""
    + _LOG2.format("u") + f"select cast(n as bigint) as n, cast(k as bigint) as k, case when v <= 1 then 0 else {_EIGHTHS} end as eighths from e"
)
def pvq_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths of a bit of the number of a vector of n whole numbers with k as sum of magnitudes, for n to 24 and k to
    40; counts of over 32 bits are the largest of 32.  The table does not depend on the input."""
    cap = F.lit(_FULL).cast("long")

    def row(before: Column, _: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(_K))
        return F.aggregate(at, F.array(F.lit(1).cast("long")), lambda own, k: F.array_append(own, F.least(cap, F.get(own, k - 1) + F.get(before, k) + F.get(before, k - 1))))

    start = F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), _K))
    counts = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), start, row)
    table = spark.range(1, _N + 1).select(F.col("id").alias("n")).select("n", F.posexplode(counts).alias("k", "v")).filter("k > 0")
    return table.select("n", F.col("k").cast("long").alias("k"), F.when(F.col("v") <= 1, F.lit(0).cast("long")).otherwise(_log2_up(F.col("v"))).alias("eighths"))


# Pages and codebooks -------------------------------------------------------------------------


@_query()
def page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How texts, as packets of streams of 64, fill the pages of a muxer: segments and bytes of each page, whether it
    goes on from the page before, and its position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.lit("-").alias("path"), F.floor(F.col("doc_id") / 64).cast("long").alias("serial"), F.col("doc_id").alias("packet_no"), F.col("text").cast("binary").alias("data"), F.col("doc_id").alias("granule"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["serial", "sequence", "segments", "size", "continued", "granule"]
        for batch in batches:
            for content in batch.column("content").to_pylist():
                found = [(p["serial"], p["sequence"], len(p["segments"]), len(p["payload"]), bool(p["header_type"] & ogg.CONTINUED), p["granule"]) for p in ogg.pages(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "continued" else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)], names)

    return ogg.write(rows).select("content").mapInArrow(run, "serial bigint, sequence bigint, segments bigint, size bigint, continued boolean, granule bigint")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, counts: how often each of 32 entries comes up in a stream."""
    n = _samples(spark, sf_dir).groupBy("stream", (F.col("x") % 32).alias("entry")).count()
    filled = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.coalesce(F.col("m")[k.cast("long")], F.lit(0).cast("long")))
    return n.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.struct("entry", "count"))).alias("m")).select("stream", filled.alias("counts"))


def _books(spark: SparkSession, sf_dir: str, kernel: Callable[[list[int]], list[int]], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("stream"), pa.array([kernel(c) for c in batch.column("counts").to_pylist()], pa.list_(pa.int64()))], ["stream", "vs"])

    made = _counts(spark, sf_dir).mapInArrow(run, "stream bigint, vs array<bigint>")
    return made.select("stream", F.posexplode("vs").alias("entry", name)).withColumn("entry", F.col("entry").cast("long"))


@_query()
def package_merge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal code lengths of at most 8 bits for the entries of each stream."""
    return _books(spark, sf_dir, lambda c: codebook.lengths_from_counts(c, 8), "length")


@_query()
def codeword_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codeword of each entry of those codes."""
    return _books(spark, sf_dir, lambda c: codebook.codewords(codebook.lengths_from_counts(c, 8)), "word")


# Opus ----------------------------------------------------------------------------------------


@_query(_V + "select stream, block, p, x % 4000 - 2000 as v from blk")
def silk_pulses_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of -2000 to 1999 through the pulse code of the SILK layer: totals of a block, halves, low bits and
    signs, with splits of even chance."""
    shells = silk.even_shells()

    def kernel(x: np.ndarray) -> list:
        values, coder = (x % 4000 - 2000).tolist(), rangecoder.Encoder()
        silk.encode_pulses(coder, values, silk.UNVOICED, 0, shells)
        return silk.pulses(rangecoder.Decoder(coder.bytes()), silk.UNVOICED, 0, len(values), shells)

    return _each(_blocks(spark, sf_dir), kernel, "bigint")


_DRIFT = silk.DRIFT[False, 4]


@_query(
    _V + f"""select stream, block, p, cast(k as bigint) as subframe, cast(greatest(32, least(288, 32 + x % 256 + case k {" ".join(f"when {k} then {list(row)}[1 + x // 256 % 34]" for k, row in enumerate(_DRIFT))} end)) as bigint) as lag
    from blk cross join unnest(range(0, 4)) t(k)"""
)
def pitch_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of the four subframes of frames at 16 kHz whose lag index and contour come from a sample."""
    at, contour = F.pmod(F.col("x"), F.lit(256)), F.pmod(F.floor(F.col("x") / 256), F.lit(34)).cast("int")
    drift = F.array(*(F.array(*map(F.lit, row)) for row in _DRIFT))
    lags = F.transform(drift, lambda row: F.greatest(F.lit(32), F.least(F.lit(288), 32 + at + F.get(row, contour))).cast("long"))
    rows = _samples(spark, sf_dir).select("stream", F.floor(F.col("i") / BLOCK).cast("long").alias("block"), (F.col("i") % BLOCK).alias("p"), F.posexplode(lags).alias("subframe", "lag"))
    return rows.withColumn("subframe", F.col("subframe").cast("long"))


@_query(
    _V + """, edge as (select *, least(32767, greatest(0, x)) as f from blk where n >= 10 and p < 10), raw as (select stream, block, list(f order by p) as l from edge group by all having count(*) = 10),
    sorted as (select stream, block, list_sort(l) as l from raw)
    select stream, block, cast(k as bigint) as p, true as apart from sorted cross join unnest(range(0, 10)) t(k)"""
)
def stable_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of ten lines made of a block's samples keeps its distance after it was moved; the oracle is that
    all do."""
    spacing = (250, *(3,) * 9, 461)

    def kernel(x: np.ndarray) -> list:
        if len(x) < 10:
            return []
        found = silk.stabilise(np.clip(x[:10], 0, 32767).tolist(), spacing)
        gaps = np.diff([0, *found, 1 << 15]) - np.array(spacing)
        return [int(gaps[k] >= 0 and gaps[k + 1] >= 0) for k in range(10)]

    rows = _each(_blocks(spark, sf_dir), kernel, "bigint")
    return rows.select("stream", "block", "p", (F.col("v") == 1).alias("apart"))
