"""Queries that send the tables' rows through a format's writer and reader.  What comes back must be what SQL says
of the rows that went in, so the oracle of each is plain SQL on the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import opus, rangecoder, tags
from ..sources import flac, ogg, wav
from .catalogue import views
from .dialect import Duck

_SIG = "select user_id as stream, cast(round(value * 100) as bigint) as x, event_id from events"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(_SIG.replace("from events", "from {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _by_stream(kernel) -> callable:
    """A query that gives each stream's samples, in order, to a kernel and returns (stream, i, x)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            x = kernel(group.sort_values("event_id").x.to_numpy())
            return pd.DataFrame({"stream": group.stream.iloc[0], "i": np.arange(len(x)), "x": x})

        return _signals(spark, sf_dir).groupBy("stream").applyInPandas(run, "stream bigint, i bigint, x bigint")

    return query


def _flac(x: np.ndarray) -> np.ndarray:
    return flac.decode(flac.encode(x[None] - 25000, 44100, 24, 256))[1][0] + 25000


def _flac_in_ogg(x: np.ndarray) -> np.ndarray:
    content = flac.encode(np.stack([x - 25000, x // 2]), 44100, 24, 256)
    meta, at = flac.metadata(content)
    packets = [(b"\x7fFLAC\x01\x00\x00\x00fLaC\x80\x00\x00\x22" + meta.info.encode(), 0)]
    while at < len(content):
        end = flac.decode_frame(content, at, meta.info)[2]
        packets.append((content[at:end], len(packets)))
        at = end
    return flac.decode(ogg.mux(packets, 1))[1][0] + 25000


def _wav(x: np.ndarray) -> np.ndarray:
    form, data, _ = wav.parse(wav.encode(wav.Format(44100, 1, 24), x[None]))
    return wav.samples(form, data)[0].astype(np.int64)


def _range(x: np.ndarray) -> np.ndarray:
    coder = rangecoder.Encoder()
    for v in x.tolist():
        coder.uniform(v, 1 << 20)
    decoder = rangecoder.Decoder(coder.bytes())
    return np.array([decoder.uniform(1 << 20) for _ in x])


def ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as packets of streams of 64, written to pages and put together again by window functions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.lit("-").alias("path"), F.floor(F.col("doc_id") / 64).cast("long").alias("serial"), F.col("doc_id").alias("packet_no"), F.col("text").cast("binary").alias("data"), F.col("doc_id").alias("granule"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = pa.Table.from_pylist([{"path": "-", **p} for p in ogg.pages(content)])
                out = out.set_column(out.schema.get_field_index("segments"), "segments", out.column("segments").cast(pa.list_(pa.int32())))
                yield from out.set_column(out.schema.get_field_index("header_type"), "header_type", out.column("header_type").cast(pa.int32())).to_batches()

    table = ogg.write(rows).select("content").mapInArrow(pages, f"path string, {ogg.PAGE_DDL}")
    return ogg.packets(table).select("serial", "packet_no", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("md5"), "hole_before")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and language of each document as comments of a header."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [tags.encode("v", [f"LANG={a}", f"Source={b}"]) for a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    from ..functions.pcm import tags_first

    parsed = docs.mapInArrow(run, "doc_id bigint, data binary").select("doc_id", tags.parse_column(F.col("data")).alias("t"))
    return parsed.select("doc_id", tags_first(F.col("t.comments"), "SOURCE").alias("source"), tags_first(F.col("t.comments"), "lang").alias("lang"), F.size("t.comments").cast("long").alias("n"))


def opus_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of two frames of different size made of each event's type, taken apart again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").cast("binary").alias("b"))
    toc = F.unhex(F.lpad(F.hex((F.col("event_id") % 32) * 8 + 2), 2, "0"))
    length = F.unhex(F.lpad(F.hex(F.octet_length("b")), 2, "0"))
    p = e.select("event_id", opus.parse_column(F.concat(toc, length, F.col("b"), F.col("b"), F.lit(b"!"))).alias("p"))
    return p.select("event_id", F.col("p.config").cast("long").alias("config"), F.col("p.duration_ns").alias("duration_ns"), F.octet_length(F.col("p.frames")[0]).cast("long").alias("first"), F.octet_length(F.col("p.frames")[1]).cast("long").alias("second"))


_SAME = views(Duck) + "select stream, i, x from sig"

QUERIES = {"flac_roundtrip": _by_stream(_flac), "flac_in_ogg_roundtrip": _by_stream(_flac_in_ogg), "wav_roundtrip": _by_stream(_wav), "range_coder_roundtrip": _by_stream(_range), "ogg_packets": ogg_packets, "comment_header": comments, "opus_frames": opus_frames}

SQL = {
    **dict.fromkeys(("flac_roundtrip", "flac_in_ogg_roundtrip", "wav_roundtrip", "range_coder_roundtrip"), _SAME),
    "ogg_packets": "select doc_id // 64 as serial, row_number() over (partition by doc_id // 64 order by doc_id) - 1 as packet_no, cast(octet_length(encode(text)) as bigint) as size, md5(text) as md5, false as hole_before from documents",
    "comment_header": "select doc_id, source, lang, cast(2 as bigint) as n from documents",
    "opus_frames": """select event_id, event_id % 32 as config, cast(case when event_id % 32 < 12 then [10000000, 20000000, 40000000, 60000000][event_id % 4 + 1]
    when event_id % 32 < 16 then [10000000, 20000000][event_id % 2 + 1] else [2500000, 5000000, 10000000, 20000000][event_id % 4 + 1] end as bigint) as duration_ns,
    cast(length(event_type) as bigint) as first, cast(length(event_type) + 1 as bigint) as second from events""",
}
