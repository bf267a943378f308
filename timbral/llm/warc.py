"""Content-addressed WARC archive.

``write`` makes two tables in one folder: ``payloads`` holds each payload's bytes once under its
SHA-256, ``headers`` holds the exact header block of every record with the digest of its payload.
``records`` joins the two, checks every payload against its digest, and gives back the records.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page_id is
a response and the others are revisits of it; smaller payloads are always responses, but still stored
once.  A null payload is empty.  Rows that repeat page_id and payload are the same record written
twice, so both are responses if that page_id is the smallest.  A null page_id is never smallest: such
rows revisit a row that has an id, and are all responses where no equal payload has one.  A null url
leaves out the target line.  Extra columns are ignored.

A payload is shuffled after equal ones of a task have been merged, so one that a third of all rows
share costs a row a task; joins on the digest can be split by AQE, as nothing is grouped above them.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_path, read

MIN_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes of every row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def _header(date: str) -> F.Column:
    """The exact header block of a record, from page_id, url, digest, payload_bytes, record_type and refers_to."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">\r\n"))
    revisit = F.col("record_type") == "revisit"
    # a line break in a url would end its header line
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"WARC-Date: {date}\r\n"), F.coalesce(target, F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(f"WARC-Profile: {_PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"), F.lit("\r\n\r\n"),
    )


def write(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write the archive of a ``pages`` table (page_id, url, html) to a shared folder."""
    rows = _records(pages)
    rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    again = (F.col("payload_bytes") >= MIN_REVISIT) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = rows.select("page_id", "url", "digest", "payload_bytes").join(first, "digest")
    told = told.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))
    told.select("page_id", "digest", _header(date).cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload (in full, also of revisits), parsed from an archive; fails on a payload that its digest disproves."""
    joined = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads").select("digest", "payload"), "digest", "left")
    right = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload is missing or differs from its digest"))
    return joined.select("page_id", "header", F.when(right.isNull(), F.col("payload")).alias("payload"))


def _field(name: str) -> F.Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def export(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write the records as .warc.gz files, one gzip member a record, one file a partition, to any folder that
    pyarrow opens; returns (file, records).  A task that runs again replaces its own file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
            for batch in batches:
                for head, payload in zip(batch.column("header").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    f.write(gzip.compress(head + (b"" if b"\r\nWARC-Type: revisit\r\n" in head.split(b"\r\n\r\n")[0] + b"\r\n" else payload) + b"\r\n\r\n", 6))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return records(spark, path).select("header", "payload").mapInArrow(lean(run), "file string, records bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    rows = records(spark, path)
    return rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), _field("WARC-Type").alias("record_type"), F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"))


SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages), q as (select page_id, octet_length(b) as n, sha256(b) as d from p),
f as (select *, min(page_id) over (partition by d) as first_id from q)
select page_id, n as payload_bytes, d as payload_digest, case when n >= {MIN_REVISIT} and page_id <> first_id then 'revisit' else 'response' end as record_type,
case when n >= {MIN_REVISIT} and page_id <> first_id then first_id end as refers_to from f
"""
