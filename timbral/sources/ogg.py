"""Ogg: pages of a file, packets of pages (relational), and pages of packets."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checksums import crc
from .files import table

CONTINUED, FIRST, LAST = 1, 2, 4
#: Page of a packet that goes on: no granule position.
NO_GRANULE = -1
#: A page is closed once it holds this much.
PAGE_BYTES = 4096

PAGE_DDL = "page_no bigint, header_type int, granule bigint, serial bigint, sequence bigint, segments array<int>, payload binary, skipped bigint"


def page(header_type: int, granule: int, serial: int, sequence: int, segments: list[int], payload: bytes) -> bytes:
    if len(segments) > 255 or sum(segments) != len(payload):
        raise ValueError("segments do not match the payload")
    head = b"OggS" + struct.pack("<BBqIII", 0, header_type, granule, serial, sequence, 0) + bytes([len(segments), *segments])
    image = head + payload
    return image[:22] + struct.pack("<I", crc(image, 32)) + image[26:]


def pages(content: bytes) -> Iterator[dict]:
    """Pages whose checksum holds; anything else is passed over a byte at a time and counted in ``skipped``."""
    at = number = skipped = 0
    while (found := content.find(b"OggS", at)) >= 0:
        skipped += found - at
        at = found
        head = content[at : at + 27]
        end = at + 27 + head[26] if len(head) == 27 and head[4] == 0 else len(content) + 1
        segments = content[at + 27 : end]
        end += sum(segments)
        if end <= len(content):
            image = content[at : at + 22] + bytes(4) + content[at + 26 : end]
            header_type, granule, serial, sequence, check = struct.unpack_from("<BqIII", content, at + 5)
            if crc(image, 32) == check:
                yield {"page_no": number, "header_type": header_type, "granule": None if granule == NO_GRANULE else granule, "serial": serial, "sequence": sequence, "segments": list(segments), "payload": content[at + 27 + len(segments) : end], "skipped": skipped}
                at, number = end, number + 1
                continue
        at, skipped = at + 1, skipped + 1


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, pages, PAGE_DDL)


def lacing(size: int) -> list[int]:
    return [255] * (size // 255) + [size % 255]


def packets(pages: DataFrame) -> DataFrame:
    """path, serial, chain, packet_no, data, granule, first_page, last_page, hole_before from a table of pages.

    A first-page flag after a last one starts a new chain.  Where a sequence number is missing, the packet before
    stays open and the fragment after has no start: both are dropped, and the next whole packet has hole_before.
    Everything is keyed by (path, serial), in order of the page number."""
    by = Window.partitionBy("path", "serial").orderBy("page_no")
    p = pages.filter("error is null" if "error" in pages.columns else "true")
    p = p.withColumn("chain", F.sum(F.col("header_type").bitwiseAND(FIRST) / FIRST).over(by).cast("int"))
    chained = Window.partitionBy("path", "serial", "chain").orderBy("page_no")
    p = p.withColumn("gap", F.coalesce(F.col("sequence") != F.lag("sequence").over(chained) + 1, F.lit(False)))
    p = p.withColumn("stretch", F.sum(F.col("gap").cast("int")).over(chained))
    p = p.withColumn("fragment", (F.col("header_type").bitwiseAND(CONTINUED) > 0) & (F.row_number().over(Window.partitionBy("path", "serial", "chain", "stretch").orderBy("page_no")) == 1))
    # the last segment under 255 of a page ends the packet that its granule position belongs to
    p = p.withColumn("ends_at", F.array_max(F.transform(F.col("segments"), lambda s, i: F.when(s < 255, i).otherwise(-1))))
    s = p.select("path", "serial", "chain", "stretch", "page_no", "header_type", "granule", "fragment", "ends_at", "payload", "segments", F.posexplode("segments").alias("pos", "size"))
    start = F.aggregate(F.slice("segments", 1, F.col("pos")), F.lit(0), lambda n, x: n + x)
    s = s.withColumn("part", F.substring(F.col("payload"), start + 1, F.col("size"))).drop("payload", "segments")
    segments = Window.partitionBy("path", "serial", "chain", "stretch").orderBy("page_no", "pos")
    s = s.withColumn("packet", F.coalesce(F.sum((F.col("size") < 255).cast("int")).over(segments.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = s.groupBy("path", "serial", "chain", "stretch", "packet").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "pos", "part"))).alias("parts"), F.max((F.col("size") < 255)).alias("whole"), F.max(F.col("fragment") & (F.col("packet") == 0)).alias("broken"),
        F.max(F.when((F.col("pos") == F.col("ends_at")) & (F.col("size") < 255), F.col("granule"))).alias("granule"), F.max(F.col("header_type").bitwiseAND(FIRST) > 0).alias("first_page"), F.max(F.when(F.col("size") < 255, F.col("header_type").bitwiseAND(LAST) > 0)).alias("last_page"),
    )
    g = g.filter("whole and not broken")
    order = Window.partitionBy("path", "serial", "chain").orderBy("stretch", "packet")
    hole = F.col("stretch") > F.coalesce(F.lag("stretch").over(order), F.lit(0))
    data = F.aggregate(F.transform("parts", lambda x: x["part"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return g.select("path", "serial", "chain", (F.row_number().over(order) - 1).cast("long").alias("packet_no"), data.alias("data"), "granule", "first_page", "last_page", hole.alias("hole_before"))


def mux(items: Iterable[tuple[bytes, int]], serial: int) -> bytes:
    """A logical stream of (packet, granule position).  A page takes no further packet once it holds PAGE_BYTES or
    255 segments; the page that ends the last packet is the last, and an empty stream is one page."""
    done: list[tuple[int, int, list[int], bytes]] = []
    segments, payload, granule, open_before = [], b"", NO_GRANULE, False

    def close(goes_on: bool) -> None:
        nonlocal segments, payload, granule, open_before
        done.append((CONTINUED if open_before else 0, NO_GRANULE if goes_on else granule, segments, payload))
        segments, payload, granule, open_before = [], b"", NO_GRANULE, goes_on

    for data, at in items:
        if len(payload) >= PAGE_BYTES or len(segments) == 255:
            close(False)
        left, sizes = data, lacing(len(data))
        while sizes:
            room = 255 - len(segments)
            now, sizes = sizes[:room], sizes[room:]
            segments += now
            payload, left = payload + left[: sum(now)], left[sum(now) :]
            if not sizes:
                granule = at
            else:
                close(True)
    if segments or not done:
        close(False)
    out = b""
    for i, (flags, at, s, body) in enumerate(done):
        flags |= (FIRST if i == 0 else 0) | (LAST if i == len(done) - 1 else 0)
        out += page(flags, at, serial, i, s, body)
    return out


def write(packets: DataFrame) -> DataFrame:
    """(path, serial, content): each logical stream of rows (path, serial, packet_no, data, granule) as a file's bytes."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("packet_no")
        items = [(bytes(d), NO_GRANULE if pd.isna(g) else int(g)) for d, g in zip(group.data, group.granule, strict=True)]
        return pd.DataFrame({"path": [group.path.iloc[0]], "serial": [group.serial.iloc[0]], "content": [mux(items, int(group.serial.iloc[0]))]})

    return packets.select("path", "serial", "packet_no", "data", "granule").groupBy("path", "serial").applyInPandas(run, "path string, serial bigint, content binary")
