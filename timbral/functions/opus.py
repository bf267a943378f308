"""Opus packets and headers, without the audio inside: what a packet's first byte says, its frames and padding, and
the head and tags packets of a stream."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import tags

MOST_NS, MOST_FRAME, MOST_FRAMES = 120_000_000, 1275, 48
#: Frame durations in nanoseconds, by the low bits of the configuration.
SILK_NS = (10_000_000, 20_000_000, 40_000_000, 60_000_000)
CELT_NS = (2_500_000, 5_000_000, 10_000_000, 20_000_000)
SILK_BANDS, HYBRID_BANDS, CELT_BANDS = ("narrow", "medium", "wide"), ("superwide", "full"), ("narrow", "wide", "superwide", "full")


def configuration(config: int) -> tuple[str, str, int]:
    """(mode, bandwidth, duration in ns) of one of the 32 configurations."""
    if config < 12:
        return "silk", SILK_BANDS[config // 4], SILK_NS[config % 4]
    if config < 16:
        return "hybrid", HYBRID_BANDS[(config - 12) // 2], SILK_NS[config % 2]
    return "celt", CELT_BANDS[(config - 16) // 4], CELT_NS[config % 4]


@dataclass
class Packet:
    config: int
    mode: str
    bandwidth: str
    stereo: bool
    duration_ns: int
    frames: list[bytes]
    padding: int

    @property
    def samples(self) -> int:
        """At 48 kHz."""
        return len(self.frames) * self.duration_ns * 48 // 1_000_000


def _length(body: bytes) -> tuple[int, bytes]:
    if not body or body[0] >= 252 and len(body) < 2:
        raise ValueError("frame length is missing")
    return (body[0], body[1:]) if body[0] < 252 else (4 * body[1] + body[0], body[2:])


def _cut(body: bytes, sizes: list[int]) -> list[bytes]:
    """Frames of these sizes, and the rest as the last one."""
    out = []
    for n in sizes:
        if n > len(body):
            raise ValueError("frames are longer than the packet")
        out.append(body[:n])
        body = body[n:]
    return [*out, body]


def parse(data: bytes) -> Packet:
    if not data:
        raise ValueError("empty packet")
    mode, bandwidth, ns = configuration(data[0] >> 3)
    code, body, padding = data[0] & 3, data[1:], 0
    if code == 0:
        frames = [body]
    elif code == 1:
        if len(body) % 2:
            raise ValueError("two frames of unequal size")
        frames = _cut(body, [len(body) // 2])
    elif code == 2:
        n, body = _length(body)
        frames = _cut(body, [n])
    else:
        if not body:
            raise ValueError("frame count is missing")
        count, varied, padded = body[0] & 63, body[0] & 128, body[0] & 64
        body = body[1:]
        if not 0 < count <= MOST_FRAMES or count * ns > MOST_NS:
            raise ValueError("bad frame count")
        while padded:
            if not body:
                raise ValueError("padding length is missing")
            padding += body[0] if body[0] < 255 else 254
            padded, body = body[0] == 255, body[1:]
        if padding > len(body):
            raise ValueError("padding is longer than the packet")
        body = body[: len(body) - padding]
        if varied:
            sizes = []
            for _ in range(count - 1):
                n, body = _length(body)
                sizes.append(n)
        else:
            if len(body) % count:
                raise ValueError("frames of unequal size")
            sizes = [len(body) // count] * (count - 1)
        frames = _cut(body, sizes)
    if max(map(len, frames)) > MOST_FRAME:
        raise ValueError("frame is too long")
    return Packet(data[0] >> 3, mode, bandwidth, bool(data[0] & 4), ns, frames, padding)


PACKET = "struct<config:int,mode:string,bandwidth:string,stereo:boolean,duration_ns:bigint,frames:array<binary>,padding:int,samples:bigint,error:string>"


def parse_column(data: Column) -> Column:
    """Struct of a packet column; a packet that breaks the rules has only ``error``."""

    @pandas_udf(PACKET)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                p = parse(bytes(v if v is not None else b""))
                rows.append((p.config, p.mode, p.bandwidth, p.stereo, p.duration_ns, p.frames, p.padding, p.samples, None))
            except ValueError as e:
                rows.append((None,) * 8 + (str(e),))
        return pd.DataFrame(rows, columns=["config", "mode", "bandwidth", "stereo", "duration_ns", "frames", "padding", "samples", "error"]).astype({"config": "Int32", "duration_ns": "Int64", "padding": "Int32", "samples": "Int64", "stereo": "boolean"})

    return run(data)


def is_head(data: Column) -> Column:
    return F.substring(data, 1, 8) == F.lit(b"OpusHead")


def is_tags(data: Column) -> Column:
    return F.substring(data, 1, 8) == F.lit(b"OpusTags")


@dataclass
class Head:
    channels: int
    pre_skip: int
    input_rate: int
    gain: int  # in 1/256 dB
    family: int = 0
    streams: int = 1
    coupled: int = 0
    mapping: tuple[int, ...] = ()
    demixing: tuple[int, ...] = ()
    decodable: bool = True


def parse_head(data: bytes) -> Head:
    if data[:8] != b"OpusHead" or len(data) < 19:
        raise ValueError("not an Opus head")
    version, channels, skip, rate, gain, family = struct.unpack_from("<BBHIhB", data, 8)
    if version >> 4 or not channels:
        raise ValueError("unsupported Opus head")
    head = Head(channels, skip, rate, gain, family)
    if family == 0:
        if channels > 2:
            raise ValueError("family 0 has one or two channels")
        head.coupled, head.mapping = channels - 1, tuple(range(channels))
        return head
    if len(data) < 21:
        raise ValueError("mapping table is missing")
    head.streams, head.coupled = data[19], data[20]
    if not head.streams or head.coupled > head.streams or head.streams + head.coupled > 255:
        raise ValueError("bad stream counts")
    if family == 3:
        n = channels * (head.streams + head.coupled)
        if len(data) < 21 + 2 * n:
            raise ValueError("demixing matrix is missing")
        head.demixing = struct.unpack_from(f"<{n}h", data, 21)
        return head
    if len(data) < 21 + channels:
        raise ValueError("mapping table is missing")
    head.mapping = tuple(data[21 : 21 + channels])
    if any(m != 255 and m >= head.streams + head.coupled for m in head.mapping):
        raise ValueError("mapping names a stream that is not there")
    head.decodable = family in (1, 2, 255)
    return head


def encode_head(head: Head) -> bytes:
    if head.family == 3:
        raise ValueError("demixing matrices are not written")
    fixed = b"OpusHead" + struct.pack("<BBHIhB", 1, head.channels, head.pre_skip, head.input_rate, head.gain, head.family)
    return fixed if head.family == 0 else fixed + bytes([head.streams, head.coupled, *head.mapping])


def parse_tags(data: bytes) -> tuple[str, list[str]]:
    if data[:8] != b"OpusTags":
        raise ValueError("not Opus tags")
    return tags.parse(data[8:])


def encode_tags(vendor: str, comments: list[str]) -> bytes:
    return b"OpusTags" + tags.encode(vendor, comments)
