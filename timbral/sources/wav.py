"""RIFF/WAVE files: integer samples of 8 (unsigned), 16, 24 and 32 bits and floats of 32 and 64."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .files import table

#: Fixed values of the format: sample tags, and the end of the extensible format's identifier.
INTEGER, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
MAX_CHUNKS = 4096
STREAMING = 0xFFFFFFFF


@dataclass
class Format:
    sample_rate: int
    channels: int
    bits: int
    is_float: bool = False
    channel_mask: int = 0

    def __post_init__(self):
        if self.sample_rate <= 0 or not 1 <= self.channels <= 255 or self.bits not in ((32, 64) if self.is_float else (8, 16, 24, 32)):
            raise ValueError(f"unsupported format {self.sample_rate} Hz, {self.channels} channels, {self.bits} bits")

    @property
    def width(self) -> int:
        return -(-self.bits // 8)

    @property
    def block_align(self) -> int:
        return self.width * self.channels


def _format(p: bytes) -> Format:
    if len(p) < 16:
        raise ValueError("short fmt chunk")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", p)
    mask = 0
    if tag == EXTENSIBLE:
        if len(p) < 40 or p[26:40] != GUID_TAIL:
            raise ValueError("unknown extensible format")
        mask, tag = struct.unpack_from("<IH", p, 20)
    if tag not in (INTEGER, FLOAT):
        raise ValueError(f"unsupported sample tag {tag}")
    return Format(rate, channels, bits, tag == FLOAT, mask)


def parse(content: bytes) -> tuple[Format, bytes, int | None]:
    """(format, sample bytes in whole frames, declared frames).  A data size of 0 or of all ones means: to the end."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found = 12, None
    for _ in range(MAX_CHUNKS):
        if at + 8 > len(content):
            raise ValueError("no data chunk")
        kind, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        at += 8
        if kind == b"fmt ":
            found = _format(content[at : at + size])
        elif kind == b"data":
            if found is None:
                raise ValueError("data before fmt")
            open_end = size in (0, STREAMING)
            data = content[at:] if open_end else content[at : at + size]
            whole = len(data) - len(data) % found.block_align
            return found, data[:whole], None if open_end else size // found.block_align
        at += size + size % 2
    raise ValueError("too many chunks")


def samples(form: Format, data: bytes) -> np.ndarray:
    """Array (channels, frames): int32, or float64 for floats."""
    if form.is_float:
        flat = np.frombuffer(data, f"<f{form.width}").astype(np.float64)
    elif form.bits == 8:
        flat = np.frombuffer(data, np.uint8).astype(np.int32) - 128
    elif form.bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = (raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8
    else:
        flat = np.frombuffer(data, f"<i{form.width}").astype(np.int32)
    return flat.reshape(-1, form.channels).T


def as_float(form: Format, x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) if form.is_float else (x / 2.0 ** (form.bits - 1)).astype(np.float32)


def encode(form: Format, x: np.ndarray, streaming: bool = False) -> bytes:
    """A whole file from an array (channels, frames); floats given for an integer format round half away and clamp."""
    if x.shape[0] != form.channels:
        raise ValueError("channels do not match the format")
    if not form.is_float:
        full = 1 << (form.bits - 1)
        if x.dtype.kind == "f":
            x = np.trunc(x.astype(np.float64) * full + np.copysign(0.5, x))
        x = np.clip(x, -full, full - 1).astype(np.int64)
    flat = np.ascontiguousarray(x.T).ravel()
    if form.is_float:
        data = flat.astype(f"<f{form.width}").tobytes()
    elif form.bits == 8:
        data = (flat + 128).astype(np.uint8).tobytes()
    else:
        data = flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : form.width].tobytes()
    tag = FLOAT if form.is_float else INTEGER
    extensible = form.channels > 2 or form.channel_mask
    fmt = struct.pack("<HHIIHH", EXTENSIBLE if extensible else tag, form.channels, form.sample_rate, form.sample_rate * form.block_align, form.block_align, form.bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, form.bits, form.channel_mask, tag) + GUID_TAIL
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", STREAMING if streaming else len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", STREAMING if streaming else len(body)) + body


def _rows(content: bytes) -> Iterator[dict]:
    form, data, declared = parse(content)
    x, step = samples(form, data), 1 << 16
    for at in range(0, max(x.shape[1], 1), step):
        yield {"sample_rate": form.sample_rate, "bits": form.bits, "is_float": form.is_float, "channel_mask": form.channel_mask, "declared_frames": declared, "first_frame": at, "channels": x[:, at : at + step].astype(np.float64).tolist()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of samples of WAV files, one array a channel."""
    return table(spark, path, _rows, "sample_rate int, bits int, is_float boolean, channel_mask bigint, declared_frames bigint, first_frame bigint, channels array<array<double>>")
