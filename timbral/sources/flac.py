"""FLAC: metadata, frames and whole streams, native or in Ogg; and an encoder that searches for the cheapest plan.

Frames are found by decoding: the end of one is where its last subframe and checksum end, so no pattern in the
samples can be taken for a frame."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.bits import High, HighWriter
from ..functions.checksums import crc
from ..functions.tags import parse as parse_tags
from ..operators.lpc import autocorrelate, levinson, predict, quantise, tukey
from . import ogg
from .files import table

#: Fixed values of the format: samples per second and bits by their header codes, and sizes of blocks.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10
#: Fixed predictors: coefficients of the last samples by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@dataclass
class StreamInfo:
    min_block: int
    max_block: int
    sample_rate: int
    channels: int
    bits: int
    min_frame: int = 0
    max_frame: int = 0
    total_samples: int = 0
    md5: bytes = bytes(16)

    def __post_init__(self):
        if not (16 <= self.min_block <= self.max_block <= 65535 and 1 <= self.channels <= 8 and 4 <= self.bits <= 32):
            raise ValueError("stream information out of range")

    def encode(self) -> bytes:
        w = HighWriter()
        for v, n in ((self.min_block, 16), (self.max_block, 16), (self.min_frame, 24), (self.max_frame, 24), (self.sample_rate, 20), (self.channels - 1, 3), (self.bits - 1, 5), (self.total_samples, 36)):
            w.write(v, n)
        return w.bytes() + self.md5


@dataclass
class Metadata:
    info: StreamInfo
    vendor: str | None = None
    comments: list[str] = field(default_factory=list)


def parse_info(p: bytes) -> StreamInfo:
    if len(p) != 34:
        raise ValueError("stream information has another size")
    r = High(p)
    low, high, small, large, rate, channels, bits, total = (r.read(n) for n in (16, 16, 24, 24, 20, 3, 5, 36))
    return StreamInfo(low, high, rate, channels + 1, bits + 1, small, large, total, p[18:])


def metadata(content: bytes) -> tuple[Metadata, int]:
    """(metadata, place of the first frame) of a native file."""
    if content[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, out, last = 4, None, False
    while not last:
        if at + 4 > len(content):
            raise ValueError("metadata ends early")
        last, kind, size = bool(content[at] & 128), content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
        body = content[at + 4 : at + 4 + size]
        if kind == 127 or len(body) < size:
            raise ValueError("bad metadata block")
        if kind == 0:
            if out is not None:
                raise ValueError("two stream information blocks")
            out = Metadata(parse_info(body))
        elif out is None:
            raise ValueError("stream information is not first")
        elif kind == 4:
            out.vendor, out.comments = parse_tags(body)
        at += 4 + size
    return out, at


def _number(r: High) -> int:
    first = r.read(8)
    ones = 8 - (first ^ 255).bit_length()
    if ones == 1 or ones == 8:
        raise ValueError("bad coded number")
    v = first & (127 >> ones) if ones else first
    for _ in range(max(ones - 1, 0)):
        b = r.read(8)
        if b >> 6 != 2:
            raise ValueError("bad coded number")
        v = v << 6 | b & 63
    return v


def coded_number(v: int) -> bytes:
    if v < 128:
        return bytes([v])
    n = next(n for n in range(2, 8) if v < 1 << (5 * n + 1))
    tail = [128 | v >> 6 * k & 63 for k in range(n - 2, -1, -1)]
    return bytes([(255 << (8 - n) & 255) | v >> 6 * (n - 1), *tail])


@dataclass
class Header:
    number: int
    variable: bool
    size: int
    sample_rate: int
    channels: int
    mode: int
    bits: int


def _header(r: High, info: StreamInfo, content: bytes) -> Header:
    start = r.at // 8
    if r.read(15) != 0x7FFC:
        raise ValueError("no frame here")
    variable = r.flag()
    block, rate, mode, depth = r.read(4), r.read(4), r.read(4), r.read(3)
    if r.read(1) or mode > MID_SIDE or block == 0 or rate == 15 or depth == 3:
        raise ValueError("reserved value in a frame header")
    number = _number(r)
    size = r.read(8) + 1 if block == 6 else r.read(16) + 1 if block == 7 else BLOCKS[block]
    if rate in (12, 13, 14):
        hertz = r.read(8) * 1000 if rate == 12 else r.read(16) * (1 if rate == 13 else 10)
    else:
        hertz = RATES.get(rate, info.sample_rate)
    end = r.at // 8
    if crc(content[start:end], 8) != r.read(8):
        raise ValueError("frame header checksum")
    channels = mode + 1 if mode < 8 else 2
    if channels != info.channels:
        raise ValueError("channels change")
    return Header(number, variable, size, hertz, channels, mode, DEPTHS.get(depth, info.bits))


def unfold(u: np.ndarray) -> np.ndarray:
    return (u >> 1) ^ -(u & 1)


def _rice(r: High, k: int, count: int) -> np.ndarray:
    """``count`` Rice codes.  Bits come in pieces as a digit string, in which the next one is found by search."""
    out = np.empty(count, np.int64)
    done = 0
    while done < count:
        width = min(r.left, max((count - done) * (k + 4), 512))
        digits = format(r.read(width), f"0{width}b")
        at = begun = 0
        while done < count:
            one = digits.find("1", at)
            if one < 0 or one + 1 + k > width:
                break
            out[done] = (one - at) << k | (int(digits[one + 1 : one + 1 + k], 2) if k else 0)
            done, at = done + 1, one + 1 + k
        r.at -= width - at
        if at == begun and done < count:
            n = r.unary(1 << 30)  # a code that is longer than the piece
            out[done] = n << k | r.read(k)
            done += 1
    return unfold(out)


def _residual(r: High, size: int, order: int) -> np.ndarray:
    method, parts = r.read(2), r.read(4)
    if method > 1 or size % (1 << parts) or size >> parts < order:
        raise ValueError("bad residual partitions")
    width, out = 4 + method, []
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        k = r.read(width)
        if k == (1 << width) - 1:
            raw = r.read(5)
            out.append(np.array([r.signed(raw) for _ in range(n)], np.int64))
        else:
            out.append(_rice(r, k, n))
    return np.concatenate(out)


def _subframe(r: High, size: int, bits: int) -> np.ndarray:
    if r.read(1):
        raise ValueError("subframe padding")
    kind = r.read(6)
    wasted = r.unary(bits) + 1 if r.flag() else 0
    bits -= wasted
    if bits <= 0:
        raise ValueError("all bits wasted")
    if kind == 0:
        x = np.full(size, r.signed(bits), np.int64)
    elif kind == 1:
        x = np.array([r.signed(bits) for _ in range(size)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        x = _warm(r, size, bits, order)
        x[order:] = _residual(r, size, order)
        history = [np.diff(x[:order], k)[-1] if k < order else 0 for k in range(order)]
        y = x[order:].copy()
        for k in reversed(range(order)):  # undo the differences one by one
            y = np.cumsum(y) + history[k]
        x[order:] = y
    elif kind >= 32:
        order = kind - 31
        x = _warm(r, size, bits, order)
        precision = r.read(4) + 1
        shift = r.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("bad predictor")
        c = [r.signed(precision) for _ in range(order)]
        values, residual = x[:order].tolist(), _residual(r, size, order).tolist()
        for e in residual:
            values.append(e + (sum(a * b for a, b in zip(c, reversed(values[-order:]), strict=True)) >> shift))
        x = np.array(values, np.int64)
    else:
        raise ValueError(f"reserved subframe kind {kind}")
    return x << wasted


def _warm(r: High, size: int, bits: int, order: int) -> np.ndarray:
    if order > size:
        raise ValueError("predictor is longer than the block")
    x = np.zeros(size, np.int64)
    x[:order] = [r.signed(bits) for _ in range(order)]
    return x


def side_channel(mode: int) -> int | None:
    return {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(mode)


def undecorrelate(x: np.ndarray, mode: int) -> np.ndarray:
    a, b = (x[0], x[1]) if len(x) > 1 else (x[0], None)
    if mode == LEFT_SIDE:
        return np.stack([a, a - b])
    if mode == SIDE_RIGHT:
        return np.stack([a + b, b])
    if mode == MID_SIDE:
        twice = 2 * a + (b & 1)
        return np.stack([(twice + b) >> 1, (twice - b) >> 1])
    return x


def decode_frame(content: bytes, at: int, info: StreamInfo) -> tuple[Header, np.ndarray, int]:
    """(header, array (channels, frames), end) of the frame that starts at a byte."""
    r = High(content)
    r.at = 8 * at
    h = _header(r, info, content)
    x = np.stack([_subframe(r, h.size, h.bits + (c == side_channel(h.mode))) for c in range(h.channels)])
    r.align()
    end = r.at // 8
    if crc(content[at:end], 16) != r.read(16):
        raise ValueError("frame checksum")
    return h, undecorrelate(x, h.mode), end + 2


def _ogg_frames(content: bytes) -> tuple[Metadata, Iterator[bytes]]:
    found, serial, parts = [], None, b""
    for p in ogg.pages(content):
        serial = p["serial"] if serial is None else serial
        if p["serial"] != serial:
            continue
        at = 0
        for s in p["segments"]:
            parts += p["payload"][at : at + s]
            at += s
            if s < 255:
                found.append(parts)
                parts = b""
    if not found or found[0][:5] != b"\x7fFLAC" or found[0][5] != 1:
        raise ValueError("no FLAC mapping in this Ogg file")
    meta = Metadata(parse_info(found[0][17:51]))
    frames = 1
    for body in found[1:]:
        if not body or body[0] == 0xFF:
            break
        frames += 1
        if body[0] & 127 == 4:
            meta.vendor, meta.comments = parse_tags(body[4:])
        if body[0] & 128:
            break
    return meta, (f for f in found[frames:] if f)


def blocks(content: bytes) -> Iterator[tuple[Metadata, Header, np.ndarray]]:
    """Decoded blocks of a file, native or in Ogg."""
    if content[:4] == b"OggS":
        meta, frames = _ogg_frames(content)
        for f in frames:
            yield meta, *decode_frame(f, 0, meta.info)[:2]
        return
    meta, at = metadata(content)
    while at < len(content):
        h, x, at = decode_frame(content, at, meta.info)
        yield meta, h, x


def decode(content: bytes, verify: bool = True) -> tuple[Metadata, np.ndarray]:
    """(metadata, array (channels, frames)); with ``verify`` the MD5 of the samples must be the stored one."""
    parts, meta = [], None
    for meta, _, x in blocks(content):  # noqa: B007
        parts.append(x)
    if meta is None:
        meta = metadata(content)[0] if content[:4] != b"OggS" else _ogg_frames(content)[0]
    x = np.concatenate(parts, axis=1) if parts else np.zeros((meta.info.channels, 0), np.int64)
    if verify and any(meta.info.md5) and pcm_md5(x, meta.info.bits) != meta.info.md5:
        raise ValueError("samples differ from their MD5")
    return meta, x


def pcm_md5(x: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return hashlib.md5(np.ascontiguousarray(x.T).astype("<i8").ravel().view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest()


# Encoder ------------------------------------------------------------------------------------


@dataclass
class Partition:
    param: int  # -1: escape
    width: int
    bits: int


def signed_width(x: np.ndarray) -> int:
    """Bits that hold every value; 0 if all are 0."""
    if not len(x) or not x.any():
        return 0
    largest = int(np.max(np.where(x < 0, ~x, x)))
    return largest.bit_length() + 1


def plan_partition(x: np.ndarray) -> Partition:
    """Rice with the best parameter, or plain numbers if they are cheaper."""
    u = np.where(x < 0, -2 * x - 1, 2 * x)
    near = int(u.sum() // max(len(u), 1)).bit_length()
    ks = range(max(near - 2, 0), min(near + 2, 30) + 1)
    bits = [int((u >> k).sum()) + len(u) * (1 + k) for k in ks]
    best = int(np.argmin(bits))
    width = signed_width(x)
    if width < 32 and 9 + width * len(x) < 4 + bits[best]:
        return Partition(-1, width, 9 + width * len(x))
    return Partition(ks[best], 0, 4 + bits[best])


def plan_residual(x: np.ndarray, size: int, order: int, most: int = 8) -> tuple[int, list[Partition], int]:
    """(partition order, partitions, bits): the first least of the dyadic partitions that the block allows."""
    best = None
    for po in range(most + 1):
        if size % (1 << po) or size >> po <= order:
            break
        edges = np.arange(1, 1 << po) * (size >> po) - order
        parts = [plan_partition(p) for p in np.split(x, edges)]
        bits = sum(p.bits for p in parts)
        if best is None or bits < best[2]:
            best = po, parts, bits
    return best


def _write_residual(w: HighWriter, x: np.ndarray, size: int, order: int, po: int, parts: list[Partition]) -> None:
    wide = max(p.param for p in parts) > 14
    w.write(wide, 2)
    w.write(po, 4)
    edges = np.arange(1, 1 << po) * (size >> po) - order
    for p, values in zip(parts, np.split(x, edges), strict=True):
        w.write(p.param if p.param >= 0 else 31 if wide else 15, 5 if wide else 4)
        if p.param < 0:
            w.write(p.width, 5)
            for v in values.tolist():
                w.write(v, p.width)
        else:
            k = p.param
            u = np.where(values < 0, -2 * values - 1, 2 * values).tolist()
            low = (1 << k) - 1
            w.digits("".join("0" * (v >> k) + "1" + (format(v & low, f"0{k}b") if k else "") for v in u))


def _lpc_plan(x: np.ndarray, bits: int, most: int) -> tuple | None:
    """(bits, order, coefficients, shift, precision, residual, partition plan) of the best order near the estimate."""
    size = len(x)
    found, errors = levinson(autocorrelate(x * tukey(size, 0.5), most), most)
    if not found:
        return None
    precision = 12 if bits <= 16 else 14
    cost = [size * max(0.0, 0.5 * np.log2(max(e / size, 1e-9))) + (k + 1) * (bits + precision) for k, e in enumerate(errors)]
    near = int(np.argmin(cost)) + 1
    best = None
    for order in (o for o in (near - 1, near, near + 1) if 1 <= o <= len(found) and o < size):
        q = quantise(found[order - 1], precision)
        if q is None:
            continue
        residual = predict(x, *q)
        if len(residual) and (residual.max() >= 1 << 31 or residual.min() < -(1 << 31)):
            continue
        plan = plan_residual(residual, size, order)
        if plan is None:
            continue
        total = 8 + order * bits + 9 + order * precision + 6 + plan[2]
        if best is None or total < best[0]:
            best = total, order, *q, precision, residual, plan
    return best


def _write_subframe(w: HighWriter, x: np.ndarray, bits: int, max_lpc: int) -> None:
    size = len(x)
    union = int(np.bitwise_or.reduce(x))
    wasted = (union & -union).bit_length() - 1 if union else 0
    if (x == x[0]).all():
        wasted = 0
    x, bits = x >> wasted, bits - wasted

    def start(kind: int) -> None:
        w.write(kind, 7)
        w.write(bool(wasted), 1)
        if wasted:
            w.unary(wasted - 1)

    if (x == x[0]).all():
        start(0)
        w.write(int(x[0]), bits)
        return
    best, least = None, 8 + size * bits
    for order in range(min(4, size - 1) + 1):
        residual = np.diff(x, order) if order else x
        if len(residual) and (residual.max() >= 1 << 31 or residual.min() < -(1 << 31)):
            continue
        plan = plan_residual(residual, size, order)
        if plan and 8 + order * bits + 6 + plan[2] < least:
            best, least = (order, residual, plan), 8 + order * bits + 6 + plan[2]
    lpc = _lpc_plan(x, bits, max_lpc) if max_lpc and size > max_lpc else None
    if lpc and lpc[0] < least:
        _, order, c, shift, precision, residual, plan = lpc
        start(31 + order)
        for v in x[:order].tolist():
            w.write(v, bits)
        w.write(precision - 1, 4)
        w.write(shift, 5)
        for v in c.tolist():
            w.write(v, precision)
    elif best:
        order, residual, plan = best
        start(8 + order)
        for v in x[:order].tolist():
            w.write(v, bits)
    else:
        start(1)
        for v in x.tolist():
            w.write(v, bits)
        return
    _write_residual(w, residual, size, order, plan[0], plan[1])


def stereo_mode(left: np.ndarray, right: np.ndarray) -> int:
    """The cheapest of left and right, left and side, side and right, mid and side, by first differences, of which the
    first is from zero; the side has one more bit a sample."""

    def bits(x: np.ndarray, more: int = 0) -> float:
        return len(x) * (max(0.0, np.log2(1 + np.abs(np.diff(x, prepend=0)).sum() / len(x))) + more) if len(x) else 0.0

    l, r, m, s = bits(left), bits(right), bits((left + right) >> 1), bits(left - right, 1)  # noqa: E741
    cost = [l + r, l + s, s + r, m + s]
    return (1, LEFT_SIDE, SIDE_RIGHT, MID_SIDE)[int(np.argmin(cost))]


def encode_frame(x: np.ndarray, number: int, info: StreamInfo, max_lpc: int = 8) -> bytes:
    channels, size = x.shape
    mode = channels - 1
    if channels == 2 and info.bits < 32:
        mode = stereo_mode(*x)
        if mode >= 8:
            a, b = x
            x = np.stack([(a, a - b), (a - b, b), ((a + b) >> 1, a - b)][mode - 8])
    w = HighWriter()
    block = next((k for k, v in BLOCKS.items() if v == size), 6 if size <= 256 else 7)
    rate = next((k for k, v in RATES.items() if v == info.sample_rate), 0)
    depth = next((k for k, v in DEPTHS.items() if v == info.bits), 0)
    for v, n in ((0x7FFC, 15), (0, 1), (block, 4), (rate, 4), (mode, 4), (depth, 3), (0, 1)):
        w.write(v, n)
    for b in coded_number(number):
        w.write(b, 8)
    if block in (6, 7):
        w.write(size - 1, 8 if block == 6 else 16)
    w.write(crc(w.bytes(), 8), 8)
    for c in range(channels):
        _write_subframe(w, x[c], info.bits + (c == side_channel(mode)), max_lpc)
    w.align()
    body = w.bytes()
    return body + crc(body, 16).to_bytes(2, "big")


def encode(x: np.ndarray, sample_rate: int, bits: int, block: int = 4096, max_lpc: int = 8) -> bytes:
    """A whole native file of an integer array (channels, frames)."""
    x = np.asarray(x, np.int64)
    if len(x[0]) and (x.max() >= 1 << (bits - 1) or x.min() < -(1 << (bits - 1))):
        raise ValueError("samples do not fit the depth")
    info = StreamInfo(block, block, sample_rate, len(x), bits, total_samples=x.shape[1], md5=pcm_md5(x, bits))
    frames = [encode_frame(x[:, at : at + block], i, info, max_lpc) for i, at in enumerate(range(0, x.shape[1], block))]
    info.min_frame, info.max_frame = min(map(len, frames), default=0), max(map(len, frames), default=0)
    return b"fLaC" + b"\x80\x00\x00\x22" + info.encode() + b"".join(frames)


# Tables -------------------------------------------------------------------------------------


def _rows(content: bytes) -> Iterator[dict]:
    first = 0
    for n, (_, h, x) in enumerate(blocks(content)):
        yield {"frame_no": n, "first_sample": first, "sample_rate": h.sample_rate, "bits": h.bits, "mode": h.mode, "channels": x.tolist()}
        first += h.size


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each decoded frame of FLAC files, native or in Ogg."""
    return table(spark, path, _rows, "frame_no bigint, first_sample bigint, sample_rate int, bits int, mode int, channels array<array<bigint>>")


def _meta(content: bytes) -> Iterator[dict]:
    meta = _ogg_frames(content)[0] if content[:4] == b"OggS" else metadata(content)[0]
    i = meta.info
    yield {"sample_rate": i.sample_rate, "channels": i.channels, "bits": i.bits, "min_block": i.min_block, "max_block": i.max_block, "total_samples": i.total_samples or None, "md5": i.md5, "vendor": meta.vendor, "comments": meta.comments}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, _meta, "sample_rate int, channels int, bits int, min_block int, max_block int, total_samples bigint, md5 binary, vendor string, comments array<string>")


def write(signals: DataFrame, sample_rate: int, bits: int, block: int = 4096) -> DataFrame:
    """(name, content): rows (name, channels array<array<bigint>>) as whole files, for ``files.save``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(np.array(x, np.int64), sample_rate, bits, block) for x in batch.column("channels").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], ["name", "content"])

    return signals.select("name", "channels").mapInArrow(run, "name string, content binary")
