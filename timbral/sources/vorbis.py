"""Vorbis I: the three headers, read and written, and the audio packets of an Ogg stream.

The spectral half of a packet (floors, residues, coupling, inverse transform) needs the headers only; packets of a
stream meet in the overlap of neighbours."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import tags
from ..functions.bits import EndOfData, Low, LowWriter
from ..operators import codebook, floor, mdct
from . import ogg
from .files import table

IDENTIFICATION, COMMENT, SETUP = 1, 3, 5
#: Heights of a floor by its multiplier.
HEIGHTS = {1: 256, 2: 128, 3: 86, 4: 64}


@dataclass
class Info:
    channels: int
    sample_rate: int
    short: int
    long: int
    bitrates: tuple[int, int, int] = (0, 0, 0)


def _payload(data: bytes, kind: int) -> bytes:
    if data[:7] != bytes([kind]) + b"vorbis":
        raise ValueError("another packet was expected")
    return data[7:]


def is_header(data: bytes) -> bool:
    return bool(data) and data[0] & 1 == 1


def parse_info(data: bytes) -> Info:
    p = _payload(data, IDENTIFICATION)
    if len(p) < 23:
        raise ValueError("identification header ends early")
    version, channels, rate, most, nominal, least, sizes, framing = struct.unpack_from("<IBIiiiBB", p)
    short, long = 1 << (sizes & 15), 1 << (sizes >> 4)
    if version or not channels or not rate or not 64 <= short <= long <= 8192 or not framing & 1:
        raise ValueError("bad identification header")
    return Info(channels, rate, short, long, (most, nominal, least))


def encode_info(i: Info) -> bytes:
    sizes = i.short.bit_length() - 1 | (i.long.bit_length() - 1) << 4
    return bytes([IDENTIFICATION]) + b"vorbis" + struct.pack("<IBIiiiBB", 0, i.channels, i.sample_rate, *i.bitrates, sizes, 1)


def parse_comments(data: bytes) -> tuple[str, list[str]]:
    return tags.parse(_payload(data, COMMENT), framing=True)


def encode_comments(vendor: str, comments: list[str]) -> bytes:
    return bytes([COMMENT]) + b"vorbis" + tags.encode(vendor, comments, framing=True)


@dataclass
class FloorClass:
    dimensions: int
    subclasses: int
    master: int
    books: list[int]  # -1: none


@dataclass
class Floor:
    partitions: list[int]
    classes: list[FloorClass]
    multiplier: int
    range_bits: int
    x: list[int]


@dataclass
class Residue:
    kind: int
    begin: int
    end: int
    size: int
    classbook: int
    books: list[list[int]]  # for each class, eight passes, -1: none


@dataclass
class Mapping:
    coupling: list[tuple[int, int]]
    mux: list[int]
    submaps: list[tuple[int, int]]  # floor, residue


@dataclass
class Setup:
    books: list[codebook.Codebook]
    floors: list[Floor | None] = field(default_factory=list)  # None: the old kind, which is passed over
    residues: list[Residue] = field(default_factory=list)
    mappings: list[Mapping] = field(default_factory=list)
    modes: list[tuple[bool, int]] = field(default_factory=list)  # long block, mapping


def _check(index: int, among: list) -> int:
    if index >= len(among):
        raise ValueError("setup names something that is not there")
    return index


def _floor(r: Low, books: list) -> Floor | None:
    kind = r.read(16)
    if kind == 0:
        r.skip(8 + 16 + 16 + 6 + 8)
        for _ in range(r.read(4) + 1):
            _check(r.read(8), books)
        return None
    if kind != 1:
        raise ValueError("unknown floor")
    partitions = [r.read(4) for _ in range(r.read(5))]
    classes = []
    for _ in range(max(partitions, default=-1) + 1):
        dimensions, subclasses = r.read(3) + 1, r.read(2)
        master = _check(r.read(8), books) if subclasses else -1
        own = [r.read(8) - 1 for _ in range(1 << subclasses)]
        for b in own:
            _check(b, books) if b >= 0 else None
        classes.append(FloorClass(dimensions, subclasses, master, own))
    multiplier, range_bits = r.read(2) + 1, r.read(4)
    x = [0, 1 << range_bits, *(r.read(range_bits) for p in partitions for _ in range(classes[p].dimensions))]
    if len(set(x)) != len(x) or len(x) > 65:
        raise ValueError("floor places repeat")
    return Floor(partitions, classes, multiplier, range_bits, x)


def _residue(r: Low, books: list) -> Residue:
    kind = r.read(16)
    if kind > 2:
        raise ValueError("unknown residue")
    begin, end, size, classes, classbook = r.read(24), r.read(24), r.read(24) + 1, r.read(6) + 1, _check(r.read(8), books)
    cascade = [r.read(3) | (r.read(5) << 3 if r.flag() else 0) for _ in range(classes)]
    return Residue(kind, begin, end, size, classbook, [[_check(r.read(8), books) if c >> k & 1 else -1 for k in range(8)] for c in cascade])


def _mapping(r: Low, channels: int, setup: Setup) -> Mapping:
    if r.read(16):
        raise ValueError("unknown mapping")
    submaps = r.read(4) + 1 if r.flag() else 1
    bits = (channels - 1).bit_length()
    coupling = [(r.read(bits), r.read(bits)) for _ in range(r.read(8) + 1)] if r.flag() else []
    if r.read(2) or any(a == b or max(a, b) >= channels for a, b in coupling):
        raise ValueError("bad mapping")
    mux = [r.read(4) for _ in range(channels)] if submaps > 1 else [0] * channels
    if max(mux) >= submaps:
        raise ValueError("bad mapping")
    pairs = []
    for _ in range(submaps):
        r.skip(8)
        pairs.append((_check(r.read(8), setup.floors), _check(r.read(8), setup.residues)))
    return Mapping(coupling, mux, pairs)


def parse_setup(data: bytes, channels: int) -> Setup:
    r = Low(_payload(data, SETUP))
    out = Setup([codebook.parse(r) for _ in range(r.read(8) + 1)])
    if any(r.read(16) for _ in range(r.read(6) + 1)):
        raise ValueError("time domain transforms are not zero")
    out.floors = [_floor(r, out.books) for _ in range(r.read(6) + 1)]
    out.residues = [_residue(r, out.books) for _ in range(r.read(6) + 1)]
    for _ in range(r.read(6) + 1):
        out.mappings.append(_mapping(r, channels, out))
    for _ in range(r.read(6) + 1):
        long, window, transform = r.flag(), r.read(16), r.read(16)
        if window or transform:
            raise ValueError("unknown mode")
        out.modes.append((long, _check(r.read(8), out.mappings)))
    if not r.flag():
        raise ValueError("framing bit is missing")
    return out


def encode_setup(s: Setup, channels: int) -> bytes:
    w = LowWriter()
    w.write(len(s.books) - 1, 8)
    for b in s.books:
        b.encode(w)
    w.write(0, 6)
    w.write(0, 16)
    w.write(len(s.floors) - 1, 6)
    for f in s.floors:
        if f is None:
            raise ValueError("floors of the old kind are not written")
        w.write(1, 16)
        w.write(len(f.partitions), 5)
        for p in f.partitions:
            w.write(p, 4)
        for c in f.classes:
            w.write(c.dimensions - 1, 3)
            w.write(c.subclasses, 2)
            if c.subclasses:
                w.write(c.master, 8)
            for b in c.books:
                w.write(b + 1, 8)
        w.write(f.multiplier - 1, 2)
        w.write(f.range_bits, 4)
        for v in f.x[2:]:
            w.write(v, f.range_bits)
    w.write(len(s.residues) - 1, 6)
    for d in s.residues:
        w.write(d.kind, 16)
        for v in (d.begin, d.end, d.size - 1):
            w.write(v, 24)
        w.write(len(d.books) - 1, 6)
        w.write(d.classbook, 8)
        cascade = [sum((b >= 0) << k for k, b in enumerate(row)) for row in d.books]
        for c in cascade:
            w.write(c & 7, 3)
            w.write(c > 7, 1)
            if c > 7:
                w.write(c >> 3, 5)
        for row in d.books:
            for b in row:
                if b >= 0:
                    w.write(b, 8)
    w.write(len(s.mappings) - 1, 6)
    bits = (channels - 1).bit_length()
    for m in s.mappings:
        w.write(0, 16)
        w.write(len(m.submaps) > 1, 1)
        if len(m.submaps) > 1:
            w.write(len(m.submaps) - 1, 4)
        w.write(bool(m.coupling), 1)
        if m.coupling:
            w.write(len(m.coupling) - 1, 8)
            for a, b in m.coupling:
                w.write(a, bits)
                w.write(b, bits)
        w.write(0, 2)
        if len(m.submaps) > 1:
            for v in m.mux:
                w.write(v, 4)
        for f, d in m.submaps:
            w.write(0, 8)
            w.write(f, 8)
            w.write(d, 8)
    w.write(len(s.modes) - 1, 6)
    for long, mapping in s.modes:
        w.write(long, 1)
        w.write(0, 32)
        w.write(mapping, 8)
    w.write(1, 1)
    return bytes([SETUP]) + b"vorbis" + w.bytes()


def _floor_values(r: Low, f: Floor, books: list) -> list[int] | None:
    """Coded heights, or none where the channel is silent or the packet ends inside them."""
    try:
        if not r.flag():
            return None
        bits = (HEIGHTS[f.multiplier] - 1).bit_length()
        out = [r.read(bits), r.read(bits)]
        for p in f.partitions:
            c = f.classes[p]
            choice = books[c.master].scalar(r) if c.subclasses else 0
            for _ in range(c.dimensions):
                b = c.books[choice & ((1 << c.subclasses) - 1)]
                choice >>= c.subclasses
                out.append(books[b].scalar(r) if b >= 0 else 0)
        return out
    except EndOfData:
        return None


def _residue_vectors(r: Low, d: Residue, books: list, vectors: np.ndarray, skip: list[bool]) -> None:
    """Add the coded vectors of up to eight passes; the end of the packet ends them."""
    if d.kind == 2:
        if all(skip):
            return
        flat = np.zeros((1, vectors.size))
        _residue_vectors(r, Residue(1, d.begin, d.end, d.size, d.classbook, d.books), books, flat, [False])
        vectors += flat.reshape(-1, len(vectors)).T
        return
    begin, end = min(d.begin, vectors.shape[1]), min(d.end, vectors.shape[1])
    parts, classes = (end - begin) // d.size, len(d.books)
    words = books[d.classbook].dimensions
    chosen = np.zeros((len(vectors), parts + words), np.int64)
    try:
        for step in range(8):
            for at in range(0, parts, words):
                if step == 0:
                    for c in np.flatnonzero(~np.array(skip)):
                        number = books[d.classbook].scalar(r)
                        for k in reversed(range(words)):
                            number, chosen[c, at + k] = divmod(number, classes)
                for part in range(at, min(at + words, parts)):
                    for c in np.flatnonzero(~np.array(skip)):
                        b = d.books[chosen[c, part]][step]
                        if b < 0:
                            continue
                        n, o = books[b].dimensions, begin + part * d.size
                        for i in range(d.size // n):
                            v = books[b].vector(books[b].scalar(r))
                            if d.kind == 0:
                                vectors[c, o + i : o + d.size : d.size // n][:n] += v
                            else:
                                vectors[c, o + i * n : o + (i + 1) * n] += v
    except EndOfData:
        pass


def window(n: int, info: Info, before_long: bool, after_long: bool) -> np.ndarray:
    """Slopes as long as the shorter of two neighbours, centred at the quarters of the block."""
    halves = []
    for long in (before_long, after_long):
        other = n if n == info.short or long else info.short
        slope = mdct.power_window(other)[: other // 2]
        halves.append(np.concatenate([np.zeros((n - other) // 4), slope, np.ones((n - other) // 4)]))
    return np.concatenate([halves[0], halves[1][::-1]])


def decode_packet(data: bytes, info: Info, setup: Setup) -> np.ndarray:
    """Windowed block (channels, n) of an audio packet."""
    r = Low(data)
    if r.read(1):
        raise ValueError("not an audio packet")
    long, which = setup.modes[_check(r.read((len(setup.modes) - 1).bit_length()), setup.modes)]
    m, n = setup.mappings[which], info.long if long else info.short
    before, after = (r.flag(), r.flag()) if long else (False, False)
    shapes = [setup.floors[m.submaps[m.mux[c]][0]] for c in range(info.channels)]
    if any(f is None for f in shapes):
        raise ValueError("floors of the old kind are not synthesised")
    heights = [_floor_values(r, f, setup.books) for f in shapes]
    silent = [h is None for h in heights]
    for a, b in m.coupling:
        if not (silent[a] and silent[b]):
            silent[a] = silent[b] = False
    spectrum = np.zeros((info.channels, n // 2))
    for k, (_, d) in enumerate(m.submaps):
        own = [c for c in range(info.channels) if m.mux[c] == k]
        part = np.zeros((len(own), n // 2))
        if own:
            _residue_vectors(r, setup.residues[d], setup.books, part, [silent[c] for c in own])
            spectrum[own] = part
    for a, b in reversed(m.coupling):
        spectrum[a], spectrum[b] = floor.uncouple(spectrum[a], spectrum[b])
    for c, h in enumerate(heights):
        spectrum[c] *= 0 if h is None else floor.curve(shapes[c].x, h, shapes[c].multiplier, n // 2)
    return mdct.inverse(spectrum) * window(n, info, before, after)


def overlap(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Whole samples between the middles of neighbouring blocks; the first block only opens the stream."""
    last = None
    for block in blocks:
        n = block.shape[1]
        if last is not None:
            # both reach over the samples between their middles; where one is shorter it is silent there
            size = last.shape[1] // 4 + n // 4
            out = np.zeros((len(block), size))
            tail, head = last[:, last.shape[1] // 2 :][:, :size], block[:, : n // 2][:, -size:]
            out[:, : tail.shape[1]] += tail
            out[:, size - head.shape[1] :] += head
            yield out
        last = block


def decode(content: bytes) -> tuple[Info, list[str], np.ndarray]:
    """(info, comments, samples (channels, frames)) of the first stream of a file, trimmed by its granule positions."""
    serial, packets, parts = None, [], b""
    ends: list[int | None] = []
    for p in ogg.pages(content):
        serial = p["serial"] if serial is None else serial
        if p["serial"] != serial:
            continue
        at = 0
        for s in p["segments"]:
            parts += p["payload"][at : at + s]
            at += s
            if s < 255:
                packets.append(parts)
                ends.append(None)
                parts = b""
        if packets and p["granule"] is not None:
            ends[-1] = p["granule"]
        if p["header_type"] & ogg.LAST:
            break
    if len(packets) < 3:
        raise ValueError("headers are missing")
    info, comments = parse_info(packets[0]), parse_comments(packets[1])[1]
    setup = parse_setup(packets[2], info.channels)
    audio = [(d, g) for d, g in zip(packets[3:], ends[3:], strict=True) if d and not is_header(d)]
    made = list(overlap(decode_packet(d, info, setup) for d, _ in audio))
    x = np.concatenate(made, axis=1) if made else np.zeros((info.channels, 0))
    counts = np.cumsum([0, *(b.shape[1] for b in made)])
    known = [(int(counts[i]), g) for i, (_, g) in enumerate(audio) if g is not None]
    if known:
        first, last = known[0], known[-1]
        head = max(first[0] - first[1], 0) if len(known) > 1 else 0
        x = x[:, head : max(head, min(x.shape[1], last[1] + head))] if last[1] + head < x.shape[1] else x[:, head:]
    return info, comments, x.astype(np.float32)


def _rows(content: bytes) -> Iterator[dict]:
    info, comments, x = decode(content)
    for at in range(0, max(x.shape[1], 1), 1 << 16):
        yield {"sample_rate": info.sample_rate, "first_sample": at, "comments": comments, "channels": x[:, at : at + (1 << 16)].tolist()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of decoded samples of Ogg Vorbis files."""
    return table(spark, path, _rows, "sample_rate int, first_sample bigint, comments array<string>, channels array<array<float>>")
