"""Vorbis codebooks: code lengths from counts, codewords, vectors, and the packed form in a setup header."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.bits import Low, LowWriter

SYNC = 0x564342
LONGEST = 32


def float_unpack(x: int) -> float:
    """Sign, ten bits of exponent with bias 788, 21 bits of mantissa."""
    m = (x & 0x1FFFFF) * (-1 if x >> 31 else 1)
    return math.ldexp(m, (x >> 21 & 0x3FF) - 788)


def float_pack(v: float) -> int:
    """The nearest packed float; what is too large or small is clamped."""
    if not v or not math.isfinite(v):
        return 0
    m, e = math.frexp(abs(v))
    mantissa, exponent = round(m * (1 << 21)), e - 21 + 788
    if mantissa == 1 << 21:
        mantissa, exponent = mantissa >> 1, exponent + 1
    if exponent < 0:
        mantissa, exponent = mantissa >> min(-exponent, 22), 0
    if exponent > 0x3FF:
        mantissa, exponent = 0x1FFFFF, 0x3FF
    return (1 << 31 if v < 0 else 0) | exponent << 21 | mantissa


def lattice_values(entries: int, dimensions: int) -> int:
    """The largest n with n ** dimensions <= entries."""
    n = round(entries ** (1 / dimensions))
    while n**dimensions > entries:
        n -= 1
    while (n + 1) ** dimensions <= entries:
        n += 1
    return n


def is_complete(lengths: list[int]) -> bool:
    used = [n for n in lengths if n]
    return sum(1 << (LONGEST - n) for n in used) == 1 << LONGEST


def flat_lengths(n: int) -> list[int]:
    """A complete code of n entries on one or two levels, the shorter ones first."""
    if n < 1:
        raise ValueError("no entries")
    deep = max((n - 1).bit_length(), 1)
    short = (1 << deep) - n if n > 1 else 0
    return [deep - (i < short) for i in range(n)]


def lengths_from_counts(counts: list[int], limit: int = LONGEST) -> list[int]:
    """Optimal code lengths of at most ``limit`` for entries with a count, by package-merge; 0 for the others.

    Each round pairs the cheapest packages and adds the leaves again; an entry's length is the number of
    packages among the first 2n - 2 that it is in."""
    used = [i for i, c in enumerate(counts) if c > 0]
    if len(used) < 2:
        return flat_lengths(len(counts))
    if len(used) > 1 << limit:
        raise ValueError("more entries than codes")
    leaves = sorted((counts[i], (i,)) for i in used)
    row = leaves
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = list(heapq.merge(leaves, pairs))
    out = [0] * len(counts)
    for _, members in row[: 2 * len(used) - 2]:
        for i in members:
            out[i] += 1
    return out


def codewords(lengths: list[int]) -> list[int]:
    """The lowest free codeword of each entry's length, in entry order.  A lone entry has the code 0; any other code
    must be complete."""
    used = [n for n in lengths if n]
    if len(used) == 1:
        return [0] * len(lengths)
    free: dict[int, int] = {0: 0}  # lengths at which one codeword, the lowest there, starts a free subtree
    out = []
    for n in lengths:
        if not n:
            out.append(0)
            continue
        at = max((k for k in free if k <= n), default=-1)
        if at < 0:
            raise ValueError("code has too many entries")
        word = free.pop(at)
        for k in range(at + 1, n + 1):  # take the left branch down to the length, leave the right ones free
            word <<= 1
            free[k] = word | 1
        out.append(word)
    if free:
        raise ValueError("code has too few entries")
    return out


@dataclass
class Codebook:
    dimensions: int
    lengths: list[int]
    lookup: int = 0  # 0: none, 1: lattice, 2: a row for each entry
    minimum: int = 0  # packed floats
    delta: int = 0
    cumulative: bool = False
    values: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.words = codewords(self.lengths)
        self.by_code = {(n, w): i for i, (n, w) in enumerate(zip(self.lengths, self.words, strict=True)) if n}

    def scalar(self, r: Low) -> int:
        """Next entry: bits come highest first."""
        word = 0
        for n in range(1, LONGEST + 1):
            word = word << 1 | r.read(1)
            if (n, word) in self.by_code:
                return self.by_code[n, word]
        if sum(n > 0 for n in self.lengths) == 1:
            return next(i for i, n in enumerate(self.lengths) if n)
        raise ValueError("no such codeword")

    def write_entry(self, w: LowWriter, entry: int) -> None:
        n = self.lengths[entry]
        w.write(int(format(self.words[entry], f"0{n}b")[::-1], 2), n)

    def vector(self, entry: int) -> np.ndarray:
        if not self.lookup:
            raise ValueError("codebook has no vectors")
        if self.lookup == 1:
            base = lattice_values(len(self.lengths), self.dimensions)
            digits = [entry // base**k % base for k in range(self.dimensions)]
        else:
            digits = range(entry * self.dimensions, (entry + 1) * self.dimensions)
        v = np.array([self.values[k] for k in digits], np.float64) * float_unpack(self.delta) + float_unpack(self.minimum)
        return (np.cumsum(v) if self.cumulative else v).astype(np.float32)

    def encode(self, w: LowWriter) -> None:
        """The packed form: lengths in order if they never fall, else one by one, with a flag if some are unused."""
        w.write(SYNC, 24)
        w.write(self.dimensions, 16)
        w.write(len(self.lengths), 24)
        rising = all(self.lengths) and all(a <= b for a, b in zip(self.lengths, self.lengths[1:], strict=False))
        w.write(rising, 1)
        if rising:
            w.write(self.lengths[0] - 1, 5)
            at, n = 0, self.lengths[0]
            while at < len(self.lengths):
                count = self.lengths.count(n)
                w.write(count, (len(self.lengths) - at).bit_length())
                at, n = at + count, n + 1
        else:
            sparse = not all(self.lengths)
            w.write(sparse, 1)
            for n in self.lengths:
                if sparse:
                    w.write(n > 0, 1)
                if n:
                    w.write(n - 1, 5)
        w.write(self.lookup, 4)
        if self.lookup:
            w.write(self.minimum, 32)
            w.write(self.delta, 32)
            bits = max(max(self.values, default=0).bit_length(), 1)
            w.write(bits - 1, 4)
            w.write(self.cumulative, 1)
            for v in self.values:
                w.write(v, bits)


def parse(r: Low) -> Codebook:
    if r.read(24) != SYNC:
        raise ValueError("not a codebook")
    dimensions, entries = r.read(16), r.read(24)
    if not dimensions or not entries:
        raise ValueError("empty codebook")
    lengths: list[int] = []
    if r.flag():
        n = r.read(5) + 1
        while len(lengths) < entries:
            count = r.read((entries - len(lengths)).bit_length())
            if count > entries - len(lengths) or n > LONGEST:
                raise ValueError("bad ordered lengths")
            lengths += [n] * count
            n += 1
    else:
        sparse = r.flag()
        if entries > r.left:
            raise ValueError("more entries than bits")
        for _ in range(entries):
            lengths.append(0 if sparse and not r.flag() else r.read(5) + 1)
    lookup = r.read(4)
    if lookup > 2:
        raise ValueError("unknown lookup")
    if not lookup:
        return Codebook(dimensions, lengths)
    minimum, delta, bits, cumulative = r.read(32), r.read(32), r.read(4) + 1, r.flag()
    count = lattice_values(entries, dimensions) if lookup == 1 else entries * dimensions
    if count * bits > r.left:
        raise ValueError("codebook values end early")
    return Codebook(dimensions, lengths, lookup, minimum, delta, cumulative, [r.read(bits) for _ in range(count)])


def build(counts: DataFrame, limit: int = LONGEST) -> DataFrame:
    """book, entry, length, codeword from rows (book, entry, count): one book is one group, of at most its entries."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entry")
        lengths = lengths_from_counts(group["count"].tolist(), limit)
        return pd.DataFrame({"book": group.book, "entry": group.entry, "length": lengths, "codeword": codewords(lengths)})

    return counts.groupBy("book").applyInPandas(run, "book bigint, entry bigint, length bigint, codeword bigint")
