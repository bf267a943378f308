"""Pyramid vectors of the CELT layer: numbering of the vectors of n whole numbers with k as sum of magnitudes, and
the small transforms on bands."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def count(n: int, k: int) -> int:
    """V(n, k) = V(n - 1, k) + V(n, k - 1) + V(n - 1, k - 1)."""
    if k == 0:
        return 1
    if n == 0:
        return 0
    return count(n - 1, k) + count(n, k - 1) + count(n - 1, k - 1)


def index_bits(n: int, k: int) -> int:
    return (count(n, k) - 1).bit_length()


def decode(index: int, n: int, k: int) -> list[int]:
    """The vector of a number: at each place, vectors whose value there is not negative come first, larger
    magnitudes before smaller ones."""
    if not 0 <= index < count(n, k):
        raise ValueError("no such vector")
    out = []
    for left in range(n - 1, -1, -1):
        half = (count(left, k) + count(left + 1, k)) // 2
        sign = 1 if index < half else -1
        index -= 0 if sign > 0 else half
        low, rest = half - count(left, k), k
        while low > index:
            rest -= 1
            low -= count(left, rest)
        out.append(sign * (k - rest))
        index, k = index - low, rest
    return out


def encode(vector: list[int]) -> int:
    index, k = 0, sum(map(abs, vector))
    for place, v in enumerate(vector):
        left = len(vector) - 1 - place
        half = (count(left, k) + count(left + 1, k)) // 2
        if v < 0:
            index += half
        low = half - count(left, k) - sum(count(left, k - j) for j in range(1, abs(v) + 1))
        index, k = index + low, k - abs(v)
    return index


def normalise(v: np.ndarray, gain: float = 1.0) -> np.ndarray:
    size = float(np.sqrt(np.sum(np.asarray(v, np.float64) ** 2)))
    return (np.asarray(v, np.float64) * (gain / size if size else 0.0)).astype(np.float32)


def haar(x: np.ndarray, stride: int = 1) -> np.ndarray:
    """Sums and differences of neighbours, for each of ``stride`` interleaved parts; its own inverse."""
    pairs = np.asarray(x, np.float64).reshape(-1, 2, stride)
    low, high = pairs[:, 0], pairs[:, 1]
    return (np.stack([low + high, low - high], axis=1) * np.sqrt(0.5)).reshape(np.shape(x))


def noise(state: Column) -> Column:
    """Next state of the noise generator, modulo 2^32."""
    return (state.cast("long") * 1664525 + 1013904223) % (1 << 32)


def isqrt(x: int) -> int:
    """Floor of the square root."""
    import math

    return math.isqrt(x)


def band_energy(spectrum: Column, edges: list[int]) -> Column:
    """Root of the energy of each band of an array of coefficients."""
    bands = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b - a).alias("n")) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    return F.transform(bands, lambda b: F.sqrt(F.aggregate(F.slice(spectrum, b["a"] + 1, b["n"]), F.lit(1e-27), lambda e, x: e + x.cast("double") * x)))
