"""Fixed-point arithmetic of the SILK layer on 32-bit words: NumPy arrays in, wrapping where the layer wraps."""

from __future__ import annotations

import numpy as np


def wrap(x) -> np.ndarray:
    """To a signed 32-bit word."""
    return (np.asarray(x, np.int64) + (1 << 31) & 0xFFFFFFFF) - (1 << 31)


def low(x) -> np.ndarray:
    """The signed low half of a word."""
    return (np.asarray(x, np.int64) + (1 << 15) & 0xFFFF) - (1 << 15)


def smulwb(a, b) -> np.ndarray:
    """A word times a low half, shifted down by 16."""
    return np.asarray(a, np.int64) * low(b) >> 16


def smlawb(c, a, b) -> np.ndarray:
    return wrap(np.asarray(c, np.int64) + smulwb(a, b))


def smulww(a, b) -> np.ndarray:
    return np.asarray(a, np.int64) * np.asarray(b, np.int64) >> 16


def smulbb(a, b) -> np.ndarray:
    return low(a) * low(b)


def shift_round(x, n: int) -> np.ndarray:
    """Down by n bits, halves toward plus infinity."""
    x = np.asarray(x, np.int64)
    return x if n == 0 else (x >> n - 1) + 1 >> 1


def saturate16(x) -> np.ndarray:
    return np.clip(np.asarray(x, np.int64), -(1 << 15), (1 << 15) - 1)


def leading_zeros(x) -> np.ndarray:
    x = np.asarray(x, np.int64) & 0xFFFFFFFF
    return np.where(x == 0, 32, 31 - np.floor(np.log2(np.maximum(x, 1) + 0.5)).astype(np.int64))


def log_to_linear(q7) -> np.ndarray:
    """Approximate 2^(q7 / 128): the fraction by a parabola, in integers."""
    q7 = np.asarray(q7, np.int64)
    whole, part = q7 >> 7, q7 & 127
    one = np.left_shift(np.int64(1), np.clip(whole, 0, 31))
    bend = part + (part * (128 - part) * -174 >> 16)
    near = np.where(q7 < 2048, one + (one * bend >> 7), one + (one >> 7) * bend)
    return np.where(q7 < 0, 0, np.where(q7 >= 3967, (1 << 31) - 1, near))


def saturate32(x) -> np.ndarray:
    return np.clip(np.asarray(x, np.int64), -(1 << 31), (1 << 31) - 1)


def _scaled(value: int, down: int) -> int:
    """Down by so many bits, or up, clamped to a word."""
    if down >= 0:
        return value >> down if down < 32 else 0
    return max(-(1 << 31) >> -down, min((1 << 31) - 1 >> -down, value)) << -down


def _reciprocal(b: int) -> tuple[int, int, int]:
    """A divisor brought to the top of a word, by how much, and its reciprocal to 14 bits."""
    up = 31 - abs(b).bit_length()
    top = b << up
    high = top >> 16
    return top, up, ((1 << 29) - 1) // abs(high) * (1 if high > 0 else -1)


def inverse(b: int, q: int) -> int:
    """About 2^q / b: a reciprocal to 14 bits and one correction, as the layer rounds it; 0 for 0."""
    if not b:
        return 0
    top, up, r = _reciprocal(b)
    error = (1 << 29) - int(smulwb(top, r)) << 3
    return _scaled(int(wrap((r << 16) + (error * r >> 16))), 61 - up - q)


def divide(a: int, b: int, q: int) -> int:
    """About 2^q a / b, in the same way."""
    if not b:
        return 0
    top, up, r = _reciprocal(b)
    high = 31 - abs(a).bit_length()
    over = a << high
    first = int(smulwb(over, r))
    rest = int(wrap(over - ((top * first >> 32) << 3)))
    return _scaled(int(smlawb(first, rest, r)), 29 + high - up - q)


def square_root(x: int) -> int:
    """About the square root: the power of two, then 7 bits of the fraction."""
    if x <= 0:
        return 0
    zeros = 32 - x.bit_length()
    y = (32768 if zeros % 2 else 46214) >> zeros // 2
    return y + (y * (213 * ((x << zeros) >> 24 & 127)) >> 16)


def next_random(seed: int) -> int:
    """Next state of the layer's noise generator, a signed word."""
    return int(wrap(907633515 + seed * 196314165))
