"""Native column functions on sampled signals: conversion, interleaving, differences, stereo modes, entropy costs.

Blocks are arrays (one row a block and channel); long signals are rows (stream, i, x) and use windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scale(depth: int) -> int:
    """Full scale of signed samples of 2 to 24 bits."""
    if not 2 <= depth <= 24:
        raise ValueError(f"depth {depth} is not between 2 and 24")
    return 1 << (depth - 1)


def from_int(x: Column, depth: int) -> Column:
    return x.cast("float") / F.lit(float(scale(depth))).cast("float")


def to_int(s: Column, depth: int) -> Column:
    """Rounds halves away from zero and clamps; the product is single precision, as samples are."""
    full = scale(depth)
    product = (s.cast("float") * F.lit(float(full)).cast("float")).cast("double")
    return F.least(F.greatest(F.round(product), F.lit(-full)), F.lit(full - 1)).cast("int")


def to_int16(s: Column) -> Column:
    """As to_int for 16 bits, but with a double precision product."""
    return F.least(F.greatest(F.round(s.cast("double") * 32768), F.lit(-32768)), F.lit(32767)).cast("int")


def interleave(channels: Column) -> Column:
    """Array of channel arrays to one array of frames."""
    frames = F.sequence(F.lit(1), F.size(channels[0]))
    return F.when(F.size(channels[0]) > 0, F.flatten(F.transform(frames, lambda i: F.transform(channels, lambda c: F.element_at(c, i.cast("int")))))).otherwise(F.slice(channels[0], 1, 0))


def deinterleave(samples: Column, channels: int) -> Column:
    """One array of whole frames to an array of channel arrays."""
    whole = F.when(F.size(samples) % channels == 0, samples).otherwise(F.raise_error(F.lit("samples are not whole frames")))

    def channel(c: int) -> Column:
        return F.filter(whole, lambda _, i: i % channels == c)

    return F.array(*map(channel, range(channels)))


def resize(samples: Column, frames: int) -> Column:
    """Keep the first frames, or add zeros."""
    return F.concat(F.slice(samples, 1, frames), F.array_repeat(samples[0] * 0, F.greatest(F.lit(frames) - F.size(samples), F.lit(0))))


def zigzag(v: Column) -> Column:
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 1, -(u + 1) / 2).otherwise(u / 2).cast("long")


def difference(order: int, x: str = "x", stream: str = "stream", place: str = "i") -> Column:
    """Finite difference of rows; null for the first ``order`` samples of a stream."""
    along = Window.partitionBy(stream).orderBy(place)
    return sum(((-1) ** k * math.comb(order, k) * (F.lag(x, k).over(along) if k else F.col(x)) for k in range(1, order + 1)), F.col(x))


def restore(frame: DataFrame, order: int, r: str = "r", stream: str = "stream", place: str = "i") -> DataFrame:
    """Undo ``order`` differences whose warm-up was taken against zeros, by as many running sums."""
    along = Window.partitionBy(stream).orderBy(place)
    for _ in range(order):
        frame = frame.withColumn(r, F.sum(r).over(along))
    return frame


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    return F.shiftright((left + right).cast("long"), 1), (left - right).cast("long")


def left_right(mid: Column, side: Column) -> tuple[Column, Column]:
    """The side's parity is the bit that the mid has lost."""
    twice = mid.cast("long") * 2 + F.abs(side % 2)
    return F.shiftright(twice + side, 1), F.shiftright(twice - side, 1)


def rice_cost(folded: Column, k: Column) -> Column:
    """Bits of an array of folded residuals with Rice parameter k."""
    return F.aggregate(folded, F.lit(0).cast("long"), lambda n, u: n + F.call_function("shiftright", u.cast("long"), k.cast("int")) + 1 + k)


def wasted_bits(samples: Column) -> Column:
    """Low bits that are zero in all samples of an array; 0 if all samples are zero."""
    union = F.aggregate(samples, F.lit(0).cast("long"), lambda o, x: o.bitwiseOR(x.cast("long")))
    return F.when(union == 0, 0).otherwise(F.bit_count(union.bitwiseAND(-union) - 1)).cast("int")


def tags_get(comments: Column, name: str) -> Column:
    """Values of the NAME=value comments of a name, in order; ASCII case does not matter."""
    found = F.filter(comments, lambda c: (F.locate("=", c) > 0) & (F.lower(F.substring_index(c, "=", 1)) == name.lower()))
    return F.transform(found, lambda c: F.substr(c, F.lit(len(name) + 2)))


def tags_first(comments: Column, name: str) -> Column:
    return F.coalesce(F.get(tags_get(comments, name), F.lit(0)), F.lit(""))


def tags_add(comments: Column, name: str, value: Column) -> Column:
    return F.array_append(comments, F.concat(F.lit(f"{name}="), value))


@dataclass(frozen=True)
class Format:
    """An uncompressed stream: samples a second and channels.  The depth belongs to a file, not to the stream."""

    rate: int
    channels: int

    def __post_init__(self):
        if self.rate <= 0 or self.channels <= 0:
            raise ValueError(f"no stream has {self}")

    def __str__(self) -> str:
        return f"{self.rate} Hz, {self.channels} ch"


def buffer(form: Format, frames: int) -> np.ndarray:
    """Silence: (channel, frame) of 32-bit floats."""
    if frames < 0:
        raise ValueError("a buffer cannot have fewer than no frames")
    return np.zeros((form.channels, frames), np.float32)


def check_buffer(form: Format, planes: list[np.ndarray]) -> int:
    """Frames of a buffer whose planes are as many as the format's channels and equally long."""
    if len(planes) != form.channels or len({len(p) for p in planes}) != 1:
        raise ValueError(f"{len(planes)} planes of {sorted({len(p) for p in planes})} frames for {form}")
    return len(planes[0])
