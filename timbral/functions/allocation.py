"""Bit allocation of the CELT layer of Opus (RFC 6716, section 4.3.3): what each band may take, boosts, tilt, the share
of every band between two rows of a quality table, the bands that are left out, and the split into fine energy and
shape.  Amounts are in eighths of a bit.

Two tables are parameters: ``quality`` (11 rows, each of 21 bands, in 1/32 bit a sample; they do not fall from row to
row) and ``most`` (a row of 21 for each frame size and number of channels: twice the size, plus the channels, less 1).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

from . import celt, rangecoder

BIT = 8
#: Fixed values of the format: chances of the tilt, in 1/128; what fine energy is behind shape, in eighths.
TILTS, BEHIND = (126, 124, 119, 109, 87, 41, 19, 9, 4, 2, 0), 21
_WIDTHS = np.diff(celt.EDGES)


def choice_cost(n: int) -> int:
    """Eighths of a bit of one of n equal choices, rounded up."""
    return math.ceil(BIT * math.log2(n) - 1e-9)


def caps(most: np.ndarray, size: int, channels: int) -> np.ndarray:
    """The most that shape can use in each band."""
    return (np.asarray(most[2 * size + channels - 1], np.int64) + 64) * channels * (_WIDTHS << size) >> 2


def boosts(coder: rangecoder.Decoder, bands: range, size: int, channels: int, cap: np.ndarray, total: int) -> np.ndarray:
    """What bands get beforehand, by runs of flags: the first of a band is unlikely, those after it cost a bit, and each
    band that has one makes it likelier for the next."""
    out, chance = np.zeros(celt.BANDS, np.int64), 6
    for i in bands:
        width = channels * len(celt.band_bins(i, size))
        step, cost = min(8 * width, max(6 * BIT, width)), chance
        while coder.tell_eighths() + BIT * cost < total and out[i] < cap[i] and coder.bit(cost):
            out[i] += step
            total -= step
            cost = 1
        if out[i]:
            chance = max(2, chance - 1)
    return out


def tilt(coder: rangecoder.Decoder, total: int) -> int:
    """0 to 10, from low to high bands; 5, level, where six bits are not left."""
    return coder.symbol(TILTS, 7) if coder.tell_eighths() + 6 * BIT <= total else 5


def tilts(bands: range, way: int, size: int, channels: int) -> np.ndarray:
    """What a tilt adds to each band, in proportion to the bands above it; bands of one bin get a bit less."""
    above = bands.stop - 1 - np.arange(celt.BANDS)
    out = channels * _WIDTHS * (way - 5 - size) * above * (1 << size + 3) >> 6
    return out - np.where(_WIDTHS << size == 1, channels * BIT, 0)


@dataclass
class Allocation:
    shape: np.ndarray
    fine: np.ndarray  # whole bits for each channel
    priority: np.ndarray  # of a last digit: 0 first
    coded: int  # the first band without shape
    intensity: int = 0
    dual: bool = False
    balance: int = 0


def _granted(want: np.ndarray, least: np.ndarray, most: np.ndarray, floor: int) -> np.ndarray:
    """From the top, bands below the first that has its least get what they want; those above it a floor or nothing."""
    reached = np.logical_or.accumulate((want >= least)[::-1])[::-1]
    return np.where(reached, np.minimum(want, most), np.where(want >= floor, floor, 0))


def allocate(coder: rangecoder.Decoder, bands: range, boost: np.ndarray, cap: np.ndarray, way: int, total: int, size: int, channels: int, quality: np.ndarray) -> Allocation:
    """The allocation of a frame with ``total`` left."""
    own, floor = slice(bands.start, bands.stop), channels * BIT
    width, extra, most = _WIDTHS[own], np.asarray(boost, np.int64)[own], np.asarray(cap, np.int64)[own]
    total = max(total, 0)
    # flags are paid for before the bands
    end_flag = BIT if total >= BIT else 0
    total -= end_flag
    place = dual = 0
    if channels == 2 and choice_cost(len(bands) + 1) <= total:
        place = choice_cost(len(bands) + 1)
        dual = BIT if total - place >= BIT else 0
        total -= place + dual
    least = np.maximum(floor, 3 * (width << size) * BIT >> 4)
    lean = tilts(bands, way, size, channels)[own]

    def leaned(bits: np.ndarray) -> np.ndarray:
        return np.where(bits > 0, np.maximum(0, bits + lean), bits)

    rows = [leaned(channels * width * np.asarray(row, np.int64)[own] << size >> 2) for row in quality]
    row = bisect_right(range(1, len(rows)), total, key=lambda k: int(_granted(rows[k] + extra, least, most, floor).sum()))
    low = rows[row] + (extra if row else 0)
    high = (rows[row + 1] if row + 1 < len(rows) else leaned(most)) + extra
    span = np.maximum(0, high - low)
    share = bisect_right(range(1, 64), total, key=lambda k: int(_granted(low + (k * span >> 6), least, most, floor).sum()))
    shape = np.minimum(_granted(low + (share * span >> 6), least, most, floor), most)
    out = Allocation(np.zeros(celt.BANDS, np.int64), np.zeros(celt.BANDS, np.int64), np.zeros(celt.BANDS, np.int64), bands.stop)

    # bands are left out from the top, but never the first, nor one that was boosted
    used, last_boost = int(shape.sum()), int(np.max(np.nonzero(extra)[0], initial=0))
    edge = np.concatenate([[0], np.cumsum(width)]).tolist()
    n = len(bands)
    while n - 1 > last_boost:
        top = n - 1
        each = int((total - used) / edge[n])
        rest = total - used - each * edge[n]
        has = int(shape[top]) + each * int(width[top]) + max(rest - edge[top], 0)
        if has >= max(int(least[top]), floor + BIT):
            if coder.bit(1):
                break
            used += BIT
            has -= BIT
        used -= int(shape[top]) + place
        place = choice_cost(top + 1) if place else 0
        shape[top] = floor if has >= floor else 0
        used += place + int(shape[top])
        n = top
    else:
        total += end_flag
    out.coded = bands.start + n
    if place:
        out.intensity = bands.start + coder.uniform(n + 1)
    if out.intensity <= bands.start:
        total += dual
    elif dual:
        out.dual = bool(coder.bit(1))

    # what is left goes to the coded bands evenly by bins, then from the lowest bin up
    each = int((total - used) / edge[n])
    rest = total - used - each * edge[n]
    shape[:n] += each * width[:n] + np.clip(rest - np.array(edge[:n]), 0, width[:n])
    for i in range(n):
        _split(out, bands.start + i, int(shape[i]), int(most[i]), size, channels)
    for i in range(n, len(bands)):
        at = bands.start + i
        out.fine[at] = int(shape[i]) >> channels - 1 >> 3
        out.priority[at] = int(out.fine[at] < 1)
    return out


def _split(out: Allocation, at: int, has: int, most: int, size: int, channels: int) -> None:
    """Fine energy and shape of a coded band; what neither can use goes to the next one."""
    n, has, before = int(_WIDTHS[at]) << size, has + out.balance, out.balance
    if n == 1:
        over = max(0, has - channels * BIT)
        shape, fine, late = has - over, 0, 1
    else:
        over = max(has - most, 0)
        has -= over
        parts = channels * n + (channels == 2 and n > 2 and not out.dual and at < out.intensity)
        scale = parts * (choice_cost(int(_WIDTHS[at])) + BIT * size)
        offset = (scale >> 1) - parts * BEHIND + (2 * parts if n == 2 else 0)
        if has + offset < 2 * parts * BIT:
            offset += scale >> 2
        elif has + offset < 3 * parts * BIT:
            offset += scale >> 3
        fine = max(0, (has + offset + 4 * parts) // (parts * BIT))
        if channels * fine > has >> 3:
            fine = has >> channels - 1 >> 3
        fine = min(fine, celt.MOST_FINE)
        late = int(fine * parts * BIT >= has + offset)
        shape = has - channels * fine * BIT
    if over:
        more = min(over >> channels + 2, celt.MOST_FINE - fine)
        fine += more
        late = int(more * channels * BIT >= over - before)
        over -= more * channels * BIT
    out.shape[at], out.fine[at], out.priority[at], out.balance = shape, fine, late, over
