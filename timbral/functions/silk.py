"""Parts of the SILK layer of Opus (RFC 6716, section 4.2, with the corrections of RFC 8251): packet flags, the indices
of a frame, pulses, line spectra, pitch, synthesis of one channel, stereo and the step up to 48 kHz.

A coder is a ``rangecoder`` object.  Tables of over 200 values are parameters: the line-spectral codebooks
(``Spectra``) and the splits of pulses (``shells``: for halves of 2, 4, 8 and 16 samples, by total, the chances of what
the first half gets).  Chances are lists of what lies above a symbol, in 1/256.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from . import fixed, rangecoder

INACTIVE, UNVOICED, VOICED = 0, 1, 2
Chances = Sequence[int]

#: Fixed values of the format: which of two or three frames have a redundant copy; type and offset of an active and of
#: an inactive frame.
COPIES = {2: (203, 150, 0), 3: (215, 195, 166, 125, 110, 82, 0)}
ACTIVE_TYPE, INACTIVE_TYPE = (232, 158, 10, 0), (230, 0)
#: High bits of a first gain by signal type, and a change of gain.
GAIN_HIGH = ((224, 112, 44, 15, 3, 2, 1, 0), (254, 237, 192, 132, 70, 23, 4, 0), (255, 252, 226, 155, 61, 11, 2, 0))
GAIN_STEP = (250, 245, 234, 203, 71, 50, 42, 38, 35, 33, 31, 29, 28, 27, 26, 25, 24, 23, 22, 21, 20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)
#: A residual beyond its book, and the quarters of the way from the spectrum before.
BEYOND, QUARTERS = (100, 40, 16, 7, 3, 1, 0), (243, 221, 192, 181, 0)
#: A change of lag, the high bits of a lag, and the contour by (narrow band, subframes).
LAG_STEP = (210, 208, 206, 203, 199, 193, 183, 168, 142, 104, 74, 52, 37, 27, 20, 14, 10, 6, 4, 2, 0)
LAG_HIGH = (253, 250, 244, 233, 212, 182, 150, 131, 120, 110, 98, 85, 72, 60, 49, 40, 32, 25, 19, 15, 13, 11, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)
CONTOUR = {
    (True, 4): (188, 176, 155, 138, 119, 97, 67, 43, 26, 10, 0),
    (True, 2): (113, 63, 0),
    (False, 4): (223, 201, 183, 167, 152, 138, 124, 111, 98, 88, 79, 70, 62, 56, 50, 44, 39, 35, 31, 27, 24, 21, 18, 16, 14, 12, 10, 8, 6, 4, 3, 2, 1, 0),
    (False, 2): (165, 119, 80, 61, 47, 35, 27, 20, 14, 9, 4, 0),
}
#: How far each subframe's lag is from the frame's, by the same key: a row for each subframe.
DRIFT = {
    (True, 4): (
        (0, 2, -1, -1, -1, 0, 0, 1, 1, 0, 1),
        (0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0),
        (0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0),
        (0, -1, 2, 1, 0, 1, 1, 0, 0, -1, -1),
    ),
    (True, 2): ((0, 1, 0), (0, 0, 1)),
    (False, 4): (
        (0, 0, 1, -1, 0, 1, -1, 0, -1, 1, -2, 2, -2, -2, 2, -3, 2, 3, -3, -4, 3, -4, 4, 4, -5, 5, -6, -5, 6, -7, 6, 5, 8, -9),
        (0, 0, 1, 0, 0, 0, 0, 0, 0, 0, -1, 1, 0, 0, 1, -1, 0, 1, -1, -1, 1, -1, 2, 1, -1, 2, -2, -2, 2, -2, 2, 2, 3, -3),
        (0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, -1, 1, 0, 0, 2, 1, -1, 2, -1, -1, 2, -1, 2, 2, -1, 3, -2, -2, -2, 3),
        (0, 1, 0, 0, 1, 0, 1, -1, 2, -1, 2, -1, 2, 3, -2, 3, -2, -2, 4, 4, -3, 5, -3, -4, 6, -4, 6, 5, -5, 8, -6, -5, -7, 9),
    ),
    (False, 2): ((0, 0, 1, -1, 1, -1, 2, -2, 2, -2, 3, -3), (0, 1, 0, 1, -1, 2, -1, 2, -2, 3, -2, 3)),
}
#: Which book of taps, the chances of its entries, and the entries in 1/128.
TAP_BOOK = (179, 99, 0)
TAP_ENTRY = (
    (71, 56, 43, 30, 21, 12, 6, 0),
    (199, 165, 144, 124, 109, 96, 84, 71, 61, 51, 42, 32, 23, 15, 8, 0),
    (241, 225, 211, 199, 187, 175, 164, 153, 142, 132, 123, 114, 105, 96, 88, 80, 72, 64, 57, 50, 44, 38, 33, 29, 24, 20, 16, 12, 9, 5, 2, 0),
)
TAPS = (
    ((4, 6, 24, 7, 5), (0, 0, 2, 0, 0), (12, 28, 41, 13, -4), (-9, 15, 42, 25, 14), (1, -2, 62, 41, -9), (-10, 37, 65, -4, 3), (-6, 4, 66, 7, -8), (16, 14, 38, -3, 33)),
    (
        (13, 22, 39, 23, 12), (-1, 36, 64, 27, -6), (-7, 10, 55, 43, 17), (1, 1, 8, 1, 1), (6, -11, 74, 53, -9), (-12, 55, 76, -12, 8), (-3, 3, 93, 27, -4), (26, 39, 59, 3, -8),
        (2, 0, 77, 11, 9), (-8, 22, 44, -6, 7), (40, 9, 26, 3, 9), (-7, 20, 101, -7, 4), (3, -8, 42, 26, 0), (-15, 33, 68, 2, 23), (-2, 55, 46, -2, 15), (3, -1, 21, 16, 41),
    ),
    (
        (-6, 27, 61, 39, 5), (-11, 42, 88, 4, 1), (-2, 60, 65, 6, -4), (-1, -5, 73, 56, 1), (-9, 19, 94, 29, -9), (0, 12, 99, 6, 4), (8, -19, 102, 46, -13), (3, 2, 13, 3, 2),
        (9, -21, 84, 72, -18), (-11, 46, 104, -22, 8), (18, 38, 48, 23, 0), (-16, 70, 83, -21, 11), (5, -11, 117, 22, -8), (-6, 23, 117, -12, 3), (3, -8, 95, 28, 4), (-10, 15, 77, 60, -15),
        (-1, 4, 124, 2, -4), (3, 38, 84, 24, -25), (2, 13, 42, 13, 31), (21, -4, 56, 46, -1), (-1, 35, 79, -13, 19), (-7, 65, 88, -9, -14), (20, 4, 81, 49, -29), (20, 0, 75, 3, -17),
        (5, -9, 44, 92, -8), (1, -3, 22, 69, 31), (-6, 95, 41, -12, 5), (39, 67, 16, -4, 1), (0, -6, 120, 55, -36), (-13, 44, 122, 4, -24), (81, 5, 11, 3, 7), (2, 0, 9, 10, 88),
    ),
)
#: How much of the frame before comes in, its chances and its sizes in 1/16384.
CARRY, CARRIED = (128, 64, 0), (15565, 12288, 8192)
#: Rate level of an unvoiced and a voiced frame; pulses of a block of 16 by level, 17 for "more".
RATE_LEVEL = ((241, 190, 178, 132, 87, 74, 41, 14, 0), (223, 193, 157, 140, 106, 57, 39, 18, 0))
PULSES = (
    (125, 51, 26, 18, 15, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
    (198, 105, 45, 22, 15, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
    (213, 162, 116, 83, 59, 43, 32, 24, 18, 15, 12, 9, 7, 6, 5, 3, 2, 0),
    (239, 187, 116, 59, 28, 16, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
    (250, 229, 188, 135, 86, 51, 30, 19, 13, 10, 8, 6, 5, 4, 3, 2, 1, 0),
    (249, 235, 213, 185, 156, 128, 103, 83, 66, 53, 42, 33, 26, 21, 17, 13, 10, 0),
    (254, 249, 235, 206, 164, 118, 77, 46, 27, 16, 10, 7, 5, 4, 3, 2, 1, 0),
    (255, 253, 249, 239, 220, 191, 156, 119, 85, 57, 37, 23, 15, 10, 6, 4, 2, 0),
    (255, 253, 251, 246, 237, 223, 203, 179, 152, 124, 98, 75, 55, 40, 29, 21, 15, 0),
    (255, 254, 253, 247, 220, 162, 106, 67, 42, 28, 18, 12, 9, 6, 4, 3, 2, 0),
)
#: Chance of a low bit; of a minus by 7 classes of pulses, for each type and offset.
LOW_BIT = (120, 0)
MINUS = (254, 49, 67, 77, 82, 93, 99, 198, 11, 18, 24, 31, 36, 45, 255, 46, 66, 78, 87, 94, 104, 208, 14, 21, 32, 42, 51, 66, 255, 94, 104, 109, 112, 115, 118, 248, 53, 69, 80, 88, 95, 102)
#: Cosines at 1/128 of half a turn, in 1/4096 of a half; the second quarter mirrors the first.
_QUARTER = (
    8192, 8190, 8182, 8170, 8152, 8130, 8104, 8072, 8034, 7994, 7946, 7896, 7840, 7778, 7714, 7644,
    7568, 7490, 7406, 7318, 7226, 7128, 7026, 6922, 6812, 6698, 6580, 6458, 6332, 6204, 6070, 5934,
    5792, 5648, 5502, 5352, 5198, 5040, 4880, 4718, 4552, 4382, 4212, 4038, 3862, 3684, 3502, 3320,
    3136, 2948, 2760, 2570, 2378, 2186, 1990, 1794, 1598, 1400, 1202, 1002, 802, 602, 402, 202, 0,
)
COSINES = np.array(_QUARTER + tuple(-v for v in _QUARTER[-2::-1]), np.int64)
#: Place of each line among the factors of the two polynomials, by order.
FACTORS = {10: (0, 9, 6, 3, 4, 5, 8, 1, 2, 7), 16: (0, 15, 8, 7, 4, 11, 12, 3, 2, 13, 10, 5, 6, 9, 14, 1)}
#: Levels of the stereo weights in 1/8192, their joint chances, and the flag of a missing side.
WEIGHTS = (-13732, -10050, -8266, -7526, -6500, -5000, -2950, -820, 820, 2950, 5000, 6500, 7526, 8266, 10050, 13732)
WEIGHT_PAIR = (249, 247, 246, 245, 244, 234, 210, 202, 201, 200, 197, 174, 82, 59, 56, 55, 54, 46, 22, 12, 11, 10, 9, 7, 0)
NO_SIDE = (64, 0)
#: All-pass sections of the two phases, the interpolator's half filters, and the samples held back.
PHASES = ((1746, 14986, -26453), (6854, 25769, -9994))
HALF_FILTERS = np.array(
    [
        (189, -600, 617, 30567), (117, -159, -1070, 29704), (52, 221, -2392, 28276), (-4, 529, -3350, 26341), (-48, 758, -3956, 23973), (-80, 905, -4235, 21254),
        (-99, 972, -4222, 18278), (-107, 967, -3957, 15143), (-103, 896, -3487, 11950), (-91, 773, -2865, 8798), (-71, 611, -2143, 5784), (-46, 425, -1375, 2996),
    ],
    np.int64,
)
HELD_BACK = {8: 0, 12: 4, 16: 7}
#: What pulls a pulse to zero, and the bias by (voiced, offset type), in 1/1024.
PULL, BIAS = 80, ((100, 240), (32, 100))
#: The greatest reflection in 1/2^24, and the least inverse gain in 1/2^30, of a stable filter.
MOST_REFLECTION, LEAST_INVERSE_GAIN = 16773022, 107374


def uniform(n: int) -> tuple[int, ...]:
    """Chances of n equal symbols."""
    return tuple(round(256 * (n - 1 - k) / n) for k in range(n))


def even_shells() -> list[list[tuple[int, ...]]]:
    """Splits in which each pulse goes to either half with equal chance: a stand-in for the format's own."""

    def row(total: int) -> tuple[int, ...]:
        parts = [1 + (255 - total) * math.comb(total, k) // (1 << total) for k in range(total + 1)]
        parts[total // 2] += 256 - sum(parts)
        return tuple(sum(parts[k + 1 :]) for k in range(total + 1))

    return [[row(total) for total in range(17)]] * 4


# Packets -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a packet divides: kHz of the layer, milliseconds of the packet, channels."""

    rate: int
    ms: int
    channels: int = 1

    def __post_init__(self):
        if self.rate not in HELD_BACK or self.ms not in (10, 20, 40, 60) or self.channels not in (1, 2):
            raise ValueError(f"no packet has {self}")

    @property
    def frames(self) -> int:
        return max(self.ms // 20, 1)

    @property
    def subframes(self) -> int:
        return 2 if self.ms == 10 else 4

    @property
    def part(self) -> int:
        """Samples of a subframe."""
        return 5 * self.rate

    @property
    def samples(self) -> int:
        """Samples of a frame."""
        return self.subframes * self.part

    @property
    def order(self) -> int:
        return 16 if self.rate == 16 else 10

    @property
    def pitch(self) -> tuple[bool, int]:
        return self.rate == 8, self.subframes


def header(coder: rangecoder.Decoder, layout: Layout) -> tuple[list[list[bool]], list[list[bool]]]:
    """(active, copied) by channel and frame.  All activity flags come first, each channel's with a flag that it has
    redundant copies; then which frames have one."""
    flags = [[coder.bit(1) for _ in range(layout.frames + 1)] for _ in range(layout.channels)]
    copied = []
    for *_, any_copy in flags:
        mask = 0
        if any_copy:
            mask = 1 if layout.frames == 1 else coder.symbol(COPIES[layout.frames], 8) + 1
        copied.append([bool(mask >> k & 1) for k in range(layout.frames)])
    return [f[:-1] for f in flags], copied


# Pulses --------------------------------------------------------------------------------------


def _spread(coder: rangecoder.Decoder, total: int, n: int, shells: Sequence) -> list[int]:
    if n == 1 or not total:
        return [total] * n if n == 1 else [0] * n
    first = coder.symbol(shells[n.bit_length() - 2][total], 8)
    return _spread(coder, first, n // 2, shells) + _spread(coder, total - first, n // 2, shells)


def _sign_chance(kind: int, offset: int, total: int) -> Chances:
    return MINUS[7 * (2 * kind + offset) + min(total, 6)], 0


def pulses(coder: rangecoder.Decoder, kind: int, offset: int, n: int, shells: Sequence) -> list[int]:
    """Whole numbers of a frame: blocks of 16, each as a total that is halved down to samples, low bits, signs."""
    level = coder.symbol(RATE_LEVEL[kind == VOICED], 8)
    totals, low_bits = [], []
    for _ in range(-(-n // 16)):
        total, more = coder.symbol(PULSES[level], 8), 0
        while total == 17:
            more += 1
            total = coder.symbol(PULSES[-1][more == 10 :], 8)
        totals.append(total)
        low_bits.append(more)
    blocks = [_spread(coder, total, 16, shells) for total in totals]
    for block, more in zip(blocks, low_bits, strict=True):
        for k in range(16 if more else 0):
            for _ in range(more):
                block[k] = 2 * block[k] + coder.symbol(LOW_BIT, 8)
    for block, total, more in zip(blocks, totals, low_bits, strict=True):
        chance = _sign_chance(kind, offset, total)
        for k in range(16 if total or more else 0):
            if block[k] and not coder.symbol(chance, 8):
                block[k] = -block[k]
    return [v for block in blocks for v in block][:n]


def encode_pulses(coder: rangecoder.Encoder, values: Sequence[int], kind: int, offset: int, shells: Sequence, level: int = 0) -> None:
    """The inverse; a block may need ten low bits at most."""
    blocks = [[*values[at : at + 16], *[0] * (at + 16 - len(values))] for at in range(0, len(values), 16)]
    coder.symbol(level, RATE_LEVEL[kind == VOICED], 8)
    shapes = []
    for block in blocks:
        more = next(k for k in range(11) if sum(abs(v) >> k for v in block) <= 16)
        for k in range(more + 1):
            coder.symbol(17 if k < more else sum(abs(v) >> more for v in block), PULSES[-1][k == 10 :] if k else PULSES[level], 8)
        shapes.append((more, [abs(v) >> more for v in block]))

    def spread(part: list[int]) -> None:
        if len(part) > 1 and any(part):
            half = part[: len(part) // 2]
            coder.symbol(sum(half), shells[len(part).bit_length() - 2][sum(part)], 8)
            spread(half)
            spread(part[len(half) :])

    for _, shape in shapes:
        spread(shape)
    for block, (more, _) in zip(blocks, shapes, strict=True):
        for v in block:
            for k in reversed(range(more)):
                coder.symbol(abs(v) >> k & 1, LOW_BIT, 8)
    for block, (_, shape) in zip(blocks, shapes, strict=True):
        for v in filter(None, block):
            coder.symbol(int(v > 0), _sign_chance(kind, offset, sum(shape)), 8)


# Line spectra --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spectra:
    """A two-stage book of line spectra, of order 10 or 16."""

    coarse: np.ndarray  # (vectors, order), in 1/256 of the band
    chances: tuple[Chances, Chances]  # of a vector, unless voiced and if voiced
    choice: np.ndarray  # (vectors, order): twice the residual's distribution, plus 1 for the second set of weights
    weights: np.ndarray  # (2, order - 1): what a residual takes of the one above it, in 1/256
    residuals: tuple[Chances, ...]  # distributions of residuals -4 to 4
    step: int  # in 1/65536
    spacing: tuple[int, ...]  # least distances of the order + 1 gaps, in 1/32768 of the band


def residual_lines(steps: Sequence[int], weights: Sequence[int], step: int) -> np.ndarray:
    """Residuals from the highest down: a step with a dead zone, plus a share of the one above."""
    out, above = [], 0
    for v, w in zip(reversed(steps), reversed(weights), strict=True):
        size = 1024 * v - 102 * ((v > 0) - (v < 0))
        above = int(fixed.smlawb(fixed.smulbb(above, w) >> 8, size, step))
        out.append(above)
    return np.array(out[::-1], np.int64)


def sensitivity(lines: np.ndarray) -> np.ndarray:
    """Weight of each line: the sum of the inverse gaps at its sides."""
    near = (1 << 17) // np.maximum(np.diff(lines, prepend=0, append=1 << 15), 1)
    return np.minimum(near[:-1] + near[1:], 32767)


def stabilise(lines: Sequence[int], spacing: Sequence[int]) -> np.ndarray:
    """Move the two lines that are closest for their spacing apart about their middle, up to 20 times; if that is not
    enough, sort and push up, then down."""
    x, top, n = [int(v) for v in lines], 1 << 15, len(lines)
    for _ in range(20):
        slack = np.diff([0, *x, top]) - np.array(spacing)
        at = int(np.argmin(slack))
        if slack[at] >= 0:
            return np.array(x, np.int64)
        need = spacing[at]
        if at == 0:
            x[0] = need
        elif at == n:
            x[-1] = top - need
        else:
            least, most = sum(spacing[:at]) + (need >> 1), top - sum(spacing[at + 1 :]) - (need >> 1)
            x[at - 1] = max(least, min(most, x[at - 1] + x[at] + 1 >> 1)) - (need >> 1)
            x[at] = x[at - 1] + need
    x.sort()
    for k in range(n):
        x[k] = max(x[k], min((x[k - 1] if k else 0) + spacing[k], 32767))
    for k in reversed(range(n)):
        x[k] = min(x[k], (x[k + 1] if k + 1 < n else top) - spacing[k + 1])
    return np.array(x, np.int64)


def lines(entry: int, steps: Sequence[int], book: Spectra) -> np.ndarray:
    """A line spectrum in 1/32768 of the band: residuals count less where lines are close."""
    base = np.asarray(book.coarse[entry], np.int64) << 7
    own = [int(book.weights[c & 1][i]) if i < len(steps) - 1 else 0 for i, c in enumerate(book.choice[entry])]
    found = residual_lines(steps, own, book.step)
    scale = [fixed.square_root(int(w) << 16) for w in sensitivity(base)]
    moved = [int(b) + (abs(int(r)) << 14) // s * (1 if r > 0 else -1) for b, r, s in zip(base, found, scale, strict=True)]
    return stabilise(np.clip(moved, 0, 32767).tolist(), book.spacing)


def _product(cosines: np.ndarray) -> np.ndarray:
    """Lower half of the product of 1 - c z + z^2, a palindrome, in 1/65536."""
    p = np.array([1 << 16, -cosines[0]], np.int64)
    for c in cosines[1:]:
        wide = np.append(p, p[-2])
        once, twice = np.append(0, wide[:-1]), np.append([0, 0], wide[:-2])
        p = fixed.wrap(wide + twice - fixed.shift_round(c * once, 16))
    return p


def _chirp(a: np.ndarray, q16: int) -> np.ndarray:
    """Pull the roots of a filter inward."""
    out, now = [], q16
    for v in a:
        out.append(int(fixed.smulww(now, v)))
        now += int(fixed.shift_round(now * (q16 - 65536), 16))
    return np.array(out, np.int64)


def inverse_gain(a: np.ndarray) -> int:
    """Inverse of the prediction gain of a filter in 1/4096, in 1/2^30; 0 if it is unstable.  The filter is stepped down
    order by order; a reflection of one or more ends it."""
    if int(np.sum(a)) >= 4096:
        return 0
    x, gain = np.asarray(a, np.int64) << 12, 1 << 30
    while len(x):
        last, rest = int(x[-1]), x[:-1]
        if abs(last) > MOST_REFLECTION:
            return 0
        r = -(last << 7)
        left = (1 << 30) - (r * r >> 32)
        gain = (gain * left >> 32) << 2
        if len(rest):
            q = left.bit_length()
            mixed = fixed.saturate32(rest - fixed.shift_round(rest[::-1] * r, 31))
            rest = fixed.shift_round(mixed * fixed.inverse(left, q + 30), q)
            if (rest != fixed.saturate32(rest)).any():
                return 0
        x = rest
    return gain


def filter_of(spectrum: np.ndarray) -> np.ndarray:
    """Prediction filter in 1/4096 of a line spectrum: two polynomials with the lines as roots, then wider bands until it
    fits in 16 bits and is stable."""
    n = len(spectrum)
    whole, part = np.asarray(spectrum, np.int64) >> 8, np.asarray(spectrum, np.int64) & 255
    cosines = np.empty(n, np.int64)
    cosines[list(FACTORS[n])] = fixed.shift_round((COSINES[whole] << 8) + (COSINES[whole + 1] - COSINES[whole]) * part, 4)
    p, q = _product(cosines[0::2]), _product(cosines[1::2])
    even, odd = p[1:] + p[:-1], q[1:] - q[:-1]
    a = fixed.wrap(np.concatenate([-odd - even, (odd - even)[::-1]]))
    for _ in range(10):
        at = int(np.argmax(np.abs(a)))
        largest = int(fixed.shift_round(abs(int(a[at])), 5))
        if largest <= 32767:
            break
        largest = min(largest, 163838)
        a = _chirp(a, 65471 - ((largest - 32767) << 14) // (largest * (at + 1) >> 2))
    else:
        a = fixed.saturate16(fixed.shift_round(a, 5)) << 5
    out = fixed.saturate16(fixed.shift_round(a, 5))
    for k in range(16):
        if inverse_gain(out) >= LEAST_INVERSE_GAIN:
            break
        a = _chirp(a, 65536 - (2 << k))
        out = fixed.low(fixed.shift_round(a, 5))
    return out


# Gains and pitch -----------------------------------------------------------------------------


def gains(indices: Sequence[int], level: int, after_another: bool) -> tuple[list[int], int]:
    """Gains in 1/65536 and the last level.  A first index may fall by 16 levels at most; steps above a bound count
    double."""
    out = []
    for k, index in enumerate(indices):
        if k or after_another:
            step, bound = index - 4, 8 + level
            level += 2 * step - bound if step > bound else step
        else:
            level = max(index, level - 16)
        level = max(0, min(63, level))
        out.append(int(fixed.log_to_linear(min((1907825 * level >> 16) + 2090, 3967))))
    return out, level


def lags(index: int, contour: int, layout: Layout) -> list[int]:
    """Lag of each subframe: the frame's, from 2 ms on, plus its contour, within 2 to 18 ms."""
    least, most = 2 * layout.rate, 18 * layout.rate
    return [max(least, min(most, least + index + row[contour])) for row in DRIFT[layout.pitch]]


def taps(book: int, entries: Sequence[int]) -> np.ndarray:
    """Five taps for each subframe, in 1/16384."""
    return np.array([TAPS[book][e] for e in entries], np.int64) << 7


# Indices -------------------------------------------------------------------------------------


@dataclass
class Indices:
    kind: int
    offset: int
    gains: list[int]
    entry: int
    steps: list[int]
    quarters: int = 4
    lag: int = 0
    contour: int = 0
    book: int = 0
    taps: list[int] = field(default_factory=list)
    carry: int = 0
    seed: int = 0


def _steps(coder: rangecoder.Decoder, rows: Sequence[int], book: Spectra) -> list[int]:
    out = []
    for row in rows:
        v = coder.symbol(book.residuals[row], 8) - 4
        if abs(v) == 4:
            v += (1 if v > 0 else -1) * coder.symbol(BEYOND, 8)
        out.append(v)
    return out


def indices(coder: rangecoder.Decoder, layout: Layout, book: Spectra, active: bool, before: Indices | None = None) -> Indices:
    """A frame's choices.  ``before``: the frame that gain and lag may be coded against, if they are; ``active`` also
    for a redundant copy."""
    kind, offset = divmod(coder.symbol(ACTIVE_TYPE, 8) + 2 if active else coder.symbol(INACTIVE_TYPE, 8), 2)
    first = coder.symbol(GAIN_STEP, 8) if before else 8 * coder.symbol(GAIN_HIGH[kind], 8) + coder.symbol(uniform(8), 8)
    own = [first, *(coder.symbol(GAIN_STEP, 8) for _ in range(layout.subframes - 1))]
    entry = coder.symbol(book.chances[kind == VOICED], 8)
    out = Indices(kind, offset, own, entry, _steps(coder, [int(c) >> 1 for c in book.choice[entry]], book))
    if layout.subframes == 4:
        out.quarters = coder.symbol(QUARTERS, 8)
    if kind == VOICED:
        moved = coder.symbol(LAG_STEP, 8) if before and before.kind == VOICED else 0
        out.lag = before.lag + moved - 9 if moved else coder.symbol(LAG_HIGH, 8) * (layout.rate // 2) + coder.symbol(uniform(layout.rate // 2), 8)
        out.contour = coder.symbol(CONTOUR[layout.pitch], 8)
        out.book = coder.symbol(TAP_BOOK, 8)
        out.taps = [coder.symbol(TAP_ENTRY[out.book], 8) for _ in range(layout.subframes)]
        out.carry = 0 if before else coder.symbol(CARRY, 8)
    out.seed = coder.symbol(uniform(4), 8)
    return out


# Synthesis -----------------------------------------------------------------------------------


def excitation(values: Sequence[int], kind: int, offset: int, seed: int) -> list[int]:
    """Pulses in 1/16384, pulled to zero, biased away from it, with signs from a generator that they feed."""
    bias, out = BIAS[kind == VOICED][offset] << 4, []
    for v in values:
        seed = fixed.next_random(seed)
        size = (v << 14) - (PULL << 4) * ((v > 0) - (v < 0)) + bias
        out.append(-size if seed < 0 else size)
        seed = int(fixed.wrap(seed + v))
    return out


def whiten(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What a filter in 1/4096 leaves of samples; the first ones, without a whole past, are 0."""
    n, x = len(a), np.asarray(x, np.int64)
    out = np.zeros(len(x), np.int64)
    if len(x) > n:
        past = np.lib.stride_tricks.sliding_window_view(x[:-1], n)[:, ::-1]
        out[n:] = fixed.saturate16(fixed.shift_round(fixed.wrap((x[n:] << 12) - past @ a), 12))
    return out


class Channel:
    """One channel from frame to frame: past output, filter memory, gain level and line spectrum."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.memory = 20 * layout.rate
        self.past = np.zeros(self.memory, np.int64)
        self.state = [0] * layout.order
        self.gain, self.level, self.spectrum = 65536, 10, None

    def filters(self, ix: Indices, book: Spectra) -> list[np.ndarray]:
        """Filters of the two halves of a frame: the first may be part of the way from the spectrum before."""
        now = lines(ix.entry, ix.steps, book)
        last = filter_of(now)
        first = last
        if ix.quarters < 4 and self.spectrum is not None:
            first = filter_of(self.spectrum + (ix.quarters * (now - self.spectrum) >> 2))
        elif ix.quarters < 4:
            ix.quarters = 4
        self.spectrum = now
        return [first, last]

    def frame(self, ix: Indices, values: Sequence[int], book: Spectra, after_another: bool = False) -> np.ndarray:
        """Samples of a frame from its indices and pulses."""
        wanted, self.level = gains(ix.gains, self.level, after_another)
        halves = self.filters(ix, book)
        source = excitation(values, ix.kind, ix.offset, ix.seed)
        return self.synthesise(source, wanted, halves, ix.quarters < 4, lags(ix.lag, ix.contour, self.layout) if ix.kind == VOICED else None, taps(ix.book, ix.taps) if ix.kind == VOICED else None, CARRIED[ix.carry])

    def synthesise(self, source: list[int], wanted: list[int], halves: list[np.ndarray], changes: bool, lag: list[int] | None, tap: np.ndarray | None, carried: int) -> np.ndarray:
        """Excitation through the pitch filter (``lag`` None: without one) and the short filter, by subframes.

        The pitch filter's memory is past output through the present short filter, scaled down by the gain; it is
        made anew where that filter changes and rescaled where the gain does."""
        n, order = self.layout.part, self.layout.order
        out, driven = np.zeros(0, np.int64), []
        for k, gain in enumerate(wanted):
            a, adjust = halves[k >> 1], 1 << 16
            if gain != self.gain:
                adjust = fixed.divide(self.gain, gain, 16)
                self.state = [adjust * v >> 16 for v in self.state]
                self.gain = gain
            now = source[k * n : (k + 1) * n]
            if lag is not None:
                reach = lag[k] + 2
                if k == 0 or k == 2 and changes:
                    scale = fixed.inverse(gain, 47)
                    if k == 0:
                        scale = int(fixed.smulwb(scale, carried)) << 2
                    clean = whiten(np.concatenate([self.past, out])[-min(reach + order, self.memory) :], a)[-reach:]
                    driven = fixed.smulwb(scale, clean).tolist()
                elif adjust != 1 << 16:
                    driven = [adjust * v >> 16 for v in driven]
                now = self._pitched(now, driven, lag[k], [int(t) for t in tap[k]])
            out = np.append(out, self._shaped(now, [int(v) for v in a], gain >> 6))
        self.past = np.append(self.past, out)[-self.memory :]
        return out

    @staticmethod
    def _pitched(source: list[int], driven: list[int], lag: int, tap: list[int]) -> list[int]:
        """Adds five taps about a lag; appends to the filter's memory."""
        made = []
        for v in source:
            at = len(driven) - lag + 2
            v += 2 * (2 + sum(driven[at - j] * tap[j] >> 16 for j in range(5)))
            made.append(v)
            driven.append(2 * v)
        return made

    def _shaped(self, source: list[int], a: list[int], gain: int) -> np.ndarray:
        order, state = len(a), self.state
        for v in source:
            bent = (order >> 1) + sum(state[-1 - j] * a[j] >> 16 for j in range(order))
            state.append(int(fixed.wrap(v + 16 * bent)))
        self.state = state[-order:]
        return fixed.saturate16(fixed.shift_round(fixed.smulww(np.array(state[order:], np.int64), gain), 8))


# Stereo --------------------------------------------------------------------------------------


def stereo_weights(coder: rangecoder.Decoder) -> tuple[int, int]:
    """The two weights of the mid in the side, in 1/8192; the first as the difference from the second."""
    pair = divmod(coder.symbol(WEIGHT_PAIR, 8), 5)
    found = []
    for coarse in pair:
        at = 3 * coarse + coder.symbol(uniform(3), 8)
        fifth = coder.symbol(uniform(5), 8)
        half_step = (WEIGHTS[at + 1] - WEIGHTS[at]) * 6554 >> 16
        found.append(WEIGHTS[at] + half_step * (2 * fifth + 1))
    return found[0] - found[1], found[1]


def side_is_missing(coder: rangecoder.Decoder) -> bool:
    return coder.symbol(NO_SIDE, 8) == 1


class Stereo:
    """Mid and side to left and right, a sample late; weights move to new ones within 8 ms."""

    def __init__(self):
        self.weights, self.mid, self.side = (0, 0), np.zeros(2, np.int64), np.zeros(2, np.int64)

    def forget_side(self) -> None:
        self.weights, self.side = (0, 0), np.zeros(2, np.int64)

    def mono(self, mid: np.ndarray) -> np.ndarray:
        """The same delay for a stream without a side."""
        m = np.append(self.mid, mid)
        self.mid = m[-2:]
        return m[1:-1]

    def unmix(self, mid: np.ndarray, side: np.ndarray, weights: tuple[int, int], rate: int) -> tuple[np.ndarray, np.ndarray]:
        m, s = np.append(self.mid, mid), np.append(self.side, side)
        self.mid, self.side = m[-2:], s[-2:]
        ramp, at = 8 * rate, np.arange(len(mid))
        now = []
        for old, new in zip(self.weights, weights, strict=True):
            step = int(fixed.shift_round(fixed.smulbb(new - old, (1 << 16) // ramp), 16))
            now.append(np.where(at < ramp, old + step * (at + 1), new))
        self.weights = weights
        smooth = m[:-2] + 2 * m[1:-1] + m[2:] << 9
        told = fixed.smlawb(fixed.smlawb(s[1:-1] << 8, smooth, now[0]), m[1:-1] << 11, now[1])
        told = fixed.saturate16(fixed.shift_round(told, 8))
        return fixed.saturate16(m[1:-1] + told), fixed.saturate16(m[1:-1] - told)


# To 48 kHz -----------------------------------------------------------------------------------


class Resampler:
    """8, 12 or 16 to 48 kHz: two chains of all-pass sections double the rate, a filter of eight taps at twelve places
    does the rest.  The first millisecond of output comes from samples held back."""

    def __init__(self, rate: int):
        self.rate, self.hold = rate, HELD_BACK[rate]
        self.sections = [[0] * 3, [0] * 3]
        self.tail, self.held = np.zeros(8, np.int64), np.zeros(HELD_BACK[rate], np.int64)
        # of the doubled signal for each sample of output, in 1/65536, rounded up so that a walk ends in time
        self.step = -(-(rate << 17) // 48)

    def _doubled(self, x: np.ndarray) -> np.ndarray:
        out = []
        for v in x.tolist():
            for state, phase in zip(self.sections, PHASES, strict=True):
                y = v << 10
                for k, c in enumerate(phase):
                    turn = y - state[k]
                    turn = (turn * c >> 16) + (turn if c < 0 else 0)
                    y, state[k] = state[k] + turn, y + turn
                out.append(y)
        return fixed.saturate16(fixed.shift_round(out, 10))

    def _batch(self, x: np.ndarray) -> np.ndarray:
        line = np.append(self.tail, self._doubled(x))
        self.tail = line[len(line) - 8 :]
        at = np.arange(0, len(x) << 17, self.step)
        place = (at & 0xFFFF) * 12 >> 16
        whole = np.concatenate([HALF_FILTERS[place], HALF_FILTERS[11 - place][:, ::-1]], axis=1)
        near = line[(at >> 16)[:, None] + np.arange(8)]
        return fixed.saturate16(fixed.shift_round((near * whole).sum(axis=1), 15))

    def run(self, x: np.ndarray) -> np.ndarray:
        """Of at least a millisecond of samples."""
        if len(x) < self.rate:
            raise ValueError("under a millisecond of samples")
        first = self.rate - self.hold
        start = np.append(self.held, x[:first])
        self.held = np.asarray(x[len(x) - self.hold :], np.int64)
        return np.append(self._batch(start), self._batch(np.asarray(x[first : len(x) - self.hold], np.int64)))
