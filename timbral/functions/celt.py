"""Parts of the CELT layer of Opus (RFC 6716, section 4.3, with the corrections of RFC 8251): frame layout, the
Laplace and energy codes, time-frequency and spreading decisions, split angles, and the steps from band shapes to
samples.  Arrays are NumPy; a coder is a ``rangecoder`` object.  The band probabilities of the coarse energy are a
parameter: pairs (chance of zero, decay), both in units of 1/256, one for each of 21 bands.
"""

from __future__ import annotations

import math

import numpy as np

from . import pvq, rangecoder

#: Fixed values of the format: first bin of each band in units of 2.5 ms bins, and its last edge.
EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)
BANDS = len(EDGES) - 1
#: Weights of the same band in the frame before and of the band before, by frame size, in 1/32768.
TIME_WEIGHT, BAND_WEIGHT, INTRA_BAND_WEIGHT = (29440, 26112, 21248, 16384), (30147, 22282, 12124, 6554), 4915
#: Mean energy of the bands in 1/16 of a factor of two.
MEAN_16 = (103, 100, 92, 85, 81, 77, 72, 70, 78, 75, 73, 71, 78, 74, 69, 72, 70, 74, 76, 71, 60)
#: Change of resolution by frame size, then by transient, selector and flag.
TF_CHANGE = ((0, -1, 0, -1, 0, -1, 0, -1), (0, -1, 0, -2, 1, 0, 1, -1), (0, -2, 0, -3, 2, 0, 1, -1), (0, -2, 0, -3, 3, 0, 1, -1))
#: Chances of the small energy steps and of the spreading decisions, and the spreading factors.
SMALL_STEPS, SPREADS, SPREAD_FACTOR = (2, 1, 0), (25, 23, 2, 0), (None, 15, 10, 5)
#: Order of the blocks after a Hadamard step, by their number.
BLOCK_ORDER = {2: (1, 0), 4: (3, 0, 2, 1), 8: (7, 0, 4, 3, 6, 1, 5, 2), 16: (15, 0, 8, 7, 12, 3, 11, 4, 14, 1, 9, 6, 13, 2, 10, 5)}
#: Taps of the comb filter at the centre and its two sides, by tap set.
COMB = ((0.3066406250, 0.2170410156, 0.1296386719), (0.4638671875, 0.2680664062, 0.0), (0.7998046875, 0.1000976562, 0.0))
PRE_EMPHASIS, FULL_SCALE = 0.85000610, 32768.0
MOST_FINE = 8

# Layout --------------------------------------------------------------------------------------


def samples(size: int) -> int:
    """Samples at 48 kHz of frame size 0 to 3."""
    return 120 << size


def size_of(n: int) -> int:
    if n not in (120, 240, 480, 960):
        raise ValueError(f"no frame has {n} samples")
    return (n // 120).bit_length() - 1


def band_bins(band: int, size: int) -> range:
    return range(EDGES[band] << size, EDGES[band + 1] << size)


def bands_up_to(hertz: int) -> int:
    """How many bands end at or below a frequency; an edge is a multiple of 200 Hz."""
    return sum(200 * e <= hertz for e in EDGES[1:])


# Costs ---------------------------------------------------------------------------------------


def log2_up(v: int, digits: int = 3) -> int:
    """log2 of a 32-bit number in units of 2^-digits, rounded up the way the format does: 16 bits of mantissa, rounded
    up, are squared once for each digit."""
    whole = v.bit_length() - 1
    if v & (v - 1) == 0:
        return whole << digits
    m = -(-v // (1 << whole - 15)) if whole > 15 else v << 15 - whole
    out = whole << digits
    for left in range(digits, -1, -1):
        over = m >> 16
        out += over << left
        m = m + over >> over
        m = m * m + 0x7FFF >> 15
    return out + (m > 0x8000)


def vector_cost(n: int, k: int) -> int:
    """Eighths of a bit of the number of a vector; numbers of over 32 bits count as the largest of 32."""
    v = min(pvq.count(n, k), (1 << 32) - 1)
    return log2_up(v) if v > 1 else 0


def pulses_for(n: int, eighths: int, most: int = 256) -> int:
    """The most pulses whose vectors cost no more."""
    k = 0
    while n > 0 and k < most and vector_cost(n, k + 1) <= eighths:
        k += 1
    return k if eighths > 0 else 0


def pseudo_pulses(i: int) -> int:
    """Pulses of an index: each one up to 8, then eight steps to an octave."""
    return i if i < 8 else 8 + i % 8 << i // 8 - 1


# Laplace code --------------------------------------------------------------------------------

_WHOLE, _FLOOR = 1 << 15, 16


def _first(zero: int, decay: int) -> int:
    """What the magnitude of one has, of each sign, before the floor of one that every value keeps."""
    return max(_WHOLE - 2 * _FLOOR - zero, 0) * (16384 - decay) >> 15


def _interval(value: int, zero: int, decay: int) -> tuple[int, int, int]:
    """(low, width, value) of the interval of a value; one beyond the model is brought to the last that has an interval."""
    if value == 0:
        return 0, zero, 0
    low, width, at = zero, _first(zero, decay), 1
    while width and at < abs(value):
        low += 2 * width + 2
        width, at = 2 * width * decay >> 15, at + 1
    if width:
        return low + (width + 1 if value > 0 else 0), width + 1, value
    pairs = (_WHOLE - low + (value < 0)) // 2
    more = min(abs(value) - at, pairs - 1)
    low += 2 * more + (value > 0)
    return low, min(1, _WHOLE - low), int(math.copysign(at + more, value))


def laplace_decode(coder: rangecoder.Decoder, zero: int, decay: int) -> int:
    place = coder.frequency(_WHOLE)
    size = 0
    if place >= zero:
        # magnitudes double down from the first; the tail is of width one
        low, width, size = zero, _first(zero, decay) + 1, 1
        while width > 1 and place >= low + 2 * width:
            low += 2 * width
            width, size = (2 * (width - 1) * decay >> 15) + 1, size + 1
        if width == 1:
            size += (place - low) // 2
            low += (place - low) // 2 * 2
        value = -size if place < low + width else size
        low += 0 if value < 0 else width
    else:
        low, width, value = 0, zero, 0
    coder.update(low, min(low + width, _WHOLE), _WHOLE)
    return value


def laplace_encode(coder: rangecoder.Encoder, value: int, zero: int, decay: int) -> int:
    """Returns the value that was coded."""
    low, width, value = _interval(value, zero, decay)
    coder.update(low, min(low + width, _WHOLE), _WHOLE)
    return value


# Energy --------------------------------------------------------------------------------------


def coarse_energy(coder: rangecoder.Decoder, before: np.ndarray, bands: range, size: int, intra: bool, model: list[tuple[int, int]], budget: int) -> np.ndarray:
    """Log energies (channel, band) of a frame from those of the frame before; ``budget``: bits of the frame."""
    time, band = (0.0, INTRA_BAND_WEIGHT / 32768) if intra else (TIME_WEIGHT[size] / 32768, BAND_WEIGHT[size] / 32768)
    out, running = np.array(before, np.float32), np.zeros(len(before), np.float32)
    for i in bands:
        for c in range(len(out)):
            left = budget - coder.tell()
            if left >= 15:
                zero, decay = model[min(i, len(model) - 1)]
                step = laplace_decode(coder, zero << 7, decay << 6)
            elif left >= 2:
                k = coder.symbol(SMALL_STEPS, 2)
                step = -(k + 1) // 2 if k % 2 else k // 2
            else:
                step = -int(coder.bit(1)) if left == 1 else -1
            out[c, i] = np.float32(time) * max(out[c, i], np.float32(-9)) + running[c] + step
            running[c] += np.float32(step) * np.float32(1 - band)
    return out


def fine_energy(coder: rangecoder.Decoder, energy: np.ndarray, bands: range, bits: list[int]) -> None:
    """Adds to each energy the centre of one of 2^bits parts of a step."""
    for i in bands:
        for c in range(len(energy) if bits[i] > 0 else 0):
            energy[c, i] += (coder.raw(bits[i]) + 0.5) / (1 << bits[i]) - 0.5


def final_energy(coder: rangecoder.Decoder, energy: np.ndarray, bands: range, bits: list[int], priority: list[int], left: int) -> int:
    """Spends the bits that are left on one more digit of the bands of priority 0, then 1; returns the rest."""
    for which in (0, 1):
        for i in bands:
            if left < len(energy):
                return left
            if bits[i] < MOST_FINE and priority[i] == which:
                for c in range(len(energy)):
                    energy[c, i] += (coder.raw(1) - 0.5) / (2 << bits[i])
                left -= len(energy)
    return left


def amplitudes(energy: np.ndarray, bands: range) -> np.ndarray:
    """Linear levels of log energies (…, band); bands out of range are silent."""
    out = np.zeros_like(energy, np.float32)
    at = slice(bands.start, bands.stop)
    out[..., at] = np.exp2(np.minimum(energy[..., at] + np.array(MEAN_16, np.float32)[at] / 16, 32))
    return out


def denormalise(shape: np.ndarray, levels: np.ndarray, end: int, size: int) -> np.ndarray:
    """Spectrum of unit band shapes, zero above band ``end``."""
    width = np.diff(EDGES)[:end] << size
    out = np.zeros_like(shape)
    n = EDGES[end] << size
    out[:n] = shape[:n] * np.repeat(levels[:end], width)
    return out


# Decisions -----------------------------------------------------------------------------------


def resolutions(coder: rangecoder.Decoder, bands: range, size: int, transient: bool, total: int) -> list[int]:
    """Time-frequency change of each band: flags that say whether the setting turns, and a selector where it matters."""
    cost = 2 if transient else 4
    reserved = size > 0 and coder.tell() + cost + 1 <= total
    flags, now = [], 0
    for _ in bands:
        if coder.tell() + cost <= total - reserved:
            now ^= int(coder.bit(cost))
        flags.append(now)
        cost = 4 if transient else 5
    row = TF_CHANGE[size][4 * transient :]
    seen = int(any(flags))
    pick = 2 * int(coder.bit(1)) if reserved and row[seen] != row[2 + seen] else 0
    return [row[pick + f] for f in flags]


def spreading(coder: rangecoder.Decoder, total: int) -> int:
    """0 none, 1 light, 2 normal, 3 aggressive; normal where four bits are not left."""
    return coder.symbol(SPREADS, 5) if coder.tell() + 4 <= total else 2


def _turn(x: np.ndarray, stride: int, c: float, s: float) -> None:
    n = len(x)
    for i in (*range(n - stride), *range(n - 2 * stride - 1, -1, -1)):
        a, b = x[i], x[i + stride]
        x[i], x[i + stride] = c * a - s * b, c * b + s * a


def rotate(x: np.ndarray, blocks: int, k: int, spread: int, forward: bool = False) -> np.ndarray:
    """Spread a band with k pulses, block by block, or undo it."""
    out, n = np.array(x, np.float64), len(x)
    if not spread or 2 * k >= n or blocks < 1 or not n:
        return out
    angle = (n / (n + SPREAD_FACTOR[spread] * k)) ** 2 / 2
    c, s = math.cos(math.pi / 2 * angle), math.cos(math.pi / 2 * (1 - angle))
    far = 0
    if n >= 8 * blocks:  # the least stride with (stride + 1/2)^2 at n / blocks or more
        far = 1
        while (far * far + far) * blocks + (blocks >> 2) < n:
            far += 1
    for block in out[: n // blocks * blocks].reshape(blocks, -1):
        if forward:
            _turn(block, 1, c, -s)
            if far:
                _turn(block, far, s, -c)
        else:
            if far:
                _turn(block, far, s, c)
            _turn(block, 1, c, s)
    return out


def collapse_mask(pulses: np.ndarray, blocks: int) -> int:
    """A bit for each block that has a pulse."""
    if blocks <= 1:
        return 1
    return sum(1 << i for i, p in enumerate(np.asarray(pulses)[: len(pulses) // blocks * blocks].reshape(blocks, -1)) if p.any())


# Split angles --------------------------------------------------------------------------------


def _mul16(a: int, b: int) -> int:
    """Rounded product of low halves in 1/32768."""
    half = lambda x: (x + 32768) % 65536 - 32768
    return half(a) * half(b) + 16384 >> 15


def cos_exact(x: int) -> int:
    """Cosine of x / 16384 of a quarter turn, in 1/32768, as the format rounds it."""
    square = x * x + 4096 >> 13
    return 1 + (32767 - square) + _mul16(square, -7651 + _mul16(square, 8277 + _mul16(-626, square)))


def log2_tan_exact(sine: int, cosine: int) -> int:
    """log2(sine / cosine) in 1/2048, as the format rounds it."""

    def part(v: int) -> int:
        m = v << 15 - v.bit_length()
        return (v.bit_length() << 11) + _mul16(m, _mul16(m, -2597) + 7932)

    return part(sine) - part(cosine)


def angle_steps(n: int, eighths: int, cap: int, stereo: bool) -> int:
    """Into how many steps the angle of a split of n is cut, from the bits at hand and the band's pulse cap (eighths)."""
    narrow = stereo and n == 2
    parts = 2 * n - 1 - narrow
    offset = (cap >> 1) - (16 if narrow else 4)
    bits = min(eighths - cap - 32, (eighths + parts * offset) // parts if eighths + parts * offset >= 0 else -(-(eighths + parts * offset) // parts), 64)
    if bits < 4:
        return 1
    return (int(16384 * 2 ** (bits % 8 / 8)) >> 14 - bits // 8) + 1 >> 1 << 1


def angle(coder: rangecoder.Decoder, steps: int, n: int, blocks: int, stereo: bool) -> int:
    """A split angle of 0 to steps: a step's distribution for stereo, uniform across time blocks, else a triangle."""
    if stereo and n > 2:
        half = steps // 2
        total = 3 * (half + 1) + half
        at = coder.frequency(total)
        x = at // 3 if at < 3 * (half + 1) else at - 2 * (half + 1)
        low, width = (3 * x, 3) if x <= half else (x + 2 * (half + 1), 1)
    elif blocks > 1 or stereo:
        return coder.uniform(steps + 1)
    else:
        half = steps >> 1
        total = (half + 1) ** 2
        at = coder.frequency(total)
        if at < half * (half + 1) // 2:
            x = (math.isqrt(8 * at + 1) - 1) // 2
            low, width = x * (x + 1) // 2, x + 1
        else:
            x = (2 * (steps + 1) - math.isqrt(8 * (total - at - 1) + 1)) // 2
            width = steps + 1 - x
            low = total - width * (width + 1) // 2
    coder.update(low, low + width, total)
    return x


def merge_stereo(mid: np.ndarray, side: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right, each of unit size, from a unit mid with its gain and a side that has its own; where one of them
    has gone, both are the mid."""
    cross, own = gain * float(mid @ side), float(side @ side)
    left, right = gain * gain + own - 2 * cross, gain * gain + own + 2 * cross
    if min(left, right) < 6e-4:
        return mid.copy(), mid.copy()
    return (gain * mid - side) / math.sqrt(left), (gain * mid + side) / math.sqrt(right)


# Reordering ----------------------------------------------------------------------------------


def to_blocks(x: np.ndarray, blocks: int, hadamard: bool = False) -> np.ndarray:
    """Interleaved blocks one after the other, in Hadamard order on request."""
    rows = np.asarray(x).reshape(-1, blocks).T
    out = np.empty_like(rows)
    out[list(BLOCK_ORDER[blocks]) if hadamard else slice(None)] = rows
    return out.ravel()


def from_blocks(x: np.ndarray, blocks: int, hadamard: bool = False) -> np.ndarray:
    rows = np.asarray(x).reshape(blocks, -1)
    return rows[list(BLOCK_ORDER[blocks]) if hadamard else slice(None)].T.ravel()


# Vectors through the coder -------------------------------------------------------------------


def vector_decode(coder: rangecoder.Decoder, n: int, k: int) -> list[int]:
    return pvq.decode(coder.uniform(pvq.count(n, k)), n, k)


def vector_encode(coder: rangecoder.Encoder, vector: list[int]) -> None:
    coder.uniform(pvq.encode(vector), pvq.count(len(vector), sum(map(abs, vector))))


def refill(shape: np.ndarray, masks: list[int], fall: np.ndarray, pulses: list[int], bands: range, size: int, seed: int) -> int:
    """Fill the blocks of one channel's bands that got no pulse with noise, in place; ``fall`` is how far each band's
    log energy lies above the lower of the two frames before.  Returns the next seed."""
    blocks = 1 << size
    for i in bands:
        at = band_bins(i, size)
        depth = (1 + pulses[i]) // len(at)
        level = min(0.5 * 2 ** (-depth / 8), 2 * 2 ** -max(0.0, float(fall[i])) * (math.sqrt(2) if size == 3 else 1)) / math.sqrt(len(at))
        gone = [k for k in range(blocks) if not masks[i] >> k & 1]
        band = shape[at.start : at.stop]
        for k in gone:
            for j in range(k, len(band), blocks):
                seed = (1664525 * seed + 1013904223) % (1 << 32)
                band[j] = level if seed & 0x8000 else -level
        if gone:
            band[:] = pvq.normalise(band)
    return seed


# Samples -------------------------------------------------------------------------------------


def comb(past: np.ndarray, x: np.ndarray, periods: tuple[int, int], gains: tuple[float, float], taps: tuple[int, int], window: np.ndarray) -> np.ndarray:
    """Add to each sample its own past output one pitch period ago, by five symmetric taps; over the window the old
    period, gain and taps fade into the new.  ``past`` is at least a period and two samples long."""
    out = np.concatenate([past, x]).astype(np.float64)
    weights = [np.array([t[2], t[1], t[0], t[1], t[2]]) * g for t, g in ((COMB[k], g) for k, g in zip(taps, gains, strict=True))]
    for i in range(len(x)):
        fade = window[i] ** 2 if i < len(window) else 1.0
        at = len(past) + i
        old, new = (float(w @ out[at - t - 2 : at - t + 3]) if w.any() else 0.0 for w, t in zip(weights, periods, strict=True))
        out[at] += (1 - fade) * old + fade * new
    return out[len(past) :]


def deemphasis(x: np.ndarray, memory: float = 0.0) -> tuple[np.ndarray, float]:
    """Samples between -1 and 1 and the state for the next frame."""
    out = np.empty(len(x))
    for i, v in enumerate(np.asarray(x, np.float64).tolist()):
        out[i] = v + memory
        memory = PRE_EMPHASIS * out[i]
    return out / FULL_SCALE, memory
