"""Parts of the CELT layer: round trips, exact properties and values worked out by hand."""

import math
import random

import numpy as np
import pytest

from timbral.functions import celt, pcm, pvq, rangecoder
from timbral.operators import lpc
from timbral.sources import flac


def test_layout():
    assert [celt.samples(k) for k in range(4)] == [120, 240, 480, 960] and [celt.size_of(n) for n in (120, 240, 480, 960)] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="no frame"):
        celt.size_of(360)
    assert sum(len(celt.band_bins(b, 3)) for b in range(celt.BANDS)) == 800
    assert [celt.bands_up_to(f) for f in (4000, 8000, 12000, 20000)] == [13, 17, 19, 21]


def test_log2_rounds_up_as_the_format_does():
    for v in [*range(1, 5000), 50535, (1 << 32) - 1, *(random.Random(3).randrange(1, 1 << 32) for _ in range(2000))]:
        least = math.ceil(8 * math.log2(v) - 1e-9)
        assert least <= celt.log2_up(v) <= least + 1
    assert celt.log2_up(1 << 31) == 248 and celt.vector_cost(5, 0) == 0
    # one of the sizes that cost an eighth more than the exact logarithm
    assert celt.vector_cost(11, 9) == math.ceil(8 * math.log2(pvq.count(11, 9))) + 1
    for n in (2, 5, 16):
        for bits in (0, 5, 40, 100):
            k = celt.pulses_for(n, bits)
            assert (k == 0 or celt.vector_cost(n, k) <= bits) and (bits <= 0 or k == 256 or celt.vector_cost(n, k + 1) > bits)
    assert [celt.pseudo_pulses(i) for i in (0, 7, 8, 15, 16, 24)] == [0, 7, 8, 15, 16, 32]


@pytest.mark.parametrize("model", [(72 << 7, 127 << 6), (24 << 7, 179 << 6), (177 << 7, 11 << 6)])
def test_laplace(model):
    values = [*range(-40, 41), 3000, -3000, 0, 0]
    coder = rangecoder.Encoder()
    coded = [celt.laplace_encode(coder, v, *model) for v in values]
    decoder = rangecoder.Decoder(coder.bytes())
    assert [celt.laplace_decode(decoder, *model) for _ in values] == coded
    assert all(c == v or abs(c) >= 14 and c * v > 0 for c, v in zip(coded, values, strict=True))
    # the intervals of all values fill the range without a gap
    spans = sorted({celt._interval(v, *model)[:2] for v in range(-20000, 20001)})
    assert spans[0][0] == 0 and all(a + w == b for (a, w), (b, _) in zip(spans[:-1], spans[1:], strict=True)) and sum(spans[-1]) >= (1 << 15) - 1


def test_energy_passes():
    coder = rangecoder.Encoder()
    model = [(60, 100)] * celt.BANDS
    for q in (2, -1, 0, 3):
        celt.laplace_encode(coder, q, 60 << 7, 100 << 6)
    for v, n in ((5, 3), (1, 1), (0, 1), (1, 1)):
        coder.raw(v, n)
    data = coder.bytes(40)
    d = rangecoder.Decoder(data)
    got = celt.coarse_energy(d, np.full((2, celt.BANDS), -20.0), range(2), 3, False, model, 8 * len(data))
    beta = 6554 / 32768
    assert got[:, 0] == pytest.approx([-4.5 + 2, -4.5 - 1]) and got[:, 1] == pytest.approx([-4.5 + 2 * (1 - beta) + 0, -4.5 - (1 - beta) + 3])
    celt.fine_energy(d, got, range(1), [3, *[0] * 20])
    assert got[0, 0] == pytest.approx(-2.5 + 5.5 / 8 - 0.5)
    starved = celt.coarse_energy(rangecoder.Decoder(b"\0"), np.zeros((1, celt.BANDS)), range(3), 0, True, model, 0)
    assert starved[0, 0] == -1
    energy = np.zeros((1, celt.BANDS))
    assert celt.final_energy(rangecoder.Decoder(b"\xff\xff"), energy, range(3), [0, 8, 1], [1, 0, 0], 1) == 0
    assert energy[0, :3].tolist() == [0, 0, 0.125]
    levels = celt.amplitudes(np.zeros(celt.BANDS), range(1, 3))
    assert levels[0] == 0 and levels[1] == pytest.approx(2 ** (100 / 16)) and levels[3] == 0
    shape = celt.denormalise(np.ones(120), np.arange(celt.BANDS), 9, 0)
    assert shape[9] == 8 and shape[10:].sum() == 0


def test_decisions_read_what_was_written():
    coder = rangecoder.Encoder()
    for v, cost in ((1, 4), (0, 5), (1, 5)):
        coder.bit(bool(v), cost)
    coder.bit(True, 1)
    coder.symbol(3, celt.SPREADS, 5)
    d = rangecoder.Decoder(coder.bytes(20))
    assert celt.resolutions(d, range(3), 2, False, 160) == [-3, -3, 0]
    assert celt.spreading(d, 160) == 3
    assert celt.spreading(rangecoder.Decoder(b""), 0) == 2
    assert celt.collapse_mask(np.array([0, 1, 0, 0, 0, 2]), 3) == 0b101


@pytest.mark.parametrize(("n", "blocks", "k", "spread"), [(16, 1, 3, 1), (32, 2, 2, 2), (48, 4, 5, 3), (8, 1, 4, 2)])
def test_rotation_comes_back(n, blocks, k, spread):
    x = np.random.default_rng(1).normal(size=n)
    there = celt.rotate(x, blocks, k, spread, forward=True)
    assert celt.rotate(there, blocks, k, spread) == pytest.approx(x)
    assert np.sum(there**2) == pytest.approx(np.sum(x**2)) and (np.allclose(there, x) == (2 * k >= n))


@pytest.mark.parametrize("blocks", [2, 4, 8, 16])
def test_blocks_come_back(blocks):
    x = np.arange(blocks * 3)
    assert celt.to_blocks(x, blocks)[:3].tolist() == [0, blocks, 2 * blocks]
    for hadamard in (False, True):
        assert (celt.from_blocks(celt.to_blocks(x, blocks, hadamard), blocks, hadamard) == x).all()


def test_exact_angles():
    for x in range(64, 16384, 160):
        assert abs(celt.cos_exact(x) - 32768 * math.cos(math.pi / 2 * x / 16384)) < 8
        s, c = celt.cos_exact(16384 - x), celt.cos_exact(x)
        assert abs(celt.log2_tan_exact(s, c) - 2048 * math.log2(math.tan(math.pi / 2 * x / 16384))) < 24
    assert celt.cos_exact(8192) == 23171 and celt.angle_steps(8, 20, 30, False) == 1
    assert all(celt.angle_steps(n, b, 60, False) % 2 == 0 for n in (4, 8, 16) for b in range(140, 400, 20))


@pytest.mark.parametrize(("n", "blocks", "stereo"), [(8, 1, True), (2, 1, True), (8, 2, False), (8, 1, False)])
def test_angles_are_told_apart(n, blocks, stereo):
    steps, seen = 8, set()
    for i in range(4096):
        d = rangecoder.Decoder(i.to_bytes(2, "big")[-2:] + b"\x55\xaa" if i < 65536 else b"")
        seen.add(celt.angle(d, steps, n, blocks, stereo))
    dice = random.Random(1)
    seen |= {celt.angle(rangecoder.Decoder(dice.randbytes(6)), steps, n, blocks, stereo) for _ in range(3000)}
    assert seen == set(range(steps + 1))


def test_shapes_and_samples():
    mid, side = np.array([1.0, 0, 0]), np.array([0, 0.5, 0])
    left, right = celt.merge_stereo(mid, side, 0.8)
    assert left @ left == pytest.approx(1) and right @ right == pytest.approx(1) and left[1] == -right[1]
    assert all((v == mid).all() for v in celt.merge_stereo(mid, 0.8 * mid, 0.8))
    vector = [2, -1, 0, 3]
    coder = rangecoder.Encoder()
    celt.vector_encode(coder, vector)
    assert celt.vector_decode(rangecoder.Decoder(coder.bytes()), 4, 6) == vector
    shape = np.zeros(800)
    shape[0::8] = 0.1
    celt.refill(shape, [1] * celt.BANDS, np.zeros(celt.BANDS), [8] * celt.BANDS, range(2), 3, 7)
    assert np.sum(shape[:8] ** 2) == pytest.approx(1) and (shape[:16] != 0).all() and shape[17] == 0
    x = np.zeros(50)
    x[0] = 1.0
    found, state = celt.deemphasis(x)
    assert found * celt.FULL_SCALE == pytest.approx(celt.PRE_EMPHASIS ** np.arange(50)) and state == pytest.approx(celt.PRE_EMPHASIS**50)
    assert (celt.comb(np.zeros(30), x, (20, 20), (0, 0), (0, 0), np.ones(4)) == x).all()
    rung = celt.comb(np.zeros(30), x, (20, 20), (0.0, 0.5), (0, 1), np.zeros(0))
    assert rung[18:23] == pytest.approx([0, 0.5 * celt.COMB[1][1], 0.5 * celt.COMB[1][0], 0.5 * celt.COMB[1][1], 0])


def test_range_coder_positions():
    d = rangecoder.Decoder(bytes(range(1, 9)))
    d.skip_to(40)
    assert d.tell() == 40
    d.skip_to(3)
    assert d.tell() == 40
    other = rangecoder.Decoder(b"\x01\x02\x03\x04")
    other.shrink(2)
    assert other.raw(8) == 2
    other.shrink(99)
    assert other.raw(8) == 0


def test_stereo_mode_and_taper():
    flat = np.full(16, 1000)
    assert flac.stereo_mode(flat, flat) in (flac.LEFT_SIDE, flac.MID_SIDE)
    rng = np.random.default_rng(2)
    assert flac.stereo_mode(rng.integers(-900, 900, 64), rng.integers(-900, 900, 64)) == 1
    w = lpc.tukey(16, 0.5)
    assert w[3] == w[12] == 1 and w[0] == 0 and w[2] == pytest.approx(0.5 * (1 + math.cos(math.pi * (4 / 7.5 - 1)))) and (lpc.tukey(5, 0) == 1).all()


def test_formats():
    form = pcm.Format(48000, 2)
    assert str(form) == "48000 Hz, 2 ch" and pcm.buffer(form, 3).shape == (2, 3) and pcm.check_buffer(form, list(pcm.buffer(form, 5))) == 5
    for bad in (lambda: pcm.Format(0, 1), lambda: pcm.Format(1, 0), lambda: pcm.buffer(form, -1), lambda: pcm.check_buffer(form, [np.zeros(2)]), lambda: pcm.check_buffer(form, [np.zeros(2), np.zeros(3)])):
        with pytest.raises(ValueError):
            bad()
