"""Bit allocation by its invariants, prediction and pitch by signals whose answer is known."""

import random

import numpy as np
import pytest

from timbral.functions import allocation, celt, pitch, rangecoder

QUALITY = np.array([[max(0, min(200, 20 * row - 5 * band + 3 * row * (row > 3))) if row else 0 for band in range(celt.BANDS)] for row in range(11)])
MOST = np.array([[200 - 6 * band for band in range(celt.BANDS)]] * 8)


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_whole_budget_is_given(size, channels):
    dice = random.Random(10 * size + channels)
    cap = allocation.caps(MOST, size, channels)
    seen, dual = set(), set()
    for _ in range(60):
        bands = range(*dice.choice([(0, 21), (0, 17), (17, 21), (0, 13)]))
        data = dice.randbytes(400)
        coder = rangecoder.Decoder(data)
        boost = allocation.boosts(coder, bands, size, channels, cap, dice.choice([0, 900]))
        before = coder.tell_eighths()
        total = dice.choice([0, 5, 60, 400, 2000, 9000]) + int(boost.sum())
        got = allocation.allocate(coder, bands, boost, cap, dice.randrange(11), total, size, channels, QUALITY)
        spent = int(got.shape.sum() + 8 * channels * got.fine.sum()) + got.balance
        flags = coder.tell_eighths() - before
        # shape, fine energy and flags are all there is; what is lost are parts of bits in bands left out
        assert spent + flags <= total + 8 * 4
        assert spent + flags >= total - 8 * 3 - 8 * channels * len(bands)
        inside = slice(bands.start, bands.stop)
        assert (got.shape >= 0).all() and (got.shape[inside] <= cap[inside]).all() and (got.fine >= 0).all() and (got.fine[: got.coded] <= celt.MOST_FINE).all()
        assert not got.shape[got.coded :].any() and bands.start < got.coded <= bands.stop and got.intensity <= got.coded
        assert not boost[got.coded :].any() and (channels == 2 or not got.dual)
        seen.add(got.coded)
        dual.add(got.dual)
    assert len(seen) > 2 and (channels == 1 or len(dual) == 2)


def test_costs_and_tilts():
    assert [allocation.choice_cost(n) for n in (1, 2, 3, 4, 5, 6, 8, 18, 22, 24)] == [0, 8, 13, 16, 19, 21, 24, 34, 36, 37]
    flat = allocation.tilts(range(21), 5, 0, 1)
    assert flat[8:].tolist() == [0] * 13 and flat[:8].tolist() == [-8] * 8
    up, down = allocation.tilts(range(21), 8, 3, 2), allocation.tilts(range(21), 2, 3, 2)
    assert not up.any() and down[20] == 0 and (down[:20] < 0).all()
    # without room a tilt is level and there are no boosts
    coder = rangecoder.Decoder(bytes(8))
    assert allocation.tilt(coder, 40) == 5 and not allocation.boosts(coder, range(21), 3, 1, np.full(21, 99), 0).any()
    coder = rangecoder.Encoder()
    coder.bit(False, 6)
    for flag, cost in ((True, 6), (True, 1), (False, 1), (False, 5)):
        coder.bit(flag, cost)
    for _ in range(18):
        coder.bit(False, 5)
    coder.symbol(7, allocation.TILTS, 7)
    decoder = rangecoder.Decoder(coder.bytes())
    got = allocation.boosts(decoder, range(21), 3, 1, np.full(21, 1000), 5000)
    assert got[1] == 2 * 48 and got.sum() == 96 and allocation.tilt(decoder, 5000) == 7


def test_more_bits_never_take_from_a_band():
    cap = allocation.caps(MOST, 3, 1)
    sums = [int(allocation.allocate(rangecoder.Decoder(b"\xff" * 50), range(21), np.zeros(21, int), cap, 5, total, 3, 1, QUALITY).shape.sum()) for total in range(0, 12000, 250)]
    assert sums[0] == 0 and sums[-1] > 5000 and all(b >= a - 8 * 21 for a, b in zip(sums, sums[1:], strict=False))


def test_prediction():
    x = [0.0, 1.0]
    for _ in range(400):
        x.append(1.6 * x[-1] - 0.8 * x[-2] + random.Random(len(x)).uniform(-1, 1) * 100)
    x = np.array(x, np.float32)
    a = pitch.fit(pitch.autocorrelate(x, 2), 2)
    assert a == pytest.approx([-1.6, 0.8], abs=0.06)
    left = pitch.whiten(x, a)
    assert np.sum(left**2) < 0.2 * np.sum(x**2) and pitch.colour(left, a) == pytest.approx(x, abs=0.5)
    later = pitch.whiten(x[200:], a, x[:200])
    assert later == pytest.approx(left[200:], abs=1e-3) and pitch.colour(later, a, x[:200]) == pytest.approx(x[200:], abs=0.5)
    assert not pitch.fit(np.zeros(5, np.float32), 4).any()
    taper = np.linspace(0, 1, 10, dtype=np.float32)
    ones = pitch.autocorrelate(np.ones(40), 1, taper)
    assert ones[0] == pytest.approx(10 + 20 + 2 * float(taper @ taper), rel=1e-5)
    tone = np.sin(np.arange(5000) * 0.02) * 1000
    assert np.count_nonzero(pitch.fit(pitch.autocorrelate(tone, 24), 24)) < 24


@pytest.mark.parametrize("true", [120, 203, 400, 610])
@pytest.mark.parametrize("channels", [1, 2])
def test_pitch(true, channels):
    dice = np.random.default_rng(true)
    one = dice.normal(0, 3000, true)
    x = np.tile(one, 2048 // true + 2)[:2048]
    found = pitch.period([x, x * 0.5][:channels])
    # the half step goes the way that the format's own search takes it, so an odd period is found to two samples
    assert min(abs(found - k * true) for k in range(1, 720 // true + 1)) <= 2
    assert pitch.search(np.zeros(400), np.zeros(800), 800, 600) == 0
