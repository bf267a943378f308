"""Parts of the SILK layer: round trips, filters against their roots and against floating point, known properties."""

import random

import numpy as np
import pytest

from timbral.functions import fixed, rangecoder, silk


def _book(order, seed=1):
    dice = np.random.default_rng(seed)
    coarse = np.stack([np.linspace(256 / (order + 1), 256 - 256 / (order + 1), order) + dice.integers(-4, 5, order) for _ in range(32)]).astype(int)
    even = tuple(256 - 8 * (k + 1) for k in range(32))
    residual = (252, 248, 232, 190, 60, 20, 8, 3, 0)
    return silk.Spectra(coarse, (even, even), dice.integers(0, 16, (32, order)), dice.integers(50, 180, (2, order - 1)), (residual,) * 8, 11796 if order == 10 else 9830, (250, *(3,) * (order - 1), 461))


def test_layout_and_flags():
    wide = silk.Layout(16, 60, 2)
    assert (wide.frames, wide.subframes, wide.samples, wide.order) == (3, 4, 320, 16) and silk.Layout(12, 10).samples == 120
    for bad in ((24, 20, 1), (16, 30, 1), (16, 20, 3)):
        with pytest.raises(ValueError, match="no packet"):
            silk.Layout(*bad)
    coder = rangecoder.Encoder()
    for flag in (1, 0, 1, 1, 0, 0, 1, 0):
        coder.bit(bool(flag), 1)
    coder.symbol(4, silk.COPIES[3], 8)
    assert silk.header(rangecoder.Decoder(coder.bytes()), wide) == ([[True, False, True], [False, False, True]], [[True, False, True], [False] * 3])
    coder = rangecoder.Encoder()
    coder.bit(True, 1)
    coder.bit(True, 1)
    assert silk.header(rangecoder.Decoder(coder.bytes()), silk.Layout(8, 20)) == ([[True]], [[True]])


def test_chances_by_rule():
    assert silk.uniform(3) == (171, 85, 0) and silk.uniform(6) == (213, 171, 128, 85, 43, 0) and silk.uniform(8)[0] == 224
    for rows in silk.even_shells():
        assert all(row[-1] == 0 and all(a > b for a, b in zip((256, *row), row, strict=False)) for row in rows)


@pytest.mark.parametrize("kind", [silk.INACTIVE, silk.UNVOICED, silk.VOICED])
@pytest.mark.parametrize("n", [80, 120, 320])
def test_pulses(kind, n):
    dice, shells = random.Random(n + kind), silk.even_shells()
    for most in (0, 1, 3, 40, 1000):
        values = [dice.randint(-most, most) if dice.random() < 0.6 else 0 for _ in range(n)]
        coder = rangecoder.Encoder()
        silk.encode_pulses(coder, values, kind, most % 2, shells, level=dice.randrange(9))
        assert silk.pulses(rangecoder.Decoder(coder.bytes()), kind, most % 2, n, shells) == values


def test_divisions():
    dice = random.Random(5)
    for _ in range(300):
        b = dice.choice([1, -1]) * dice.randint(1 << 12, (1 << 31) - 1)
        q = abs(b).bit_length() + 25
        assert fixed.inverse(b, q) == pytest.approx((1 << q) / b, rel=1e-6)
        a = dice.randint(-(1 << 30), 1 << 30)
        assert fixed.divide(a, b, 16) == pytest.approx((a << 16) / b, rel=1e-5, abs=2) if abs(a / b) < 30000 else True
        x = dice.randint(1 << 16, (1 << 31) - 1)
        assert fixed.square_root(x) == pytest.approx(x**0.5, rel=0.03)
    assert fixed.inverse(0, 30) == fixed.divide(5, 0, 16) == fixed.square_root(0) == 0
    seed = 0
    for want in (907633515, fixed.wrap(907633515 * 196314165 + 907633515)):
        seed = fixed.next_random(seed)
        assert seed == want


def _spectrum(order, dice):
    gaps = dice.dirichlet(np.full(order + 1, 4.0))
    return silk.stabilise((np.cumsum(gaps)[:-1] * 32768).astype(int).tolist(), (300, *(150,) * (order - 1), 300))


@pytest.mark.parametrize("order", [10, 16])
def test_filters_have_their_lines_as_roots(order):
    dice = np.random.default_rng(order)
    whole = 0
    for _ in range(40):
        spectrum = _spectrum(order, dice)
        a = silk.filter_of(spectrum)
        gain = silk.inverse_gain(a)
        assert gain >= silk.LEAST_INVERSE_GAIN
        one = np.concatenate([[1.0], -a / 4096, [0.0]])
        assert np.max(np.abs(np.roots(one[:-1]))) < 1
        # by floating point: the product of 1 - k^2 of the reflections, stepped down
        x, product = -one[1:-1], 1.0
        while len(x):
            r, rest = x[-1], x[:-1]
            product *= 1 - r * r
            x = (rest + r * rest[::-1]) / (1 - r * r)
        assert gain / (1 << 30) == pytest.approx(product, rel=0.01, abs=1e-5)
        angles = np.sort([t for s in (1, -1) for t in np.angle(np.roots(one + s * one[::-1])) if 1e-3 < t < np.pi - 1e-3])
        if len(angles) == order and np.max(np.abs(a)) < 20000:
            whole += np.max(np.abs(angles - spectrum * np.pi / 32768)) < 0.05
    assert whole >= 30
    assert silk.inverse_gain(np.full(order, 4096)) == 0


def test_lines_keep_their_distance():
    dice = random.Random(3)
    for order in (10, 16):
        book = _book(order)
        for _ in range(100):
            found = silk.lines(dice.randrange(32), [dice.randint(-10, 10) for _ in range(order)], book)
            assert (np.diff([0, *found, 1 << 15]) >= np.array(book.spacing)).all()
            wild = silk.stabilise([dice.randint(0, 32767) for _ in range(order)], book.spacing)
            assert (np.diff([0, *wild, 1 << 15]) >= np.array(book.spacing)).all()
    calm = list(range(3000, 33000, 3000))
    assert silk.stabilise(calm, (10,) * 11).tolist() == calm
    assert silk.sensitivity(np.array(calm))[3] == 2 * ((1 << 17) // 3000) and silk.sensitivity(np.array([1, 2, 20000]))[1] == 32767
    assert silk.residual_lines([0, 0, 1], [0, 0, 0], 11796).tolist() == [0, 0, (1024 - 102) * 11796 >> 16]


def test_gains_lags_and_taps():
    assert silk.gains([40, 4, 4, 4], 10, False)[1] == 40 and silk.gains([0], 40, False)[1] == 24 and silk.gains([40], 60, True)[1] == 63
    rising = [silk.gains([k], 0, False)[0][0] for k in range(64)]
    assert rising == sorted(rising) and rising[0] < 1 << 18 and rising[-1] > 1 << 30
    assert silk.lags(0, 0, silk.Layout(16, 20)) == [32] * 4 and silk.lags(10, 33, silk.Layout(16, 20)) == [33, 39, 45, 51]
    assert silk.lags(999, 1, silk.Layout(8, 10)) == [144, 144] and silk.taps(2, [31, 0])[0].tolist() == [256, 0, 1152, 1280, 11264]


@pytest.mark.parametrize("rate", [8, 12, 16])
def test_indices(rate):
    layout = silk.Layout(rate, 20)
    book, dice = _book(layout.order), random.Random(rate)
    for _ in range(30):
        written = dice.randrange(2, 4)
        coder = rangecoder.Encoder()
        coder.symbol(written, silk.ACTIVE_TYPE, 8)
        kind, offset = divmod(written + 2, 2)
        own = [dice.randrange(64), *(dice.randrange(41) for _ in range(3))]
        coder.symbol(own[0] >> 3, silk.GAIN_HIGH[kind], 8)
        coder.symbol(own[0] & 7, silk.uniform(8), 8)
        for g in own[1:]:
            coder.symbol(g, silk.GAIN_STEP, 8)
        entry, steps = dice.randrange(32), [dice.randint(-9, 9) for _ in range(layout.order)]
        coder.symbol(entry, book.chances[kind == 2], 8)
        for v in steps:
            coder.symbol(max(-4, min(4, v)) + 4, book.residuals[0], 8)
            if abs(v) >= 4:
                coder.symbol(abs(v) - 4, silk.BEYOND, 8)
        coder.symbol(2, silk.QUARTERS, 8)
        lag = dice.randrange(32 * (rate // 2))
        coder.symbol(lag // (rate // 2), silk.LAG_HIGH, 8)
        coder.symbol(lag % (rate // 2), silk.uniform(rate // 2), 8)
        coder.symbol(5, silk.CONTOUR[layout.pitch], 8)
        coder.symbol(1, silk.TAP_BOOK, 8)
        for t in (0, 15, 7, 3):
            coder.symbol(t, silk.TAP_ENTRY[1], 8)
        coder.symbol(2, silk.CARRY, 8)
        coder.symbol(3, silk.uniform(4), 8)
        got = silk.indices(rangecoder.Decoder(coder.bytes()), layout, book, True)
        assert got == silk.Indices(kind, offset, own, entry, steps, 2, lag, 5, 1, [0, 15, 7, 3], 2, 3)


def _by_float(source, gain, a, lag=None, tap=None):
    y, s = [], []
    for n, e in enumerate(source):
        v = e / 16384
        if lag:
            v += sum(tap[j] / 16384 * y[n - lag + 2 - j] for j in range(5) if n - lag + 2 - j >= 0)
        y.append(v)
        s.append(v + sum(a[k] / 4096 * s[n - 1 - k] for k in range(len(a)) if n > k))
    return np.array(s) * gain / 65536


@pytest.mark.parametrize("voiced", [False, True])
def test_synthesis(voiced):
    layout = silk.Layout(16, 20)
    dice = np.random.default_rng(4)
    a = silk.filter_of(_spectrum(16, dice))
    source = silk.excitation(dice.integers(-3, 4, layout.samples).tolist(), 2 * voiced, 0, 1)
    lag, tap = ([50] * 4, np.tile(silk.taps(0, [0]), (4, 1))) if voiced else (None, None)
    got = silk.Channel(layout).synthesise(source, [65536 * 40] * 4, [a, a], False, lag, tap, 15565)
    want = _by_float(source, 65536 * 40, a, 50 if voiced else None, silk.taps(0, [0])[0])
    assert np.max(np.abs(got - np.clip(want, -32768, 32767))) <= 3 + 0.002 * np.max(np.abs(want))
    # two frames as one: the state goes on
    channel = silk.Channel(layout)
    again = [channel.synthesise(source, [65536 * 40] * 4, [a, a], False, lag, tap, 16384) for _ in range(2)]
    both = _by_float(source * 2, 65536 * 40, a, 50 if voiced else None, silk.taps(0, [0])[0])
    assert np.max(np.abs(np.concatenate(again) - np.clip(both, -32768, 32767))) <= 5 + 0.02 * np.max(np.abs(both))


def test_whitening_undoes_a_filter():
    a = np.array([2048, -1024])
    x = [1000, 500]
    for _ in range(50):
        x.append((2048 * x[-1] - 1024 * x[-2] + 2048) >> 12)
    assert np.max(np.abs(silk.whiten(np.array(x), a))) <= 1


def test_a_frame_from_its_indices():
    layout, book, dice = silk.Layout(8, 20), _book(10), random.Random(9)
    channel = silk.Channel(layout)
    for k in range(3):
        ix = silk.Indices(2, 0, [20, 4, 4, 4], k, [0] * 10, 2, 40, 0, 1, [2] * 4, 0, k)
        out = channel.frame(ix, [dice.randint(-2, 2) for _ in range(layout.samples)], book, k > 0)
        assert len(out) == 160 and out.any() and np.max(np.abs(out)) <= 32768
        assert ix.quarters == (2 if k else 4)


def test_stereo():
    for want in ((0, 0, 0, 0, 0), (24, 2, 4, 1, 3), (12, 1, 2, 1, 2), (7, 0, 4, 2, 0)):
        coder = rangecoder.Encoder()
        for v, chances in zip(want, (silk.WEIGHT_PAIR, silk.uniform(3), silk.uniform(5), silk.uniform(3), silk.uniform(5)), strict=True):
            coder.symbol(v, chances, 8)
        coder.symbol(1, silk.NO_SIDE, 8)
        decoder = rangecoder.Decoder(coder.bytes())
        first, second = silk.stereo_weights(decoder)
        near = [np.interp((3 * c + t) + (2 * f + 1) / 10, range(16), silk.WEIGHTS) for c, t, f in ((want[0] // 5, want[1], want[2]), (want[0] % 5, want[3], want[4]))]
        assert abs(first + second - near[0]) < 12 and abs(second - near[1]) < 12 and silk.side_is_missing(decoder)
    mid, side = np.arange(160) * 10, np.arange(160)
    stereo = silk.Stereo()
    left, right = stereo.unmix(mid, side, (0, 0), 8)
    assert left[1:].tolist() == (mid + side)[:-1].tolist() and right[1:].tolist() == (mid - side)[:-1].tolist()
    flat = np.full(160, 1000)
    stereo = silk.Stereo()
    left, right = stereo.unmix(flat, flat * 0, (4096, 0), 8)
    assert left[70:].tolist() == [1500] * 90 and right[70:].tolist() == [500] * 90 and (np.diff(left[2:64]) >= 0).all()
    stereo.forget_side()
    assert stereo.weights == (0, 0) and stereo.mono(flat).tolist() == [1000] * 160


@pytest.mark.parametrize("rate", [8, 12, 16])
def test_to_48_khz(rate):
    n = 100 * rate
    x = np.round(10000 * np.sin(2 * np.pi * 1000 * np.arange(n) / (1000 * rate))).astype(int)
    whole = silk.Resampler(rate).run(x)
    assert len(whole) == 4800
    parts, again = silk.Resampler(rate), []
    for at in range(0, n, 20 * rate):
        again.append(parts.run(x[at : at + 20 * rate]))
    assert np.concatenate(again).tolist() == whole.tolist()
    spectrum = np.abs(np.fft.rfft(whole[480:4320] * np.hanning(3840)))
    assert np.argmax(spectrum) == 80 and np.max(np.abs(whole[480:4320])) == pytest.approx(10000, rel=0.03)
    with pytest.raises(ValueError, match="millisecond"):
        parts.run(x[:3])
