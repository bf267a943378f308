"""A small stream is written by hand and decoded; what must come out is computed with the defining sums."""

import numpy as np
import pytest

from timbral.functions.bits import LowWriter
from timbral.operators import codebook, floor, mdct
from timbral.sources import ogg, vorbis

INFO = vorbis.Info(2, 44100, 64, 256)


def setup(kind, coupling):
    classbook = codebook.Codebook(1, [1, 1])
    vectors = codebook.Codebook(2, codebook.flat_lengths(9), 1, codebook.float_pack(-1.0), codebook.float_pack(1.0), False, [0, 1, 2])
    s = vorbis.Setup([classbook, vectors])
    s.floors = [vorbis.Floor([0], [vorbis.FloorClass(1, 0, -1, [-1])], 1, 7, [0, 128, 64])]
    s.residues = [vorbis.Residue(kind, 0, 256, 8, 0, [[-1] * 8, [1, *[-1] * 7]])]
    s.mappings = [vorbis.Mapping(coupling, [0, 0], [(0, 0)])]
    s.modes = [(False, 0), (True, 0)]
    return s


def packet(s, long, before, after, spectrum, height):
    """Bits of a block whose residues are whole numbers from -1 to 1."""
    w, d = LowWriter(), s.residues[0]
    w.write(0, 1)
    w.write(long, 1)
    if long:
        w.write(before, 1)
        w.write(after, 1)
    for _ in range(2):
        w.write(1, 1)
        w.write(height, 8)
        w.write(height, 8)
    rows = spectrum.T.reshape(1, -1) if d.kind == 2 else spectrum
    for part in range(rows.shape[1] // d.size):
        own = rows[:, part * 8 : part * 8 + 8].astype(int)
        for v in own:
            s.books[0].write_entry(w, int(v.any()))
        for v in own:
            if v.any():
                pairs = v.reshape(2, 4).T if d.kind == 0 else v.reshape(4, 2)
                for a, b in pairs:
                    s.books[1].write_entry(w, (a + 1) + 3 * (b + 1))
    return w.bytes()


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("coupling", [[], [(0, 1)]])
def test_stream(kind, coupling):
    rng, s = np.random.default_rng(kind), setup(kind, coupling)
    shapes = [False, False, True, True, False, True, False]
    packets, middle, total = [], 0, np.zeros((2, 4000))
    middles = []
    for i, long in enumerate(shapes):
        n = 256 if long else 64
        before, after = i > 0 and shapes[i - 1], i + 1 < len(shapes) and shapes[i + 1]
        c = rng.integers(-1, 2, (2, n // 2)).astype(float)
        packets.append(packet(s, long, before, after, c, 200))
        if coupling:
            c = np.stack(floor.uncouple(*c))
        block = (c * floor.decibels()[200]) @ mdct.basis(n // 2).T * vorbis.window(n, INFO, before, after)
        middle += (256 if i and shapes[i - 1] else 64) // 4 + n // 4 if i else 1000
        total[:, middle - n // 2 : middle + n // 2] += block
        middles.append(middle)
    expected = total[:, middles[0] : middles[-1]]
    made = middles[-1] - middles[0]
    headers = [(vorbis.encode_info(INFO), 0), (vorbis.encode_comments("v", ["A=b"]), 0), (vorbis.encode_setup(s, 2), 0)]
    for cut in (0, 5):
        content = ogg.mux([*headers, *((p, made - cut) for p in packets)], 4)
        info, comments, x = vorbis.decode(content)
        assert info == INFO and comments == ["A=b"] and x.shape == (2, made - cut)
        assert np.abs(x - expected[:, : made - cut]).max() < 1e-4


def test_windows_are_power_complementary():
    for a, b in ((64, 256), (256, 64), (256, 256), (64, 64)):
        left = vorbis.window(a, INFO, False, b == 256)[a // 2 :]
        right = vorbis.window(b, INFO, a == 256, False)[: b // 2]
        size = a // 4 + b // 4
        one, two = np.zeros(size), np.zeros(size)
        one[: min(len(left), size)] = left[:size]
        two[size - min(len(right), size) :] = right[-size:]
        assert np.allclose(one**2 + two**2, 1)


def test_setup_round_trip_and_damage():
    s = setup(2, [(0, 1)])
    data = vorbis.encode_setup(s, 2)
    again = vorbis.parse_setup(data, 2)
    assert (again.floors, again.residues, again.mappings, again.modes) == (s.floors, s.residues, s.mappings, s.modes)
    for cut in range(0, len(data) - 1, 3):
        with pytest.raises(ValueError):
            vorbis.parse_setup(data[:cut], 2)
    for i in range(len(vorbis.encode_info(INFO))):
        with pytest.raises(ValueError):
            vorbis.parse_info(vorbis.encode_info(INFO)[:i])
