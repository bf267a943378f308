import itertools
import random

import numpy as np
import pytest

from timbral.functions.bits import Low, LowWriter
from timbral.operators import codebook, floor


def test_codewords_of_the_format_description():
    words = codebook.codewords([2, 4, 4, 4, 4, 2, 3, 3])
    assert words == [0b00, 0b0100, 0b0101, 0b0110, 0b0111, 0b10, 0b110, 0b111]


@pytest.mark.parametrize("lengths", [[1, 1, 1], [2, 2, 2], [1, 3, 3]])
def test_incomplete_codes_are_rejected(lengths):
    with pytest.raises(ValueError):
        codebook.codewords(lengths)


def test_lengths_are_optimal():
    dice = random.Random(4)
    for _ in range(40):
        counts = [dice.randrange(0, 50) for _ in range(dice.randrange(2, 7))]
        lengths = codebook.lengths_from_counts(counts, 4)
        assert codebook.is_complete(lengths)
        used = [c for c in counts if c]
        if len(used) > 1:
            best = min(sum(c * n for c, n in zip(used, ns, strict=True)) for ns in itertools.product(range(1, 5), repeat=len(used)) if sum(2.0**-n for n in ns) <= 1)
            assert sum(c * n for c, n in zip(counts, lengths, strict=True)) == best


@pytest.mark.parametrize("lengths", [[2, 4, 4, 4, 4, 2, 3, 3], [1, 2, 3, 3], [0, 1, 0, 1], codebook.flat_lengths(11)])
@pytest.mark.parametrize("lookup", [0, 1, 2])
def test_codebook_round_trip(lengths, lookup):
    count = {0: 0, 1: codebook.lattice_values(len(lengths), 2), 2: 2 * len(lengths)}[lookup]
    book = codebook.Codebook(2, lengths, lookup, codebook.float_pack(-1.5) if lookup else 0, codebook.float_pack(0.25) if lookup else 0, lookup == 2, list(range(count)))
    w = LowWriter()
    book.encode(w)
    entries = [i for i, n in enumerate(lengths) if n] * 3
    for e in entries:
        book.write_entry(w, e)
    r = Low(w.bytes())
    again = codebook.parse(r)
    assert (again.lengths, again.values) == (book.lengths, book.values) and [again.scalar(r) for _ in entries] == entries
    if lookup == 1:
        assert again.vector(entries[0]).tolist() == [-1.5 + 0.25 * (entries[0] % count), -1.5 + 0.25 * (entries[0] // count % count)]
    if lookup == 2:
        assert again.vector(0).tolist() == [-1.5, -1.5 + -1.25]


def test_packed_floats():
    for v in (0.0, 1.0, -0.375, 1e-6, 123456.0, -2.0**20):
        assert codebook.float_unpack(codebook.float_pack(v)) == pytest.approx(v, rel=1e-6)


def test_build_by_book(spark):
    rows = [(b, e, (b * 7 + e * 3) % 11) for b in range(3) for e in range(8)]
    found = codebook.build(spark.createDataFrame(rows, "book long, entry long, count long")).collect()
    for b in range(3):
        assert codebook.is_complete([r.length for r in found if r.book == b])


def test_floor_lines():
    for x1, y0, y1 in itertools.product((1, 7, 20), (0, 5, 13), (0, 2, 30)):
        assert floor.line(0, y0, x1, y1).tolist() == [floor.point(0, y0, x1, y1, x) for x in range(x1)]
    assert floor.neighbours([0, 128, 12, 46, 4, 8], 3) == (2, 1) and floor.neighbours([0, 128, 12, 46, 4, 8], 5) == (4, 2)
    table = floor.decibels()
    assert table[0] == pytest.approx(1.0649863e-07) and table[255] == pytest.approx(1.0)
    flat = floor.curve([0, 128, 64], [100, 100, 0], 1, 128)
    assert np.allclose(flat, table[100])
    bent = floor.curve([0, 128, 64], [100, 100, 20], 1, 128)
    assert bent[0] == table[100] and bent[64] == table[110]


def test_uncouple():
    m, a = np.array([5, 5, -5, -5, 0.0]), np.array([2, -2, 2, -2, 3.0])
    left, right = floor.uncouple(m, a)
    assert left.tolist() == [5, 3, -5, -3, 0] and right.tolist() == [3, 5, -3, -5, 3]
