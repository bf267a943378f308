"""Round trips and broken inputs of the media formats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import bits, checksums, opus, pcm, rangecoder, tags
from timbral.operators import lpc, mdct
from timbral.sources import files, flac, ogg, wav

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("channels", [1, 2, 6])
@pytest.mark.parametrize(("depth", "is_float"), [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
def test_wav_round_trip(depth, is_float, channels):
    form = wav.Format(44100, channels, depth, is_float)
    x = RNG.uniform(-1, 1, (channels, 101)).astype(f"f{depth // 8}") if is_float else RNG.integers(-(2 ** (depth - 1)), 2 ** (depth - 1), (channels, 101))
    for streaming in (False, True):
        found, data, frames = wav.parse(wav.encode(form, x, streaming))
        assert found == form and (wav.samples(found, data)[:, :101] == x).all()
        assert frames == (None if streaming else 101)


def test_wav_rounds_and_clamps_floats():
    content = wav.encode(wav.Format(8000, 1, 16), np.array([[2.0, -2.0, 0.5 / 32768, -0.5 / 32768, 0.25]]))
    form, data, _ = wav.parse(content)
    assert wav.samples(form, data)[0].tolist() == [32767, -32768, 1, -1, 8192]


@pytest.mark.parametrize("cut", [0, 3, 11, 12, 20, 30, 43])
def test_wav_broken(cut):
    content = wav.encode(wav.Format(8000, 1, 16), np.zeros((1, 4), np.int64))
    with pytest.raises(ValueError):
        wav.parse(content[:cut])


def test_bits():
    dice = random.Random(1)
    fields = [(dice.getrandbits(n), n) for n in (dice.randrange(1, 33) for _ in range(200))]
    for writer, reader in ((bits.HighWriter, bits.High), (bits.LowWriter, bits.Low)):
        w = writer()
        for v, n in fields:
            w.write(v, n)
        r = reader(w.bytes())
        assert [r.read(n) for _, n in fields] == [v for v, _ in fields]
        with pytest.raises(bits.EndOfData):
            r.read(9)
    r = bits.Low(b"\x05")
    assert r.peek(16) == (5, 8) and r.read(3) == 5


def test_crc_check_values():
    assert checksums.crc(b"123456789", 8) == 0xF4 and checksums.crc(b"123456789", 16) == 0xFEE8 and checksums.crc(b"123456789", 32) == 0x89A1897F


SIGNALS = {
    "silence": np.zeros(1500), "constant": np.full(1500, 5), "ramp": np.arange(1500) % 60, "sine": (60 * np.sin(np.arange(1500) * 0.05)).round(),
    "noise": RNG.integers(-128, 128, 1500), "square": np.where(np.arange(1500) % 50 < 25, 127, -128), "steps": np.arange(1500) // 100 * 4,
}


@pytest.mark.parametrize("channels", [1, 2, 3])
@pytest.mark.parametrize("depth", [8, 16, 24])
def test_flac_round_trip(depth, channels):
    for v in SIGNALS.values():
        x = np.stack([np.roll(v, i).astype(np.int64) << (depth - 8) for i in range(channels)])
        meta, y = flac.decode(flac.encode(x, 44100, depth, 576))
        assert (x == y).all() and meta.info.total_samples == 1500


@pytest.mark.parametrize("block", [16, 17, 192, 576, 1000, 4096])
@pytest.mark.parametrize("n", [1, 15, 16, 100, 4097])
def test_flac_block_sizes(block, n):
    x = RNG.integers(-1000, 1000, (2, n))
    assert (flac.decode(flac.encode(x, 48000, 16, block, max_lpc=0))[1] == x).all()


def test_flac_compresses():
    size = lambda x: len(flac.encode(np.asarray(x, np.int64)[None], 44100, 16, 4096)) / (2 * len(x))
    t = np.arange(20000)
    assert size(np.zeros(20000)) < 0.02 and size(np.full(20000, 77)) < 0.02 and size(t) < 0.35 and size((12000 * np.sin(t * 0.05)).round()) < 0.6


def test_flac_mid_side_is_exact():
    left, right = (v.ravel() for v in np.meshgrid(np.arange(-40, 41), np.arange(-40, 41)))
    assert (flac.undecorrelate(np.stack([(left + right) >> 1, left - right]), flac.MID_SIDE) == np.stack([left, right])).all()


def test_flac_rejects_damage():
    content = bytearray(flac.encode(RNG.integers(-1000, 1000, (1, 500)), 44100, 16, 576))
    for at in range(60, len(content), 97):
        bad = bytes([*content[:at], content[at] ^ 16, *content[at + 1 :]])
        with pytest.raises(ValueError):
            flac.decode(bad)


def stream(sizes, serial=7):
    return ogg.mux([(bytes([i % 251]) * n, i) for i, n in enumerate(sizes)], serial)


def test_ogg_tables(spark, tmp_path):
    sizes = [10, 255, 0, 510, 20000, 4096, 70000, 1]
    pages = [ogg.page(p["header_type"], -1 if p["granule"] is None else p["granule"], 7, p["sequence"], p["segments"], p["payload"]) for p in ogg.pages(stream(sizes))]
    (tmp_path / "whole.ogg").write_bytes(b"junk OggS junk" + stream(sizes))
    (tmp_path / "two.ogg").write_bytes(stream([3, 4]) + stream([5]) + stream([600], 9))
    (tmp_path / "gap.ogg").write_bytes(stream([100] * 50)[:0] + b"".join(pages[:2] + pages[3:]))
    table = ogg.read_pages(spark, str(tmp_path))
    found = ogg.packets(table).orderBy("path", "serial", "chain", "packet_no").collect()
    of = lambda name: [(r.serial, r.chain, len(r.data), r.granule, r.hole_before) for r in found if name in r.path]
    assert [x[2] for x in of("whole")] == sizes and not any(x[4] for x in of("whole")) and of("whole")[-1][3] == 7
    assert [x[:3] for x in of("two")] == [(7, 1, 3), (7, 1, 4), (7, 2, 5), (9, 1, 600)]
    lost = [x[2] for x in of("gap.")]
    assert lost == [10, 255, 0, 510, 20000, 4096, 1] and [x[4] for x in of("gap.")] == [False] * 6 + [True]
    again = ogg.write(ogg.packets(table.filter("path like '%whole%'"))).first().content
    assert [p["payload"] for p in ogg.pages(again)] == [p["payload"] for p in ogg.pages(stream(sizes))]


def test_flac_tables(spark, tmp_path):
    x = RNG.integers(-1000, 1000, (2, 3000))
    frame = spark.createDataFrame([("a.flac", x.tolist())], "name string, channels array<array<bigint>>")
    assert files.save(flac.write(frame, 48000, 16, 1024), f"file://{tmp_path}/f").count() == 1
    (tmp_path / "f/bad.flac").write_bytes(b"fLaC nonsense")
    rows = flac.read(spark, f"{tmp_path}/f").orderBy("path", "first_sample").collect()
    assert (np.concatenate([np.array(r.channels) for r in rows if r.error is None], axis=1) == x).all()
    assert [r.error is not None for r in rows if "bad" in r.path] == [True]
    assert flac.read_metadata(spark, f"{tmp_path}/f").filter("error is null").first().total_samples == 3000


def test_flac_in_ogg():
    x = RNG.integers(-1000, 1000, (2, 3000))
    content = flac.encode(x, 48000, 16, 1024)
    meta, at = flac.metadata(content)
    frames = []
    while at < len(content):
        end = flac.decode_frame(content, at, meta.info)[2]
        frames.append(content[at:end])
        at = end
    head = b"\x7fFLAC\x01\x00\x00\x01fLaC\x00\x00\x00\x22" + meta.info.encode()
    comments = tags.encode("me", ["TITLE=x"])
    block = bytes([0x84]) + len(comments).to_bytes(3, "big") + comments
    meta, y = flac.decode(ogg.mux([(head, 0), (block, 0), *((f, i) for i, f in enumerate(frames))], 3))
    assert (x == y).all() and meta.comments == ["TITLE=x"]


def test_tags(spark):
    data = tags.encode("v", ["ARTIST=a=b", "title=ñ", "Artist=c"], True)
    assert tags.parse(data, True) == ("v", ["ARTIST=a=b", "title=ñ", "Artist=c"])
    for cut in range(len(data) - 1):
        with pytest.raises(ValueError):
            tags.parse(data[:cut], True)
    row = spark.createDataFrame([(data,)], "d binary").select(tags.parse_column(F.col("d"), True).alias("t")).select(pcm.tags_get(F.col("t.comments"), "artist").alias("a"), pcm.tags_first(F.col("t.comments"), "none").alias("n")).first()
    assert row.a == ["a=b", "c"] and row.n == ""


def test_opus_packets(spark):
    two = opus.parse(bytes([0b00001010 | 1 << 3, 3]) + b"abcde")
    assert two.frames == [b"abc", b"de"]
    many = opus.parse(bytes([1 << 3 | 3, 0b11000011, 2, 1, 2]) + b"a" + b"bb" + b"ccc" + b"\0\0")
    assert many.frames == [b"a", b"bb", b"ccc"] and many.padding == 2
    for bad in (b"", b"\x03", b"\x03\x00", b"\x01a", b"\x02", b"\x02\xfc", bytes([3, 49])):
        with pytest.raises(ValueError):
            opus.parse(bad)
    rows = spark.createDataFrame([(b"\x08abc",), (b"\x01a",), (None,)], "d binary").select(opus.parse_column(F.col("d")).alias("p")).collect()
    assert rows[0].p.mode == "silk" and rows[0].p.samples == 960 and [r.p.error is None for r in rows] == [True, False, False]


def test_opus_head():
    for head in (opus.Head(2, 312, 48000, -256, coupled=1, mapping=(0, 1)), opus.Head(3, 0, 44100, 5, 1, 2, 1, (0, 2, 1)), opus.Head(1, 0, 8000, 0, mapping=(0,))):
        assert opus.parse_head(opus.encode_head(head)) == head
    assert opus.parse_tags(opus.encode_tags("v", ["a=b"])) == ("v", ["a=b"])
    with pytest.raises(ValueError):
        opus.parse_head(b"OpusHead" + bytes(11))


@pytest.mark.parametrize("seed", range(20))
def test_range_coder_lockstep(seed):
    dice, coder, done = random.Random(seed), rangecoder.Encoder(), []
    table = (200, 120, 30, 0)
    for _ in range(60):
        kind = dice.randrange(4)
        if kind == 0:
            p = dice.randrange(1, 15)
            done.append((lambda d, p=p: d.bit(p), dice.random() < 2**-p))
            coder.bit(done[-1][1], p)
        elif kind == 1:
            done.append((lambda d: d.symbol(table, 8), dice.randrange(4)))
            coder.symbol(done[-1][1], table, 8)
        elif kind == 2:
            n = dice.randrange(1, 17)
            done.append((lambda d, n=n: d.raw(n), dice.getrandbits(n)))
            coder.raw(done[-1][1], n)
        else:
            t = dice.randrange(2, 1 << 20)
            done.append((lambda d, t=t: d.uniform(t), dice.randrange(t)))
            coder.uniform(done[-1][1], t)
    decoder = rangecoder.Decoder(coder.bytes())
    assert all(read(decoder) == v for read, v in done)
    assert 0 <= 8 * decoder.tell() - decoder.tell_eighths() < 8


def test_mdct():
    for n in (8, 32, 128):
        x, w = RNG.uniform(-1, 1, 6 * n), mdct.power_window(2 * n)
        y = np.zeros(6 * n)
        for at in range(0, 5 * n, n):
            y[at : at + 2 * n] += mdct.inverse(mdct.forward(x[at : at + 2 * n] * w)) * w
        assert np.abs(y[n : 5 * n] - x[n : 5 * n]).max() < 1e-9
        assert np.allclose(w[:n] ** 2 + w[n:] ** 2, 1)
        c = RNG.normal(size=(2, n))
        assert np.allclose(mdct.inverse(c), c @ mdct.basis(n).T)


def test_lpc():
    x = np.zeros(4000)
    for i in range(2, 4000):
        x[i] = 1.2 * x[i - 1] - 0.5 * x[i - 2] + RNG.normal()
    found, errors = lpc.levinson(lpc.autocorrelate(x, 4), 4)
    assert np.allclose(found[1], [1.2, -0.5], atol=0.06) and all(a >= b for a, b in zip(errors, errors[1:], strict=False))
    q, shift = lpc.quantise(found[1], 12)
    assert np.abs(q / 2**shift - found[1]).max() < 2**-9


def test_pcm_columns(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    ints = F.array(*(F.lit(v) for v in (1, -2, 3, -4, 5, -6)))
    assert row(pcm.deinterleave(ints, 2)).asDict(True).popitem()[1] == [[1, 3, 5], [-2, -4, -6]]
    assert row(pcm.interleave(pcm.deinterleave(ints, 3)))[0] == [1, -2, 3, -4, 5, -6]
    assert row(pcm.resize(ints, 3), pcm.resize(ints, 8))[0:2] == ([1, -2, 3], [1, -2, 3, -4, 5, -6, 0, 0])
    assert [row(pcm.unzigzag(pcm.zigzag(F.lit(v))))[0] for v in range(-3, 4)] == list(range(-3, 4))
    assert row(pcm.to_int(F.lit(1.5), 16), pcm.to_int(F.lit(-0.5 / 32768), 16), pcm.from_int(F.lit(-32768), 16))[0:3] == (32767, -1, -1.0)
    assert row(checksums.pcm_md5(ints, 16))[0] == flac.pcm_md5(np.array([[1, -2, 3, -4, 5, -6]]), 16).hex()
    assert row(pcm.wasted_bits(F.transform(ints, lambda x: x * 8)), pcm.rice_cost(F.array(F.lit(5), F.lit(0)), F.lit(1)))[0:2] == (3, 6)
    assert row(checksums.crc_column(F.lit(b"123456789"), 16))[0] == 0xFEE8
