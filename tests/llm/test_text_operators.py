"""Operators against brute force on a small corpus with null, empty, long, repeated and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.llm import decontaminate, jaccard, licenses, packing, sharding, simhash, suffix, tokens, toxicity, warc
from timbral.llm.common import ALNUM_WORDS, SPACE_WORDS, components, text_chunks, word_hash, words

#: Extra columns whose names the operators use themselves.
CLASH = ["score", "row", "key", "k1", "found", "__key", "__k1", "__id", "__again", "kept", "spans", "a.b"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)


def thue_morse(n):
    """Two words of n letters that a polynomial hash modulo a power of two cannot tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def corpus():
    dice = random.Random(5)
    vocabulary = ["the", "of", "Idiot", "garden", "blue", "sky", "river", "stone", "élan", "ñandú", "x1", "run", "house", "tree", "cloud"]
    say = lambda n: " ".join(dice.choice(vocabulary) + dice.choice(["", "", ",", ".", "s", str(dice.randrange(50))]) for _ in range(n))
    passage = say(60)
    texts = [None, "", "   \n\t", "one", "two words", "three short words", "THREE short Words", say(3000)]
    for i in range(40):
        base = say(dice.randrange(20, 200))
        texts.append(base)
        if i % 3 == 0:
            texts.append(base)
        if i % 4 == 0:
            w = base.split(" ")
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(say(30) + "\n" + passage + "\n" + say(20))
    texts += ["Released under the MIT License. " + say(10), "GNU General Public License, version 3.", "under the mit Licenses", "a" * 500, "ab" * 300, "日本語 中文 ½ " * 9, "a<|endoftext|>b", *thue_morse(1024), "x" * 30000]
    rows = [(i * 3 if i % 11 else None, t, "en", "s", None) for i, t in enumerate(texts)] + [(3, texts[1], "en", "s", 0), (9, texts[12], None, None, 1), (9, texts[12], None, None, 1)]
    return [(*r, *["clash"] * len(CLASH)) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    for kind, pattern in ((SPACE_WORDS, rb"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for _, data, offs in text_chunks(pa.array(texts), 700):
            _, _, h, by = words(data, offs, kind)
            got += [h[a:b].tolist() for a, b in zip(by[:-1], by[1:], strict=True)]
        assert got == [[word_hash(w.decode("utf-8", "surrogateescape")) for w in re.findall(pattern, lower(t).encode())] for t in texts]


def test_long_words_that_a_polynomial_confuses(spark):
    a, b = thue_morse(1024)
    assert len({word_hash(x * n) for x in (a, b) for n in (1, 2, 3)}) == 6
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert ordered((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs, 3, 90).collect()) == [(1, 1), (2, 2)]
    items = spark.createDataFrame([(1, b)], "item_id long, text string")
    assert ordered((r.doc_id, r.n_hit) for r in decontaminate.report(decontaminate.matches(docs, items)).collect()) == [(1, 0), (2, 1)]


def brute_jaccard(rows, k, percent, roots=False):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    if roots:
        return {find(i) for i in range(len(rows)) if sets[i] and find(i) in least}
    return [(r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_jaccard(docs, rows, k, percent):
    assert ordered(jaccard.near_duplicates(docs, k, percent).collect()) == ordered(brute_jaccard(rows, k, percent))


def test_jaccard_keeps_one_of_each_component(docs, rows, empty):
    kept = jaccard.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    marked = brute_jaccard(rows, 3, 90)
    wordless = [r for r, (_, n, _) in zip(rows, marked, strict=True) if not n]
    got = ordered((r.doc_id, r.text) for r in kept.collect())
    named = {c for _, n, c in marked if n and c is not None}
    assert len([g for g in got if (g[1] or "").strip() and g[0] is not None]) == len(brute_jaccard(rows, 3, 90, roots=True))
    assert {g[0] for g in got if (g[1] or "").strip() and g[0] is not None} == named
    assert len([g for g in got if not (g[1] or "").strip()]) == len(wordless)
    assert jaccard.keep_one(empty, 3, 90).collect() == []


def test_hot_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 60], f"edit{i}", *base[i % 60 :]]), *[None] * (3 + len(CLASH))) for i in range(300)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()
    assert ordered(found) == ordered(brute_jaccard(rows, 3, 90))


def test_few_pairs_of_near_copies_in_round_two(spark, monkeypatch):
    """Copies of one text with one to eight edits each: most link, but few with a copy taken at random."""
    rng, listed = random.Random(3), {}
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        for j in rng.sample(range(150), 1 + i % 8):
            text[j] = f"edit{i}.{j}"
        rows.append((i, " ".join(text), *[None] * (3 + len(CLASH))))
    checked = jaccard._checked

    def counted(documents, marks, pairs, k, percent, name):
        listed[name] = pairs.count()
        return checked(documents, marks, pairs, k, percent, name)

    monkeypatch.setattr(jaccard, "_checked", counted)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()
    assert ordered(found) == ordered(brute_jaccard(rows, 5, 80))
    assert listed["links2"] < 400


def test_copies_in_many_tasks_make_no_more_pairs(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[: 9 * i], f"edit{i}", *base[9 * i :]]) for i in range(5)]
    docs = spark.createDataFrame([(i, texts[i // 40], *[None] * (3 + len(CLASH))) for i in range(200)], SCHEMA).repartition(4)
    made, checked = {}, jaccard._checked

    def kept(*args):
        made[args[-1]] = checked(*args)
        return made[args[-1]]

    monkeypatch.setattr(jaccard, "_checked", kept)
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs, 3, 90).collect()} == {(i, 0) for i in range(200)}
    assert made["links1"].count() == made["links1"].distinct().count() > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 99), (50, 60), (60, 50), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 99: 99, 100: 99, 101: 99, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_marks(rows, length):
    """Each text's bytes and as many marks, 1 where a byte goes."""
    seen = {}
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield t, bytes(gone)


def brute_kept(rows, length):
    return [bytes(b for b, g in zip(t, gone, strict=True) if not g) for t, gone in brute_marks(rows, length)]


def brute_suffix(rows, length):
    marks = [(sum(gone), len(re.findall(rb"\x01+", gone))) for _, gone in brute_marks(rows, length)]
    return [(r[0], *m, hashlib.sha256(kept).hexdigest()) for r, m, kept in zip(rows, marks, brute_kept(rows, length), strict=True)]


@pytest.mark.parametrize(("length", "trigger", "few"), [(200, 48, 128), (200, 48, 1), (60, 16, 3)])
def test_suffix(docs, rows, length, trigger, few, monkeypatch):
    monkeypatch.setattr(suffix, "FEW", few)
    found = suffix.spans(docs, length, trigger).select("doc_id", suffix.removed().alias("n"), F.size("spans"), F.sha2("kept", 256))
    assert ordered(found.collect()) == ordered(brute_suffix(rows, length))


def test_suffix_clean(docs, rows, empty):
    out = suffix.clean(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert suffix.clean(empty).collect() == []


@pytest.mark.parametrize("length", [3, 8, 20, 200])
def test_byte_order(length):
    data = np.frombuffer(("ab\0" * 40 + "é" * 90 + "ab\0" * 40 + "a" * 300).encode(), np.uint8)
    rank, text = suffix.byte_order(data, length), data.tobytes()
    windows = [text[i : i + length] for i in range(len(text) - length + 1)]
    assert [sorted(set(windows)).index(w) for w in windows] == np.unique(rank[: len(windows)], return_inverse=True)[1].tolist()


def brute_hits(rows, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for r in rows:
        w = re.findall(pattern, lower(r[1]))
        hit, found = set(), set()
        for item, text in items:
            v = re.findall(pattern, lower(text))
            for i in range(max(len(v) - window + 1, min(len(v), 1))):
                p = v[i : i + window]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 9000).split(" ")
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[500:507])), (10, "two WORDS"), (3, None), (4, ""), (5, "!!"), (None, "three short"), (6, " ".join(long[100:113]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute_hits(rows, items, 13)
    assert ordered(decontaminate.report(decontaminate.matches(docs, bench)).drop("n_near").collect()) == ordered(expected)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not e[5] for e in expected)
    assert decontaminate.report(decontaminate.matches(empty, bench)).collect() == []
    none = bench.filter("false")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.report(decontaminate.matches(docs, none)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a quick red fox jumps"), (2, "quick fox"), (3, "fox then a quick")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick fox")], "item_id long, text string")
    found = {r.doc_id: [h.exact for h in r.hits] for r in decontaminate.matches(docs, items, slop=1).collect()}
    assert found == {1: [False], 2: [True], 3: []}
    assert {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.report(decontaminate.matches(docs, items, slop=1)).collect()} == {1: (0, 1), 2: (2, 0), 3: (0, 0)}


def test_licenses(docs, rows, empty):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    expected = []
    for r in rows:
        w = re.findall(pattern, lower(r[1]))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        expected.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    out = licenses.scan(docs, licenses.build_index(docs))
    assert ordered(out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == ordered(expected)
    for r in out.collect():
        assert 0 <= r.score <= 1 and {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")}
    assert licenses.scan(empty, licenses.build_index(empty)).collect() == []


def test_license_templates_are_found(spark):
    texts = [f"before it {t.text} and after it" for t in licenses.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(docs, licenses.build_index(docs)).collect()}
    assert all(t.label in found[i].labels.split(",") and any(s.label == t.label and s.start == 2 for s in found[i].spans) for i, t in enumerate(licenses.TEMPLATES))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_equals_library(tokenizer):
    import pyarrow as pa

    dice = random.Random(2)
    bits = ["a", "b", "'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", ".", "!!", "é", "ß", "×", "½", "中", "\x1c", " ", "re", "<|endoftext|>", "S", "_", "\r\n"]
    texts = ["".join(dice.choice(bits) for _ in range(dice.randrange(30))) for _ in range(3000)] + [None, ""]
    own = tokens.Encoder(tokens.default_path())
    for row, data, offs in text_chunks(pa.array(texts), 3000):
        ids, by = own.encode(data, offs)
        for i in range(len(by) - 1):
            assert ids[by[i] : by[i + 1]].tolist() == tokenizer.encode(texts[row + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table_round_trip(spark, docs, rows, tokenizer, encoding, tmp_path):
    out = f"file://{tmp_path}/t"
    tokens.write(docs, out, encoding=encoding)
    found = sorted(tokens.token_table(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert ordered((r.doc_id, tuple(r.ids)) for r in found) == ordered((r[0], (*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0)) for r in rows)
    for r in tokens.with_crc32(tokens.token_table(spark, out)).collect():
        assert r.ids_crc32 in {zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in found if x.start == r.start}


def test_token_table_of_nothing(spark, empty, tmp_path):
    tokens.write(empty, f"file://{tmp_path}/t")
    assert tokens.token_table(spark, f"file://{tmp_path}/t").collect() == []


@pytest.mark.parametrize(("size", "limit"), [(1024, 8192), (64, 2)])
def test_packing(docs, rows, empty, tokenizer, size, limit):
    pieces = packing.pack(docs, size=size, limit=limit)
    found = pieces.collect()
    of = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == of.get(r.sequence_id, 0) and len(r.ids) == r.length
        of[r.sequence_id] = r.offset + r.length
    assert max(of.values()) <= size
    texts = ordered((*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows)
    assert sum(r.length for r in found) == sum(map(len, texts))
    lone = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1}
    for i, ids in lone.items():
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [t for r in own for t in r.ids] == ids and [r.length for r in own[1:]] == [size] * (len(own) - 1) and own[0].start == 0
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(pieces).collect()}
    assert sorted(whole.values()) == sorted(of.values())
    assert packing.pack(empty).collect() == []


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_simhash(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    hashes = [r.h for r in docs.sparkSession.createDataFrame([(r[1] or "",) for r in rows], "text string").select(F.xxhash64("text").alias("h")).collect()]
    texts = [t for _, _, t in sorted((-1 if r[0] is None else r[0], h, r[1] or "") for r, h in zip(rows, hashes, strict=True))]
    expected = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        expected.append((len(t), hashlib.sha256((t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]).encode()).hexdigest()))
    found = simhash.compare(docs)
    assert ordered(found.select("n_chars", "edited_sha256").collect()) == ordered(expected)
    assert simhash.compare(empty).collect() == []
    one = docs.sparkSession.createDataFrame([rows[9]], SCHEMA)
    assert [r.fingerprint == r.next_fingerprint for r in simhash.compare(one).collect()] == [True]


def test_simhash_votes(spark):
    docs = spark.createDataFrame([(0, "a b c a b"), (1, "a b c a b"), (2, "")], "doc_id long, text string")
    term = [r.t for r in docs.select(F.explode(simhash.terms(F.col("text"))).alias("t")).limit(5).collect()]
    bits = [sum(t >> k & 1 for t in term) * 2 > len(term) for k in range(64)]
    found = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs, ["doc_id"]).collect()}
    assert found[0] == found[1] and found[0] % (1 << 64) == sum(b << k for k, b in enumerate(bits))


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_simhash_search_is_exact(spark, radius):
    dice = random.Random(radius)
    base = [dice.getrandbits(64) for _ in range(30)]
    values = [b ^ sum(1 << k for k in dice.sample(range(64), dice.randrange(6))) for b in base for _ in range(8)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = {(r["query"], r.fingerprint, r.distance) for r in simhash.search(prints.limit(40), prints, radius).collect()}
    queries = {r.fingerprint for r in prints.limit(40).collect()}
    assert found == {(a, b, bin((a ^ b) % (1 << 64)).count("1")) for a in queries for b in signed if bin((a ^ b) % (1 << 64)).count("1") <= radius}


def test_sharding(docs, rows, empty):
    found = sharding.shard(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert ordered((r.doc_id, r["size"], r.text_crc32) for r in found) == ordered((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    total = [sum(r["size"] for r in found if r.shard == s) for s in range(4)]
    assert max(total) - min(total) <= 2 * max(size(r[1]) for r in rows)
    assert sharding.shard(empty).collect() == []


def test_sharding_cuts_one_hot_group(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"own {i}") for i in range(3000)], "doc_id long, text string").repartition(3)
    sizes = {r.shard: r["sum(size)"] for r in sharding.shard(docs).groupBy("shard").sum("size").collect()}
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 40


PAGES = [(1, "http://a", "x" * 150), (2, "http://b", "x" * 150), (0, None, "x" * 150), (5, "u\r\nWARC-Type: evil", "y" * 99), (4, "u", "y" * 99), (7, "u", None), (8, "u", ""), (None, "u", "é" * 100), (9, "u", "é" * 100), (None, "u", "q" * 200), (None, "u", "q" * 200), (2, "http://b", "x" * 150), (11, "u", "a\r\n\r\nWARC/1.1" * 30)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    found = warc.records(spark, path)
    html = {(p[0], (p[2] or "").encode()) for p in PAGES}
    assert {(r.page_id, bytes(r.payload)) for r in found.collect()} == html and found.count() == len(PAGES)
    kinds = ordered(found.select("page_id", warc._field("WARC-Type"), warc._field("WARC-Refers-To")).collect())
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h] = min(i, least.get(h, i))
    expected = []
    for i, _, h in PAGES:
        again = h and len(h.encode()) >= 100 and h in least and i != least[h]
        expected.append((i, "revisit" if again else "response", f"<urn:page:{least[h]}>" if again else None))
    assert kinds == ordered(expected)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(p[2] or "") for p in PAGES})
    files = warc.export(spark, path, f"file://{tmp_path}/files").collect()
    assert sum(f.records for f in files) == len(PAGES)


def test_warc_finds_a_damaged_payload(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "page")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}/bad")
    (tmp_path / "w/payloads").rename(tmp_path / "w/old")
    (tmp_path / "w/bad").rename(tmp_path / "w/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.records(spark, path).collect()


def test_toxicity(spark, empty):
    dice = random.Random(1)
    fine = ["the tree is blue.", "a house by the river!", "clouds run.", "stone and sky?"]
    rows = []
    for i in range(600):
        parts = [dice.choice(fine) for _ in range(dice.randrange(1, 8))]
        if toxic := i % 5 == 0:
            parts.insert(dice.randrange(len(parts) + 1), f"you are an idiot number {dice.randrange(9)}.")
        rows.append((i, " ".join(parts), int(toxic)))
    docs = spark.createDataFrame([(r[0], r[1], "clash") for r in rows] + [(None, None, ""), (1000, "", ""), (1001, "idiot. " * 5000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if toxicity.crc_mod5(r[0]) == 0]
    assert all((found[r[0]].score >= 0.5) == bool(r[2]) for r in held) and len(found) == len(rows) + 3
    assert found[1001].score > 0.5 and found[None].score < 0.5 and found[1000].score < 0.5
    for r in held:
        if r[2]:
            spans = [r[1][s.start : s.end] for s in found[r[0]].offending]
            assert spans and all("idiot" in s for s in spans)
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert toxicity.score(empty, model).collect() == []
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("false"))).collect()} == {0.0}
