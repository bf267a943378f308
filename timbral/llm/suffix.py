"""Suffix-array deduplication by prefix-free parsing: remove every byte that is covered by a 200-byte string
which also starts somewhere else.

1. Parse.  A rolling hash of TRIGGER bytes runs over each text.  A trigger is the least hash among the
   places of a 200-byte window, so every window has exactly one, fixed by its content alone, and none is
   without.  The starts that share a trigger are one phrase: their windows together are its bytes.
2. Dictionary.  Phrases are known by the hashes of their trigger and of their bytes.  A trigger that occurs
   once in the corpus has no repeated window.  Of a phrase that occurs twice or more, all windows are
   repeated.
3. Suffixes.  What is left are windows in phrases that differ but share a trigger: the edges of repeated
   passages.  The bytes of each such dictionary phrase are read once, and those of the same triggers meet in a task,
   which builds their suffix array in byte order by prefix doubling, down to 200 bytes: suffixes that have an equal
   neighbour in it are repeated.  Where a trigger has very many phrases, the suffixes are dealt out over tasks by
   their hashes instead, after those that are equal within a task have merged.
4. The parse gives each dictionary phrase its places in the corpus.  The repeated starts of a text become spans, and
   the spans are cut out.

Phrases overlap by so much that every 200-byte window lies inside one, so the order of two windows, and whether they
are equal, is that of two dictionary suffixes; a suffix array of the parse would only order windows that are equal,
and is not built.  All counts are grouped sums with map-side merging: a passage or a copy in a third of all rows is a
few rows of each task.

Texts are UTF-8 bytes, null is empty, and texts under 200 bytes keep all.  Matches never span two texts.
Equal texts have equal results, whatever their ids, so spans are kept by a 128-bit hash of the text.
Repeated rows count as different places.  An empty table gives an empty result.  Extra columns are kept
by ``spans``, whose own columns (kept, spans) replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, free_name, in_bitmap, lean, map_all, mix, named, prefix_hash, read, stash, substring_hash, text_chunks

LENGTH = 200
TRIGGER = 48
#: Texts that a task remembers.
REMEMBER = 1 << 18
#: Phrases of one trigger up to this many are compared in one task, those of the others across tasks.
FEW = 128


def _window_min(values: np.ndarray, m: int) -> np.ndarray:
    """Least of each m consecutive values, in three passes over blocks of m."""
    n = len(values)
    padded = np.full(-(-n // m) * m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - m + 1], ahead[m - 1 : n])


def phrases(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, trigger hash, phrase hash) of all phrases of texts that follow each other."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length or (np.diff(offs) < length).all():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(n - trigger + 1)
    h = substring_hash(prefix, at, at + trigger)
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    least = _window_min(h & ~low | at.astype(np.uint64), length - trigger + 1) & low
    fits = np.zeros(n + 1, np.int8)  # starts whose window ends inside their text
    long = np.diff(offs) >= length
    np.add.at(fits, offs[:-1][long], 1)
    np.add.at(fits, offs[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(fits)[:n] > 0)
    anchor = least[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(start) != 1) | (np.diff(anchor) != 0))))
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    return begin, count, h[anchor[first]], substring_hash(prefix, begin, begin + count - 1 + length)


def _keys() -> tuple[Column, Column]:
    """Two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _occurrences(keyed: DataFrame, length: int, trigger: int, only: DataFrame | None = None) -> DataFrame:
    """ah, sh, k1, k2, s, len of every phrase, or of those whose ah may be among ``only``; a task tells of a
    text twice at most, which is as good as often."""
    shared = None if only is None else keyed.sparkSession.sparkContext.broadcast(bitmap(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            for row, data, offs in text_chunks(batch.column("text")):
                begin, count, ah, sh = phrases(data, offs, length, trigger)
                text = np.searchsorted(offs, begin, "right") - 1
                keep = np.zeros(len(offs) - 1, bool)
                for i in np.unique(text).tolist():
                    k = (int(keys[0][row + i]), int(keys[1][row + i]))
                    if len(seen) >= REMEMBER:
                        seen.clear()  # a text may be told of again
                    seen[k] = seen.get(k, 0) + 1
                    keep[i] = seen[k] <= 2
                use = keep[text]
                if shared is not None:
                    use &= in_bitmap(shared.value, ah.view(np.int64))
                text, begin = text[use], begin[use]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ah[use].view(np.int64), sh[use].view(np.int64), keys[0][row + text], keys[1][row + text], begin - offs[text], count[use])], ["ah", "sh", "k1", "k2", "s", "len"])

    return keyed.mapInArrow(lean(run), "ah bigint, sh bigint, k1 bigint, k2 bigint, s bigint, len bigint")


def _dictionary_bytes(keyed: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """ah, m, k1, k2, s, bytes of the needed phrases, read from their texts."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap(need.select("k1")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column("k1").to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["ah", "m", "k1", "k2", "s", "bytes"], None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, k1, k2, found in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2", "found")), strict=True):
                if (k1, k2) == last:
                    continue  # a copy
                last, raw = (k1, k2), text.encode()
                for x in found:
                    for to, v in zip(out, (x["ah"], x["m"], k1, k2, x["s"], raw[x["s"] : x["s"] + x["len"] - 1 + length]), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:5]), pa.array(out[5], pa.binary())], names)

    wanted = need.groupBy("k1", "k2").agg(F.collect_list(F.struct("ah", "m", "s", "len")).alias("found"))  # bounded by a text's length
    texts = keyed.mapInArrow(lean(likely), keyed.schema).join(wanted, ["k1", "k2"])
    return texts.mapInArrow(lean(run), "ah bigint, m bigint, k1 bigint, k2 bigint, s bigint, bytes binary")


def _suffixes(offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of all suffixes of at least ``length`` bytes of phrases with these offsets."""
    n = np.diff(offs) - length + 1
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(offs[:-1] - np.cumsum(n) + n, n)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches that are sorted by a key, cut so that no key goes on after a cut."""
    rest: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        values = batch.column(key).to_numpy()
        change = np.flatnonzero(values[1:] != values[:-1])
        last = rest[-1].column(key)[-1].as_py() if rest else values[0]
        at = int(change[-1]) + 1 if len(change) else 0 if last != values[0] else -1
        if at >= 0 and (rest or at):
            yield pa.Table.from_batches([*rest, batch.slice(0, at)]).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(max(at, 0)))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


_RUNS = "k1 bigint, k2 bigint, found array<struct<s:bigint,len:bigint>>"


def _runs(k1: np.ndarray, k2: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """A row for each text with the runs of its starts."""
    order = np.lexsort((s, k2, k1))
    k1, k2, s = k1[order], k2[order], s[order]
    text = np.ones(len(s), bool)
    text[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    run = text.copy()
    run[1:] |= np.diff(s) > 1
    first = np.flatnonzero(run)
    length = np.append(s[first[1:] - 1], s[-1:]) - s[first] + 1
    at = np.append(np.flatnonzero(text[first]), len(first)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(s[first]), pa.array(length)], ["s", "len"]))
    return pa.RecordBatch.from_arrays([pa.array(k1[text]), pa.array(k2[text]), lists], ["k1", "k2", "found"])


def byte_order(data: np.ndarray, length: int) -> np.ndarray:
    """The rank, in byte order, of the ``length`` bytes from each place on; equal bytes have equal ranks, and bytes
    beyond the end come before all others.  Each round doubles the depth to which suffixes are in order."""
    n, depth = len(data), min(8, length)
    ahead = np.append(data, np.zeros(depth, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = key << np.uint64(8) | ahead[j : j + n]
    rank = np.unique(key, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        follow = np.zeros(n, np.int64)
        follow[: max(n - step, 0)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1]
        depth += step
    return rank


def _neighbours(h: np.ndarray, k1: np.ndarray, k2: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Indices of the suffixes that have an equal one (by rank or hash) at another place; one place may come twice."""
    order = np.lexsort((s, k2, k1, h))
    if not len(h):
        return order
    first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    a, b = order[first], order[last]
    other = (k1[a] != k1[b]) | (k2[a] != k2[b]) | (s[a] != s[b])
    return order[np.repeat(other, last - first + 1)]


def _few(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts in phrases whose triggers have few phrases, which meet in one task a trigger.
    There the suffixes are put in byte order, and equal neighbours are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "ah"):
            _, data, offs = next(text_chunks(batch.column("bytes"), 1 << 62))
            row, at = _suffixes(offs, length)
            k1, k2, s = (batch.column(c).to_numpy()[row] for c in ("k1", "k2", "s"))
            s = s + at - offs[row]
            hit = _neighbours(byte_order(data, length)[at], k1, k2, s)
            yield _runs(k1[hit], k2[hit], s[hit])

    return pieces.repartition("ah").sortWithinPartitions("ah").mapInArrow(lean(run), _RUNS)


def _many(pieces: DataFrame, length: int) -> DataFrame:
    """The same for triggers with many phrases: their suffixes are dealt out by their hashes, to one more group
    for every FEW phrases.  Of suffixes that are equal within a batch only one is dealt; all of them are known."""

    def group_rows(g: np.ndarray, known: bool, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else order
        at = pa.array(np.append(first, len(g)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(np.full(len(first), known)), *(pa.ListArray.from_arrays(at, pa.array(x[order])) for x in columns)], ["g", "known", "h", "k1", "k2", "s"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in text_chunks(batch.column("bytes")):
                row, at = _suffixes(offs, length)
                k1, k2, s, ah, m = (batch.column(c).to_numpy()[first + row] for c in ("k1", "k2", "s", "ah", "m"))
                s, h = s + at - offs[row], substring_hash(prefix_hash(data), at, at + length)
                known, once = np.zeros(len(h), bool), np.zeros(len(h), bool)
                known[_neighbours(h, k1, k2, s)] = True
                once[np.unique(h, return_index=True)[1]] = True
                group = (ah.view(np.uint64) + mix(h % (-(-m // FEW)).astype(np.uint64))).view(np.int64)
                dealt = ~known | once
                yield group_rows(group[dealt], False, h[dealt].view(np.int64), k1[dealt], k2[dealt], s[dealt])
                yield group_rows(k1[known], True, h[known].view(np.int64), k1[known], k2[known], s[known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "g"):
            h, k1, k2, s = (batch.column(c).flatten().to_numpy() for c in ("h", "k1", "k2", "s"))
            known = np.repeat(batch.column("known").to_numpy(zero_copy_only=False), np.diff(batch.column("h").offsets.to_numpy()))
            new = np.flatnonzero(~known)
            hit = np.append(np.flatnonzero(known), new[_neighbours(h[new].view(np.uint64), k1[new], k2[new], s[new])])
            yield _runs(k1[hit], k2[hit], s[hit])

    dealt = pieces.mapInArrow(lean(deal), "g bigint, known boolean, h array<bigint>, k1 array<bigint>, k2 array<bigint>, s array<bigint>")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), _RUNS)


def repeated(keyed: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """k1, k2, found: for each text with repeated windows, structs (s, len) of runs of their starts."""
    counts = _occurrences(keyed, length, trigger).groupBy("ah").agg(F.count("*").alias("c"), F.min("sh").alias("s0"), F.max("sh").alias("s1"))
    twice = stash(counts.filter("c > 1").select("ah", (F.col("s0") != F.col("s1")).alias("mixed")), "triggers")
    some = stash(_occurrences(keyed, length, trigger, twice.select("ah")).join(twice, "ah"), "occurrences")
    dictionary = stash(some.filter("mixed").groupBy("ah", "sh").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "s", "len")).alias("one")), "dictionary")
    whole = some.filter("not mixed").unionByName(some.filter("mixed").join(dictionary.filter("c > 1").select("ah", "sh"), ["ah", "sh"]).select(*some.columns))
    sizes = stash(dictionary.groupBy("ah").agg(F.count("*").alias("m")), "sizes")  # a table, so that a hot trigger's side of the join can be split
    need = stash(dictionary.join(sizes, "ah").select("ah", "m", "one.*"), "need")
    pieces = stash(_dictionary_bytes(keyed, need, length), "phrases")
    few, many = _few(pieces.filter(F.col("m") <= FEW), length), _many(pieces.filter(F.col("m") > FEW), length)
    whole = whole.select("k1", "k2", "s", "len").distinct().select("k1", "k2", F.array(F.struct("s", "len")).alias("found"))
    return whole.unionByName(few).unionByName(many).groupBy("k1", "k2").agg(F.flatten(F.collect_list("found")).alias("found"))


def _merge(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Spans [start, end) of the bytes that the windows at these starts cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["s"] + x["len"] - 1 + length) for x in found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _marked(documents: DataFrame, kept_as: str, spans_as: str, length: int, trigger: int) -> DataFrame:
    """All columns, the bytes that stay, and the structs start, end of those removed."""
    own = documents.columns
    names = [free_name(documents, c) for c in ("__k1", "__k2", "__found")]
    keys = _keys()
    found = repeated(documents.select("text", keys[0].alias("k1"), keys[1].alias("k2")), length, trigger).toDF(*names)
    pair = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType([*documents.schema.fields, T.StructField(kept_as, T.BinaryType()), T.StructField(spans_as, pair)])
    arrow_pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cut = [], []
            for found, text in zip(batch.column(names[2]).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text, at, rest = text or b"", 0, []
                cut.append([{"start": a, "end": b} for a, b in _merge(found, length)] if found else [])
                for x in cut[-1]:
                    rest.append(text[at : x["start"]])
                    at = x["end"]
                kept.append(b"".join([*rest, text[at:]]) if rest else text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(kept, pa.binary()), pa.array(cut, arrow_pair)], [*own, kept_as, spans_as])

    keyed = documents.withColumns(dict(zip(names, keys, strict=False)))
    return map_all(keyed.join(found, names[:2], "left").select(*named(own), names[2]), run, schema)


def spans(documents: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """All columns of ``documents`` plus kept (binary: the bytes that stay) and spans (structs start, end of those removed)."""
    return _marked(documents.drop("kept", "spans"), "kept", "spans", length, trigger)


def clean(documents: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """The documents with repeated bytes cut out of their texts (a character that is cut in half goes whole;
    null text stays null), n_chars brought up to date, other columns and all rows kept."""
    own, kept_as, spans_as = documents.columns, free_name(documents, "__kept"), free_name(documents, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column(kept_as).to_pylist(), batch.column(spans_as).to_pylist(), strict=True)
            text = pa.array([kept.decode("utf-8", "ignore") if cut else old for old, kept, cut in rows], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in own], own)

    out = map_all(_marked(documents, kept_as, spans_as, length, trigger), run, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in own else out


def removed(spans: str | Column = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
