"""N-gram Jaccard join: exact similarity join of word-shingle sets, and its connected components.

Two documents link when |A & B| / |A | B| is at least a threshold given in percent.

1. Each text becomes a set of 64-bit shingle hashes; equal sets are one node from here on, known by a
   128-bit digest, so copies never meet each other.
2. All shingles of the corpus are counted in a sketch of bounded size, on a scale that reaches 16 thousand million,
   and a set is ordered rarest first by these counts.  Any common order gives right results; a good one makes short
   posting lists.  In a corpus much larger than the sketch, shingles below the mean count of a cell look alike.
3. The first n - ceil(t n) + 1 shingles of a set are its prefix; two sets that link share one of these.
4. Round one compares the sets that share a prefix shingle with two pivots of the shingle and length
   class only: a number of pairs in proportion to the postings, also inside huge groups of near copies.
   One pivot is the set that has the fewest rarer shingles, so of near copies the least edited one; what links with
   another copy links with this one too, as a rule, and a group is one component before round two.
   Each pair is verified once on its whole sets, and linked sets are joined to components.
5. Round two compares every pair that shares a prefix shingle and is not yet in one component, if it
   passes the length filter, the positional filter (places left behind the shared shingle) and a
   suffix filter with fixed splits: sets are cut into hash classes, first few and then many, and no more classes may
   have sizes of different parity than shingles may differ.  So no link between components is lost, and pairs inside them are never listed.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  A document of fewer words than a shingle has its whole
sequence as one; null, empty or blank text has the empty set, links with nothing and is its own
component.  Rows of one doc_id with different texts are different nodes; component_id is the least
non-null doc_id of the component, null if there is none.  Repeated rows each get a row.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, bitmap, components, free_name, gather, in_bitmap, lean, named, new_path, read, sequence_hash, shingle_hashes, stash, text_chunks, words

#: The sketch has a count for every COUNT_BYTES of text, between two powers of two: at most 16 MB as bytes.
COUNT_BYTES, LEAST_BITS, MOST_BITS = 64, 18, 24
#: It goes from the tasks to the sums in so many compressed pieces.
PIECES = 64
#: Longs with the parities of 64 hash classes each, for the suffix filter: those told apart in the join, and in its pairs.
COARSE, FINE = 6, 20
#: Distinct keys that a task remembers, to pass over copies that it meets again.
REMEMBER = 1 << 18
#: Pivots that the shingles of a group choose between.
PIVOTS = 4


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offs in text_chunks(column):
        _, _, h, by = words(data, offs, SPACE_WORDS)
        s = shingle_hashes(h, k)
        for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
            if b - a >= k:
                v = np.sort(s[a : b - k + 1])
                yield v[np.append(True, v[1:] != v[:-1])]
            else:
                yield sequence_hash(h[a:b]) if b > a else s[:0]


def _parities(s: np.ndarray, longs: int) -> np.ndarray:
    """Whether an odd number of shingles falls in each of 64 * longs hash classes."""
    n = np.bincount((s % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(n.astype(np.uint8)).view(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _to_byte(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 16, then their exponent and three bits after the leading one, rounded down."""
    more = np.maximum(np.frexp(n.astype(np.float64))[1] - 4, 0).astype(np.uint64)
    return np.minimum(8 * more + (n.astype(np.uint64) >> more), 255).astype(np.uint8)


def _from_byte(code: np.ndarray) -> np.ndarray:
    more = np.maximum(code.astype(np.int64) // 8 - 1, 0)
    return ((code - 8 * more) << more).astype(np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(_to_byte(counts).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def summaries(documents: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: the table (doc_id, key, n, node), key a hash of the text, and the summed sketch."""
    spark, path = documents.sparkSession, new_path(documents.sparkSession, "summaries")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // COUNT_BYTES).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "node", "piece", "task", "counts"]
        sketch, last = np.zeros(1 << bits, np.uint16), []

        def put() -> None:
            """Add the gathered shingles; a count of one task stays at 65,535."""
            if last:
                at, more = np.unique(np.concatenate(last), return_counts=True)
                sketch[at] = np.minimum(sketch[at] + more, 65535)
                last.clear()

        for batch in batches:
            n, node = [], []
            for s in _sets(batch.column("text"), k):
                n.append(len(s))
                node.append(_digest(s) if len(s) else None)
                last.append((s >> np.uint64(64 - bits)).astype(np.int32))
                if len(last) >= 2000:
                    put()
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names)
        put()
        parts = [_packed(p) for p in np.split(sketch, PIECES)]
        none = [None] * PIECES
        yield pa.RecordBatch.from_arrays([*[pa.array(none, pa.int64())] * 3, pa.array(none, pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array([TaskContext.get().partitionId()] * PIECES, pa.int64()), pa.array(parts, pa.binary())], names)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    docs.mapInArrow(lean(run), "doc_id bigint, key bigint, n bigint, node binary, piece int, task bigint, counts binary").write.parquet(path)
    both = spark.read.parquet(path)

    pieces = both.filter("piece is not null").select("piece", "task", "counts")
    tasks = 1 + (pieces.agg(F.max("task")).first()[0] or 0)
    counts = gather(pieces, tasks, np.add, _packed, lambda data: _from_byte(_unpacked(data)), _unpacked)
    return both.filter("n is not null").select("doc_id", "key", "n", "node"), counts


def _prefixes(documents: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """node, n, sig and fine (parities of hash classes), prefix and key (of one text) of the distinct sets of each task."""
    # inside a count the hash decides, so the order is the same everywhere
    shared = documents.sparkSession.sparkContext.broadcast(counts)
    bits = len(counts).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in batches:
            rows = []
            for i, s in enumerate(_sets(batch.column("text"), k)):
                n = len(s)
                if not n or (node := _digest(s)) in seen:
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(node)
                order = np.argsort(rank[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                rows.append((i, node, n, _parities(s, COARSE), _parities(s, FINE), s[order[: n - -(-n * percent // 100) + 1]].view(np.int64)))
            if rows:
                at, node, n, sig, fine, prefix = zip(*rows, strict=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (sig, fine, prefix)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(n, pa.int64()), *lists, batch.column("key").take(pa.array(at))], ["node", "n", "sig", "fine", "prefix", "key"])

    return documents.select("text", F.xxhash64("text").alias("key")).mapInArrow(lean(run), "node binary, n bigint, sig array<bigint>, fine array<bigint>, prefix array<bigint>, key bigint")


def _whole_sets(documents: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node and set of the texts that have a wanted key (node, key), one row a key, however many copies there are.

    The texts are read again, as their sets take more space than they do.  A bitmap of the keys passes over
    most other texts before they are shuffled, and the join is exact."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(wanted.select("key")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if len(seen) >= REMEMBER:
                seen.clear()
            keys = batch.column("key").to_numpy()
            use = [i for i in np.flatnonzero(in_bitmap(shared.value, keys)).tolist() if keys[i] not in seen and not seen.add(keys[i])]
            yield batch.take(pa.array(use, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in _sets(batch.column("text"), k) if len(s)]
            if sets:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), lists], ["node", "set"])

    texts = documents.select("text", F.xxhash64("text").alias("key"))
    texts = texts.mapInArrow(lean(likely), texts.schema).join(wanted.select("key"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))  # else a pair would come for every two tasks that hold copies
    return texts.select("text").mapInArrow(lean(run), "node binary, set array<bigint>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _odd_classes(a: str, b: str, longs: int) -> Column:
    """Hash classes in which two sets have sizes of different parity: no more than their symmetric difference."""
    return reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)])


def _postings(prefixes: DataFrame, grams: DataFrame) -> DataFrame:
    """node, n, pos, gram of every prefix shingle that may be among ``grams``."""
    shared = prefixes.sparkSession.sparkContext.broadcast(bitmap(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            offs, gram = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            at = offs[0] + np.flatnonzero(in_bitmap(shared.value, gram[offs[0] : offs[-1]]))
            row = np.searchsorted(offs, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array((at - offs[row]).astype(np.int32)), pa.array(gram[at])], ["node", "n", "pos", "gram"])

    return prefixes.select("node", "n", "prefix").mapInArrow(lean(run), "node binary, n bigint, pos int, gram bigint")


def _need(n: Column, percent: int) -> Column:
    """The least intersection of two linked sets whose sizes add up to n."""
    return F.ceil(n * percent / F.lit(100.0 + percent) - F.lit(1e-6))


def _may_link(percent: int) -> Column:
    """Length and positional filter of postings (n1, pos1) and (n2, pos2) of one shingle."""
    long_enough = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    return long_enough & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= _need(F.col("n1") + F.col("n2"), percent))


def _checked(documents: DataFrame, marks: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs that link, written.  Pairs that pass the finer suffix filter are verified on the whole sets,
    which are made for this."""
    one, two = (marks.select(F.col("node").alias(x), F.col("n").alias(f"n{i}"), F.col("fine").alias(f"fine{i}")) for i, x in ((1, "a"), (2, "b")))
    n = F.col("n1") + F.col("n2")
    left = stash(pairs.join(one, "a").join(two, "b").filter(_odd_classes("fine1", "fine2", FINE) <= n - 2 * _need(n, percent)).select("a", "b"), "pairs")
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stash(marks.join(ends, "node", "left_semi").select("node", "key"), "wanted")
    return stash(_verify(left, stash(_whole_sets(documents, k, wanted), "sets"), percent), name)


def _pivot_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each posting with the pivots of its shingle and length class, if they may link.  One is the set
    with the fewest rarer shingles, the other the first in one of PIVOTS random orders of the nodes, so the shingles of
    a group choose few pivots."""
    rank = F.xxhash64("node", F.pmod("gram", F.lit(PIVOTS))).alias("rank")
    heads = shared.groupBy("gram", "class").agg(F.min(F.struct("pos", rank, "n", "node")).alias("least"), F.min(F.struct(rank, "n", "node", "pos")).alias("any"))
    each = F.array_distinct(F.array(*(F.struct(*(F.col(f"{h}.{c}").alias(c) for c in ("node", "n", "pos"))) for h in ("least", "any"))))
    heads = heads.select("gram", "class", F.explode(each).alias("h"))
    # a set links within its length class or the next
    heads = heads.select("gram", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), *(F.col(f"h.{c}").alias(f"{c}1") for c in ("node", "n", "pos")))
    others = shared.select("gram", "class", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos")))
    near = others.join(heads, ["gram", "class"]).filter((F.col("node1") != F.col("node2")) & _may_link(percent))
    return near.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def links(documents: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, root) of all nodes that link with another; root is the component's least node."""
    each = _prefixes(documents, k, percent, counts)
    prefixes = stash(each.groupBy("node").agg(*(F.first(c).alias(c) for c in each.columns[1:])), "prefixes")
    grams = prefixes.select(F.explode("prefix").alias("gram"))
    many = stash(grams.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), "grams")
    postings = _postings(prefixes, many)
    # sizes of one class differ by less than the threshold allows, so a set links within its class or the next
    step = math.log(100 / percent) if percent < 100 else 1e-9
    shared = stash(postings.join(many, "gram").withColumn("class", F.floor(F.log("n") / F.lit(step)).cast("long")), "postings")

    marks = stash(shared.select("node").distinct().join(prefixes.select("node", "n", "key", "sig", "fine"), "node"), "marks")
    good = _checked(documents, marks, _pivot_pairs(shared, percent), k, percent, "links1")
    roots = stash(components(good, "a", "b"), "roots")
    placed = shared.select("gram", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node")))
    # grams all of whose sets are in one component by now have nothing to add
    placed = stash(placed, "placed")
    mixed = placed.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("gram")
    placed = placed.join(mixed, "gram", "left_semi").join(marks.select("node", "sig"), "node")
    x, y = (placed.select(*(F.col(c).alias(f"{c}{i}") for c in placed.columns)) for i in (1, 2))
    n = F.col("n1") + F.col("n2")
    condition = (
        (F.col("gram1") == F.col("gram2")) & (F.col("root1") != F.col("root2")) & ((F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
        & _may_link(percent) & (_odd_classes("sig1", "sig2", COARSE) <= n - 2 * _need(n, percent))
    )
    second = x.join(y, condition).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    more = _checked(documents, marks, second, k, percent, "links2")
    return components(good.unionByName(more), "a", "b")


def _labelled(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, key, n, node, root, component_id of every row; no node, root or component for the empty set."""
    rows, counts = summaries(documents, k)
    nodes = stash(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    named = nodes.join(links(documents, k, percent, counts), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.join(named, "node", "left")


def near_duplicates(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _labelled(documents, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row left of each component: that of the least doc_id (null ids last, then by
    text hash).  Documents without words all stay.  Columns are kept."""
    rows = stash(_labelled(documents, k, percent).select("doc_id", "key", "n", "root"), "labelled")
    who = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    least = rows.filter("n > 0").groupBy("root").agg(F.min(who).alias("m")).select("m.doc_id", "m.key")
    blank = rows.filter("n = 0").select("doc_id", "key").distinct()
    times = rows.groupBy("doc_id", "key").agg(F.count("*").alias("c"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    id_, key, again = (free_name(documents, c) for c in ("__id", "__key", "__again"))
    kept = least.join(times, same(least, times)).select(least["doc_id"].alias(id_), least["key"].alias(key), (F.col("c") > 1).alias(again))
    kept = stash(kept.unionByName(blank.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.lit(False).alias(again))), "kept")
    found = documents.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)))
    once = found.filter(~F.col(again)).select(*named(documents.columns))
    # rows that come again word for word under one id
    return once.unionByName(found.filter(F.col(again)).dropDuplicates([id_, key]).select(*named(documents.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 3, 90)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(n, 0) as n_shingles, min(r.b) as component_id from d left join n using (doc_id) join r on r.a = d.doc_id group by all
"""
