"""Document fingerprints: SimHash in DataFrame functions only.

Terms are pairs of consecutive words (split at spaces and line feeds) and the last word alone.  Each
occurrence votes with the 64 bits of its term's hash, so a term weighs as often as it occurs; a bit of
the fingerprint is set where more than half of the votes are.  The votes of two bits are counted in one
long, so a document needs 32 sums and no row for each bit.

``search`` finds all fingerprints within a Hamming radius: the 64 bits are cut into ``radius + 2``
blocks, of which any two stay whole under so many flips, so a table keyed by each pair of blocks (one
permutation of the blocks a table) misses nothing.  Equal fingerprints are one row of the tables.

Null or empty text has one empty term.  Documents are ordered by doc_id, equal doc_ids by a hash of the text and
null doc_ids first; rows equal in both are told apart by their place in the input, and the next of one may
be its copy.  After the last document comes the first; a single document is next to itself.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stash

RADIUS = 3
#: Documents in a range of doc_ids, about: a range with its texts is ordered by one task.
RANGE_ROWS = 1000
#: Ranges are of so many documents up to FINE_RANGES of them, and hold about RANGE_BYTES of text beyond that.
FINE_RANGES = 4096
RANGE_BYTES = 1 << 30
#: Keys sampled for each boundary.
SAMPLE = 40


def terms(text: Column) -> Column:
    """Hashes of the terms of a text: word pairs, then the last word with nothing after it."""
    w = F.split(F.regexp_replace(text, "\n", " "), " ")
    return F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))


def _votes() -> list[Column]:
    """Of each bit and the bit 32 above it, how many terms have it set."""
    return [F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"v{k}") for k in range(32)]


def _majority() -> Column:
    """The fingerprint as a long, from the votes and the number of terms n."""
    low = [F.when((F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("n"), F.lit(1 << k)).otherwise(0) for k in range(32)]
    high = [F.when((F.shiftrightunsigned(f"v{k}", 32) * 2) > F.col("n"), F.lit((1 << (k + 32)) - ((1 << 64) if k == 31 else 0))).otherwise(0) for k in range(32)]
    return reduce(Column.bitwiseOR, [*low, *high]).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and their fingerprint (long) for rows that the keys tell apart."""
    exploded = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    summed = exploded.groupBy(*keys).agg(F.count("*").alias("n"), *_votes())
    return summed.select(*keys, _majority().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 2 blocks of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of distinct fingerprints (query, fingerprint, distance) within the radius; both inputs have
    a column ``fingerprint``.  Each pair comes once: from the first table in which its key agrees."""
    keys = [F.struct(F.lit(t).alias("t"), *(F.shiftrightunsigned("fingerprint", s).bitwiseAND(F.lit(m)).alias(f"k{i}") for i, (s, m) in enumerate(pair))).alias("key") for t, pair in enumerate(combinations(blocks(radius), 2))]
    tables = [x.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*keys)).alias("key")) for x in (queries, prints)]
    q, p = tables[0].withColumnRenamed("fingerprint", "query"), tables[1]
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    found = q.join(p, "key").filter(distance <= radius)
    return found.select("query", "fingerprint", distance.alias("distance")).distinct()


_KEY = ("o", "h", "row")


def _boundaries(docs: DataFrame, parts: int, rows: int) -> list[tuple[int, int, int]]:
    """Up to parts - 1 keys that cut the documents into ranges of about equal size, from a sample of the keys."""
    if parts < 2:
        return []
    dice = F.shiftrightunsigned(F.xxhash64(F.lit(7), *_KEY), 11) / F.lit(float(1 << 53))
    keys = sorted(tuple(r) for r in docs.select(*_KEY).filter(dice < F.lit(SAMPLE * parts / rows)).collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _range_of(cuts: list[tuple[int, int, int]]) -> Column:
    """Number of the cuts not above a row's key.  The cuts are one literal, in rows of about the square root of their
    number: first the row is found, then the place in it."""
    if not cuts:
        return F.lit(0)
    wide = int(len(cuts) ** 0.5) + 1
    grid = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    kind = "struct<o:bigint,h:bigint,row:bigint>"
    literal = lambda rows, of: F.from_json(F.lit(json.dumps(rows)), of)  # noqa: E731  folded into a constant
    named = lambda keys: [dict(zip(_KEY, k, strict=True)) for k in keys]
    heads, rows = literal(named([g[0] for g in grid]), f"array<{kind}>"), literal([named(g) for g in grid], f"array<array<{kind}>>")
    key = F.struct(*_KEY)
    row = F.size(F.filter(heads, lambda c: c <= key))
    inside = F.transform(F.array(row), lambda k: F.when(k == 0, 0).otherwise((k - 1) * wide + F.size(F.filter(F.get(rows, k - 1), lambda c: c <= key))))
    return inside[0]


def with_next(documents: DataFrame) -> DataFrame:
    """row (its place), doc_id, text and next_row, next_text of each document; after the last comes the first.

    Texts are shuffled once, by ranges of their keys; the first document of each range is copied to the end
    of the range before it, so every next document is found in its own range."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    docs = docs.withColumns({"o": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    docs = docs.withColumn("r", _range_of(_boundaries(docs, max(1, min(FINE_RANGES, rows // RANGE_ROWS), size // RANGE_BYTES), rows)))
    least = {r.r: tuple(r.m) for r in docs.groupBy("r").agg(F.min(F.struct(*_KEY)).alias("m")).collect()}  # a row a range
    ranges = sorted(least)
    before = [(r, *least[r], b) for r, b in zip(ranges, [*ranges[-1:], *ranges[:-1]], strict=True)]
    begins = F.broadcast(docs.sparkSession.createDataFrame(before, "r int, o bigint, h bigint, row bigint, b int"))
    copies = docs.join(begins, ["r", *_KEY]).select(F.lit(None).cast("long").alias("doc_id"), "text", "row", "o", "h", F.col("b").alias("r"), F.lit(True).alias("copy"))
    along = Window.partitionBy("r").orderBy("copy", *_KEY)
    both = docs.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.select("*", F.lead("text").over(along).alias("next_text"), F.lead("row").over(along).alias("next_row")).filter("not copy").select("row", "doc_id", "text", "next_row", "next_text")


def compare(documents: DataFrame) -> DataFrame:
    """For each document: fingerprint (long), that of its edited text, and that of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    texts = with_next(documents).select("row", "doc_id", "next_row", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["row", "doc_id", "next_row", "n_chars", "edited_sha256"]
    each = texts.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.posexplode(F.array("text", "edited")).alias("kind", "t"))
    prints = stash(fingerprints(each, [*keys, "kind"], "t"), "fingerprints")
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    rows = prints.groupBy(*keys).agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"))
    after = prints.filter("kind = 0").select(F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    return rows.join(after, "next_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_near, for documents whose id is divisible by 100: others within the radius, of all documents."""
    rows = stash(compare(read(spark, sf_dir, "documents")), "compared")
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("c"))
    near = search(rows.filter("doc_id % 100 = 0"), rows).join(copies, "fingerprint").groupBy("query").agg((F.sum("c") - 1).alias("n_near"))
    out = rows.join(near.withColumnRenamed("query", "fingerprint"), "fingerprint", "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint").alias("fingerprint"), text("edited_fingerprint").alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
    )
