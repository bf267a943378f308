"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens once, partitioned by document: one row for
a block of about a megabyte of text, holding for each term its sorted word positions.  A test
phrase is looked up from its rarest term in the block: the postings of the term, shifted by its
offset in the phrase, are intersected with the shifted postings of the next rarest term and so on,
until no start is left or all terms agree.  Proximity matches allow each term a few words of slop.  No posting is
shuffled, so a term or document that holds a third of all rows costs no more than its own size in the tasks that
read it.  Test phrases come in blocks of bounded size, one after the other; the matches of each are written before
the next is read.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is 13 consecutive
words of an item; an item of fewer words, but not none, is one window.  Matches never span two
documents.  Null or empty texts have no words: n_words 0, no hit, not contaminated; items without
words have no windows.  Repeated document rows each get their own (equal) row; equal items each
count.  Items with a null id count as hits but have no id to list.  Extra columns are ignored by
the index and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, free_name, lean, named, new_path, read, stash, text_chunks, words

WINDOW = 13
#: Test items go to the executors in blocks of about so many words (8 MB); each block is matched against the whole index.
BLOCK_WORDS = 1_000_000
#: Free places between the documents of an index row; the slop of a proximity match is less.
GAP = 8
#: Words that a term may be off its place in the proximity matches of the query.
SLOP = 1

INDEX = pa.schema([("row", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("term", pa.list_(pa.int64())), ("df", pa.list_(pa.int32())), ("gap", pa.list_(pa.int32()))])
INDEX_DDL = "row bigint, doc_id array<bigint>, n_words array<int>, term array<bigint>, df array<int>, gap array<int>"
MATCH_DDL = "row bigint, doc_id bigint, n_words bigint, hits array<struct<start:int,length:int,item:bigint,phrase:int,exact:boolean>>"


@dataclass
class Phrases:
    """Test phrases: the word hashes of items one after the other, and start, length and item of each window."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: pa.Array


def item_phrases(items: DataFrame, window: int = WINDOW) -> Iterator[Phrases]:
    """Blocks of test phrases, streamed; a very long item goes on in the next block."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        for _, data, offs in text_chunks(pa.array([row.text], pa.string())):
            h = words(data, offs, ALNUM_WORDS)[2]
            n, at = max(len(h) - window + 1, min(len(h), 1)), 0
            while at < n:
                take = max(min(n - at, BLOCK_WORDS - size), 1)
                own = h[at : at + take + window - 1]
                parts.append((own, size + np.arange(take), np.full(take, min(window, len(h))), [row.item_id] * take))
                at, size = at + take, size + len(own)
                if size >= BLOCK_WORDS:
                    yield _block_of(parts)
                    parts, size = [], 0
    if parts:
        yield _block_of(parts)


def _block_of(parts: list) -> Phrases:
    h, start, length, item = zip(*parts, strict=True) if parts else ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [[]])
    return Phrases(np.concatenate(h), np.concatenate(start), np.concatenate(length), pa.array([i for x in item for i in x], pa.int64()))


def build_index(documents: DataFrame) -> DataFrame:
    """Index rows of INDEX_DDL, with the postings of all words.

    The positions of a block count on through its documents with GAP free places after each of
    them, and are stored as gaps between the postings of a term: small integers, which Parquet
    packs into few bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36  # of the block's first document; the same each time the input is read
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for row, data, offs in text_chunks(batch.column("text")):
                _, _, h, by = words(data, offs, ALNUM_WORDS)
                n = np.diff(by)
                order = np.argsort(h, kind="stable")
                h, at = h[order], (np.arange(len(h)) + np.repeat(GAP * np.arange(len(n)), n))[order].astype(np.int32)
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                gap = np.diff(at, prepend=np.int32(0))
                gap[first] = at[first]
                lists = [ids.slice(row, len(n)), pa.array(n.astype(np.int32)), pa.array(h[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(h))).astype(np.int32)), pa.array(gap)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], schema=INDEX)
                number += len(n)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), INDEX_DDL)


class Block:
    """One index row, ready for look-ups."""

    def __init__(self, term: np.ndarray, df: np.ndarray, gap: np.ndarray, n_words: np.ndarray):
        self.terms, self.df = term.astype(np.uint64), df
        self.offsets = np.concatenate(([0], np.cumsum(df))).astype(np.int64)
        run = np.cumsum(gap, dtype=np.int64)
        before = np.repeat(np.append(0, run)[self.offsets[:-1]], df)
        self.positions = run - before
        self.starts = np.concatenate(([0], np.cumsum(n_words.astype(np.int64) + GAP)))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in this block's dictionary, -1 if absent."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def postings(self, rank: int) -> np.ndarray:
        return self.positions[self.offsets[rank] : self.offsets[rank + 1]]

    def phrase(self, ranks: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase: shifted postings, intersected from the rarest term on."""
        found = None
        for j in np.argsort(self.df[ranks], kind="stable"):
            own = self.postings(ranks[j]) - j
            if found is None:
                found = own
            else:
                at = np.searchsorted(own, found)
                found = found[own[np.minimum(at, len(own) - 1)] == found]
            if not len(found):
                break
        return found[found >= 0]

    def near(self, ranks: np.ndarray, slop: int) -> tuple[np.ndarray, int]:
        """Starts for which the rarest term stands at its place in the phrase, and every other one within ``slop``
        words of its own; and the place of the rarest term."""
        order = np.argsort(self.df[ranks], kind="stable")
        found = self.postings(ranks[order[0]]) - order[0]
        for j in order[1:]:
            own = self.postings(ranks[j]) - j
            at = np.searchsorted(own, found - slop)
            found = found[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= found + slop)]
            if not len(found):
                break
        return found, int(order[0])


def _lists(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """Rows of MATCH_DDL for every document of the index: each place where a phrase occurs exactly,
    and, with ``slop`` (less than GAP), those where each of its words lies within so many words of its place."""
    if slop is not None and not 0 <= slop < GAP:
        raise ValueError(f"slop must be less than {GAP}")
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n = batch.column("doc_id")[i].values, _lists(batch, "n_words", i)
                block = Block(_lists(batch, "term", i), _lists(batch, "df", i), _lists(batch, "gap", i), n)
                ranks = block.ranks(p.words)
                absent = np.append(0, np.cumsum(ranks < 0))
                doc, start, phrase, exact = [], [], [], []
                for k in np.flatnonzero(absent[p.start + p.length] == absent[p.start]).tolist():
                    r = ranks[p.start[k] : p.start[k] + p.length[k]]
                    if slop is None:
                        found, rarest, same = block.phrase(r), 0, None
                    else:
                        found, rarest = block.near(r, slop)
                        same = np.isin(found, block.phrase(r)) if len(found) else None
                    if len(found):
                        d = np.searchsorted(block.starts, found + rarest, "right") - 1
                        doc.append(d)
                        start.append(np.maximum(found - block.starts[d], 0))
                        phrase.append(np.full(len(found), k))
                        exact.append(np.ones(len(found), bool) if same is None else same)
                doc, start, phrase = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, start, phrase))
                exact = np.concatenate(exact) if exact else np.zeros(0, bool)
                order = np.lexsort((phrase, start, doc))
                doc, start, phrase, exact = doc[order], start[order], phrase[order], exact[order]
                hits = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(p.length[phrase].astype(np.int32)), p.item.take(pa.array(phrase)), pa.array(phrase.astype(np.int32)), pa.array(exact)], ["start", "length", "item", "phrase", "exact"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)), hits)
                row = batch.column("row")[i].as_py() + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(row), ids, pa.array(n.astype(np.int64)), lists], ["row", "doc_id", "n_words", "hits"])

    return index.mapInArrow(lean(run), MATCH_DDL)


def matches(documents: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, key: str = "doc_id") -> DataFrame:
    """A row of MATCH_DDL for every document.  The index is written to the shared folder once; where the test items
    are more than one block, so are the matches of each, and meet by the number of the document row."""
    spark = documents.sparkSession
    index = stash(build_index(documents.select(F.col(key).alias("doc_id"), "text")), "index")
    blocks = item_phrases(items, window)
    first, second = next(blocks, _block_of([])), next(blocks, None)
    if second is None:
        return search(index, first, slop)
    path = new_path(spark, "matches")
    for block in chain((first, second), blocks):
        search(index, block, slop).filter(F.size("hits") > 0).write.mode("append").parquet(path)
    rows = search(index, _block_of([])).unionByName(spark.read.schema(MATCH_DDL).parquet(path))
    return rows.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _report(n_words: int, hits: list) -> tuple[int, list[str], int]:
    exact = [x for x in hits if x["exact"]]
    near = len({(x["start"], x["length"]) for x in hits if not x["exact"]})
    if not exact:
        return 0, [], near
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, [x["start"] for x in exact], 1)
    np.add.at(edge, [x["start"] + x["length"] for x in exact], -1)
    return int((np.cumsum(edge) > 0).sum()), sorted({str(x["item"]) for x in exact if x["item"] is not None}), near


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, of the exact matches, and n_near, the places of
    other proximity matches: one row per document row."""
    ddl = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = batch.column("n_words").to_pylist(), []
            for k, hits in zip(n, batch.column("hits").to_pylist(), strict=True):
                hit, items, near = _report(k, hits or [])
                out.append((hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= k, near))
            rest = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(x, k) for x, k in zip(rest, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()), strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])

    return found.mapInArrow(lean(run), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact matches, which SQL can check; ``matches`` with a slop gives the proximity matches."""
    return report(matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))).drop("n_near")


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept.

    Rows are told apart by a hash of their text, as equal texts have equal verdicts."""
    key = free_name(documents, "__key")
    bad = report(matches(documents.select(F.xxhash64("text").alias("doc_id"), "text"), items)).filter("contaminated")
    return documents.withColumn(key, F.xxhash64("text")).join(bad.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*named(documents.columns))


_CHARS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce({_CHARS}, ''), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select row_number() over () as r, item_id, {_WORDS} as w from benchmark),
p as (select distinct item_id, w[i:i + {WINDOW - 1}] as p from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, least(len(w), 1)) + 1)) as i from b)),
n as (select distinct len(p) as n from p),
s as (select r, i, n, w[i:i + n - 1] as p from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, n)),
m as (select r, i, n, item_id from s join p using (p)),
h as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from m) group by r),
t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, cast(item_id as varchar) as item_id from m) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join t using (r)
"""
