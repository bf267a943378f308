"""Token ids of whole texts, and a token table on disk.

``Encoder`` gives exactly the ids of the ``tokenizers`` library for a byte-level BPE file, faster: the
library encodes each piece of text between its split points by itself, so texts are split here with
NumPy and the library is asked once for every distinct piece.  Texts with characters outside ASCII and
Latin letters, or with the string of a special token, go to the library whole, which gives such a string the id of
that token.

The token table is Parquet: doc_id, n_tokens, shard, shard_start (ids before the document in its file)
and ids, a list column with dictionary encoding (or delta encoding on request), with row groups and
pages of a given size and page indexes, so that metadata can be read without ids, and few documents
without whole files.  Files and their rows are in ascending doc_id order; null doc_ids come first and
repeated doc_ids are ordered by text.  Null text is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_path, read, string_hash, text_chunks

END_ID = 0
#: Distinct pieces that an encoder remembers before it starts anew.
REMEMBER = 3_000_000

_L, _N, _S, _O = 0, 1, 2, 3
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _L
_CLASS[0x30:0x3A] = _N
_CLASS[[*range(0x09, 0x0E), 0x20]] = _S
#: Lead bytes of U+00C0 to U+027F, all letters but the signs times and divided-by.
_PLAIN = np.zeros(256, bool)
_PLAIN[:0xC0] = True
_PLAIN[0xC3:0xCA] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pieces of plain texts, as the GPT-2 pattern splits them; each text starts a piece."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = edge[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(first)
    start = first
    spaces = runs[kind[runs] == _S]
    if len(spaces):
        end = np.append(runs, n)[np.searchsorted(runs, spaces) + 1]  # of the white-space runs
        last = end - 1
        more = ~edge[end]  # text follows
        # the last white-space character before text stands alone, or, if it is a space, with what follows
        start[last[more]] = True
        start[end[more & (data[last] == 0x20)]] = False
    quote = np.flatnonzero((data[:-1] == 0x27) & (kind[1:] == _L) & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
    quote = quote[start[quote]]
    for i in quote.tolist():
        a = data[i + 1]
        b = data[i + 2] if i + 2 < n and not edge[i + 2] else 0
        size = 1 if a in b"stmd" else 2 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] |= kind[i + 1 + size] == _L
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.added = [t["content"].encode() for t in file.get("added_tokens") or []]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        spaced = np.array([len(p) > 1 and p[0] == 0x20 and _CLASS[p[1]] == _L for p in pieces], bool)
        ids, size = [], np.zeros(len(pieces), np.int64)
        joined = b"".join(p for p, s in zip(pieces, spaced, strict=True) if s).decode()
        if joined:  # each piece begins with its only space, so the library splits them again
            one = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int32)
            size[spaced] = np.diff(np.append(np.flatnonzero(self.opens[one]), len(one)))
            ids.append(one)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p, s in zip(pieces, spaced, strict=True) if not s], add_special_tokens=False)]
        size[~spaced] = [len(x) for x in rest]
        ids.append(np.array([i for x in rest for i in x], np.int32))
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        at = np.empty(len(pieces), np.int64)
        at[order] = len(self.flat) + np.concatenate(([0], np.cumsum(size[order])[:-1]))
        place = np.searchsorted(self.known, h)
        self.known, self.at, self.size = np.insert(self.known, place, h), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.flat = np.concatenate([self.flat, *ids])

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = split(data, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        end = np.append(start[1:], len(data))
        h, first, which = np.unique(string_hash(data, start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[place] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            if len(self.known) + new.sum() > REMEMBER and len(self.known):
                self._forget()
                new[:] = True
            raw = data.tobytes()
            self._learn(h[new], [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.known, h)
        size, at = self.size[place][which].astype(np.int64), self.at[place][which]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(at - ends + size, size) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(start, offs)]

    def _specials(self, data: np.ndarray) -> np.ndarray:
        """Where the strings of added tokens begin."""
        raw, found = data.tobytes(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.array(found, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text) of UTF-8 texts that follow each other."""
        odd = np.flatnonzero(~_PLAIN[data])
        signs = np.flatnonzero(data[:-1] == 0xC3)
        odd = np.concatenate([odd, signs[(data[signs + 1] == 0x97) | (data[signs + 1] == 0xB7)], self._specials(data)])
        hard = np.unique(np.searchsorted(offs, odd, "right") - 1).astype(np.int64)
        if not len(hard):
            return self._plain(data, offs)
        easy = np.ones(len(offs) - 1, bool)
        easy[hard] = False
        n = np.diff(offs)
        ids, by = self._plain(data[np.repeat(easy, n)], np.append(0, np.cumsum(n[easy])))
        parts = iter(np.split(ids, by[1:-1]) if easy.any() else [])
        out = [next(parts) if e else np.array(self.tokenizer.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int32) for e, a, b in zip(easy, offs[:-1], offs[1:], strict=True)]
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))


@cache
def encoder(path: str) -> Encoder:
    """One encoder in a worker process, for all its tasks."""
    return Encoder(path)


def with_end(ids: np.ndarray, by: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after every text."""
    return np.insert(ids, by[1:], end_id), by + np.arange(len(by))


_ROWS = "doc_id bigint, n_tokens bigint, shard int, shard_start bigint, ids array<int>"


def encode(documents: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of the token table in input order; ``path``: a byte-level BPE file that all executors have."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, data, offs in text_chunks(batch.column("text")):
                ids, by = with_end(*own.encode(data, offs), end_id)
                n = len(by) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(np.diff(by)), pa.array(np.full(n, shard, np.int32)), pa.array(by[:-1] + before), pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "n_tokens", "shard", "shard_start", "ids"])
                before += int(by[-1])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _ROWS)


def write(documents: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = 32 << 20, page: int = 256 << 10) -> None:
    """Write the token table of ``documents`` to a shared folder.  ``encoding``: dictionary or delta."""
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"compression": "zstd", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    encode(ordered, path, end_id).write.options(**options).parquet(out)


def token_table(spark: SparkSession, out: str) -> DataFrame:
    """The table with start, the number of ids before each document in the whole corpus."""
    table = spark.read.parquet(out)
    sizes = sorted((r.shard, r.n) for r in table.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    begins = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    base = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, begins, strict=False)], "shard int, begins bigint")
    return table.join(F.broadcast(base), "shard").select("doc_id", (F.col("begins") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def crc32s(ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Unsigned CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    at = (4 * offs).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def with_crc32(table: DataFrame) -> DataFrame:
    """Replace column ids by ids_crc32."""
    keep = [c for c in table.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offs = lists.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), crc32s(lists.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0])], [*keep, "ids_crc32"])

    return table.mapInArrow(lean(run), table.select(*keep, F.lit(0).cast("long").alias("ids_crc32")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    write(read(spark, sf_dir, "documents"), out)
    return with_crc32(token_table(spark, out))
