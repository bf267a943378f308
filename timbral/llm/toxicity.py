"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence gets p = sigmoid(bias + sum of the weights of its
distinct words and word beginnings), the document gets the noisy-or 1 - prod(1 - p), and the weights are trained from
document labels alone, so the model learns which sentences are to blame and can point at them.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; sentences end at `.`, `!`,
`?` or a line feed.  Scoring reads whole texts of all rows; only the fit uses a bounded sample of rows, and whole
texts of these.

Null or empty text is one sentence without words, so its score is the bias alone.  Repeated rows
get equal scores.  Rows of ``labels`` without a doc_id or a mark, or without a document, teach
nothing; with no usable mark of both kinds every score is the share of toxic marks (0 without any).
Extra columns are ignored by ``fit`` and kept by ``score``, whose own columns replace columns of
the same names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, ALNUM_WORDS, free_name, lean, map_all, named, prefix_hash, read, substring_hash, text_chunks, words

#: A sentence's features are its distinct words and their first bytes, for inflected and compound words.
STEM = 5
#: Words are hashed to this many weights: the model is one megabyte at any input size.
BITS = 18
#: The fit takes at most so many labelled documents of either label (least hash first), each with its whole text.
SAMPLE_PER_LABEL = 3000
#: A training step goes through so many features at a time, which bounds its temporary arrays.
PIECE = 1 << 21

_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None


def _bags(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence of each feature, sentence starts, sentence ends, sentence offsets by text)."""
    if not len(data):  # empty texts only
        n, none = len(offs) - 1, np.zeros(0, np.int64)
        return none, none, np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n + 1)
    starts, ends, h, _ = words(data, offs, ALNUM_WORDS)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = _STOP[data]
    cut[offs] = False
    at = np.union1d(np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64), offs[:-1])
    begin = np.sort(np.concatenate([at, offs[:-1][offs[:-1] == offs[1:]]])) if (offs[:-1] == offs[1:]).any() else at
    # an empty text shares its offset with the next one; each still gets a sentence of its own
    text_of = np.searchsorted(offs, np.unique(begin), "right") - 1
    first = np.unique(begin)
    counts = np.bincount(text_of, minlength=len(offs) - 1)
    empty = offs[:-1] == offs[1:]
    counts[empty] = 1
    by = np.concatenate(([0], np.cumsum(counts)))
    begin = np.empty(by[-1], np.int64)
    own = np.ones(by[-1], bool)
    own[by[:-1][empty]] = False
    begin[own] = first[first < len(data)] if len(data) else first[:0]
    begin[~own] = offs[:-1][empty]
    end = np.append(begin[1:], len(data))
    where = np.flatnonzero(own)
    s = where[np.searchsorted(begin[own], starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    stem = substring_hash(prefix_hash(_LOWER[data]), starts, np.minimum(starts + STEM, ends)) + np.uint64(1)
    key = np.unique(np.concatenate([s, s]).astype(np.uint64) << np.uint64(BITS) | (np.concatenate([h, stem]) >> np.uint64(64 - BITS)))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64), begin, end, by


def _sentence_p(model: Model, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    z = model.bias + np.bincount(sentence, model.weights[feature], n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray, by: np.ndarray) -> np.ndarray:
    return -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), by[:-1]))


def train(batches: Iterable[tuple[pa.Array, np.ndarray]], prior: float, steps: int = 250, rate: float = 0.1, ridge: float = 0.05) -> Model:
    """Maximise the noisy-or likelihood of document labels by Adam; ``batches``: texts and their labels, of which only
    the bags are kept; ``prior``: share of toxic documents."""
    features, sentences, counts, labels, before = [], [], [], [], 0
    for texts, own in batches:
        labels.append(own)
        for _, data, offs in text_chunks(texts):
            feature, sentence, _, _, by = _bags(data, offs)
            features.append(feature.astype(np.int32))
            sentences.append((sentence + before).astype(np.int32))
            counts.append(np.diff(by))
            before += int(by[-1])
    marks = np.concatenate(labels) if labels else np.zeros(0, np.int64)
    if not len(marks) or marks.min() == marks.max():
        return Model(np.zeros(1 << BITS), 0.0, float(prior))
    by = np.append(0, np.cumsum(np.concatenate(counts)))
    feature, sentence = np.concatenate(features), np.concatenate(sentences)
    del features, sentences
    seen = np.bincount(feature, minlength=1 << BITS)
    known = np.flatnonzero(seen >= 3)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    column = place[feature]
    column, sentence = column[column >= 0], sentence[column >= 0]
    del feature
    pieces = [(column[at : at + PIECE], sentence[at : at + PIECE]) for at in range(0, len(column), PIECE)]
    # the sample holds both labels in other shares than the corpus: weight its rows back
    weight = np.where(marks == 1, prior / marks.mean(), (1 - prior) / (1 - marks.mean()))
    n, doc = by[-1], np.repeat(np.arange(len(marks)), np.diff(by))
    w, b = np.zeros(len(known)), -5.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, steps + 1):
        z = np.full(n, b)
        for col, sen in pieces:
            z += np.bincount(sen, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.maximum(_noisy_or(p, by), 1e-9)
        slope = np.where(marks == 1, (1 - whole) / whole, -1.0) * weight
        dz = p * slope[doc]
        g = np.append(-ridge * w, dz.sum())
        for col, sen in pieces:
            g[:-1] += np.bincount(col, dz[sen], len(known))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    weights = np.zeros(1 << BITS)
    weights[known] = w
    return Model(weights, float(b))


def fit(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Train on whole texts of at most ``per_label`` documents of either label; all labels count for the toxic share."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(crc % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = usable.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_label pairs of integers
    rows = documents.select("doc_id", "text").join(wanted, "doc_id").orderBy("doc_id", "text").limit(4 * per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)) for batch in batches), share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias], pa.float64()), pa.array([model.constant], pa.float64())], ["weights", "bias", "constant"])

    # the sample is bounded, so one task can train on it; the driver only sees the weights
    row = rows.select("text", "toxic").coalesce(1).mapInArrow(lean(run), "weights binary, bias double, constant double").first()
    if row is None:
        return Model(np.zeros(1 << BITS), 0.0, share)
    return Model(np.frombuffer(row.weights, np.float32), row.bias, None if row.constant is None or row.constant != row.constant else row.constant)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` but score and offending, plus score, and offending: structs (start, end, p) in bytes of the
    sentences with p >= 0.5, or of the likeliest one."""
    return _scored(documents.drop("score", "offending"), model, "score", "offending")


def _scored(documents: DataFrame, model: Model, score_as: str, offending_as: str) -> DataFrame:
    keep = documents.columns
    spans = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("p", "double"))
    schema = T.StructType([*documents.schema.fields, T.StructField(score_as, T.DoubleType()), T.StructField(offending_as, spans)])
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.constant))
    offending = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, constant = shared.value
        own = Model(weights, bias, constant)
        for batch in batches:
            scores, spans = [], []
            for _, data, offs in text_chunks(batch.column("text")):
                feature, sentence, begin, end, by = _bags(data, offs)
                p = np.full(by[-1], constant) if constant is not None else _sentence_p(own, feature, sentence, by[-1])
                total = np.full(len(by) - 1, constant) if constant is not None else _noisy_or(p, by)
                scores.append(np.clip(total, 0, 1))
                most = np.maximum.reduceat(p, by[:-1])
                for i in range(len(by) - 1):
                    at = np.arange(by[i], by[i + 1])[p[by[i] : by[i + 1]] >= min(0.5, most[i])]
                    at = at if most[i] >= 0.5 else at[:1]
                    spans.append([{"start": int(begin[j] - offs[i]), "end": int(end[j] - offs[i]), "p": float(p[j])} for j in at])
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, offending)], [*keep, score_as, offending_as])

    return map_all(documents, run, schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5, with the columns and rows they came with."""
    score_as, offending_as = free_name(documents, "__score"), free_name(documents, "__offending")
    return _scored(documents, fit(documents, labels), score_as, offending_as).filter(F.col(score_as) < 0.5).select(*named(documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("offending")[0]["start"].alias("first_offending"))


def crc_mod5(doc_id: int) -> int:
    """The fold of a document, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
