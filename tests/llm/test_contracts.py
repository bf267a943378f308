"""What the queries promise beyond the operators' own tests, against computations by hand."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import SCHEMA, corpus

import corpus_pipeline
from timbral.llm import sharding, simhash, toxicity
from timbral.llm.common import stash, word_hash

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_odd_and_empty_tables(spark):
    for rows in (corpus()[:24], []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stash(stage(spark, docs, DATA), name)
            if name != "packing":
                assert out.columns == docs.columns
            assert bool(out.count()) == bool(rows)
            docs = out


def test_noisy_or_by_hand(spark):
    dice = np.random.default_rng(4)
    model = toxicity.Model(dice.normal(size=1 << toxicity.BITS).astype(np.float32), -1.0)
    text = "Awful people here. A fine fine day\nwe are"

    def feature(word):
        stem = (word_hash(word[: toxicity.STEM]) + 1) % (1 << 64)
        return {word_hash(word) >> 64 - toxicity.BITS, stem >> 64 - toxicity.BITS}

    left = 1.0
    for sentence in (["awful", "people", "here"], ["a", "fine", "day"], ["we", "are"]):
        z = model.bias + sum(float(model.weights[k]) for k in set().union(*map(feature, sentence)))
        left *= 1 - 1 / (1 + math.exp(-z))
    found = toxicity.score(spark.createDataFrame([(1, text), (2, text), (3, "")], "doc_id long, text string"), model).collect()
    assert [r.score for r in found[:2]] == pytest.approx([1 - left] * 2, rel=1e-5) and found[2].score == pytest.approx(1 / (1 + math.e), rel=1e-5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_likeness_columns(spark):
    rows = sorted(simhash.query(spark, DATA).collect(), key=lambda r: r.doc_id)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 64 and r.near_next == 1 - bits(r.fingerprint, after.fingerprint) / 64
        assert r.n_near == (sum(bits(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in rows) - 1 if r.doc_id % 100 == 0 else None)


def test_equal_texts_share_a_shard(spark):
    docs = spark.createDataFrame([(i, f"text {i % 1500} " + "x" * (i % 1500 % 40)) for i in range(3000)], "doc_id long, text string").repartition(3)
    found = sharding.shard(docs).join(docs.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"))
    assert found.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    sizes = [r["sum(size)"] for r in found.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 200
