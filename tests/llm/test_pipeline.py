"""The stages of the pipeline, each against brute force on what the one before kept."""

import os
import re

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_jaccard, brute_kept, lower, ordered

import corpus_pipeline
from timbral.llm.common import stash

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    tables = [spark.read.parquet(f"{DATA}/documents.parquet")]
    columns = tables[0].columns
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stash(stage(spark, tables[-1], DATA), name))
    whole, gentle, unique, cut, fresh, pieces = ([(r.doc_id, r.text) for r in t.select("doc_id", F.col("text") if "text" in t.columns else F.lit("").alias("text")).collect()] for t in tables)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "decontamination", "packing"]
    assert all(t.columns == columns for t in tables[1:5])
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").collect()}
    assert {i for i, _ in whole} >= {i for i, _ in gentle} and not [i for i, _ in set(whole) - set(gentle) if i not in toxic and i in {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}]
    assert sorted(i for i, _ in unique) == sorted({c for _, _, c in brute_jaccard(gentle, 5, 80)})
    assert set(unique) <= set(gentle)
    # a character that is cut in half goes whole
    left = [kept.decode("utf-8", "ignore") for kept in brute_kept(unique, 200)]
    assert sum(map(len, left)) < sum(len(t) for _, t in unique)
    assert ordered(cut) == ordered([(i, t) for (i, _), t in zip(unique, left, strict=True)])
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = re.findall(pattern, lower(r.text))
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, min(len(w), 1)))}
    kept = []
    for i, t in cut:
        w, hit = re.findall(pattern, lower(t)), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((i, t))
    assert ordered(fresh) == ordered(kept)
    assert {i for i, _ in pieces} == {i for i, _ in fresh}
    assert corpus_pipeline.run(spark, DATA).count() == len(pieces)
