"""Operators do not lose what stands late in a text or lacks its rarest words."""

import random
import re

import numpy as np

from timbral.llm import licenses, toxicity


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    dice = random.Random(2)
    fine = ["the tree is blue.", "a house by the river!", "clouds run.", "stone and sky?"]
    rows = []
    for i in range(250):
        text = " ".join(dice.choice(fine) for _ in range(600))
        rows.append((i, text + f" you are an idiot number {dice.randrange(9)}." * (i % 5 == 0), int(i % 5 == 0)))
    assert all(len(text) > 8000 for _, text, _ in rows)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [r for r in rows if toxicity.crc_mod5(r[0]) == 0]
    assert {r[2] for r in held} == {0, 1} and all((found[r[0]].score >= 0.5) == bool(r[2]) for r in held)
    for r in held:
        if r[2]:
            spans = [r[1][s.start : s.end] for s in found[r[0]].offending]
            assert spans and all("idiot" in s for s in spans)


def test_licences_are_found_without_most_of_their_rarest_words(spark):
    fill = ["some plain words of no licence at all"] * 40
    docs = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = licenses.build_index(docs(fill))
    texts, want = [], []
    for t, x in zip(licenses.TEMPLATES, index, strict=True):
        plain = re.findall(r"[a-z0-9]+", t.text.lower())
        phrase = re.findall(r"[a-z0-9]+", t.mandatory)
        at = next(i for i in range(len(plain)) if plain[i : i + len(phrase)] == phrase)
        gone, left = [], 1.0
        for j in np.argsort(-x["weight"], kind="stable"):
            if len(gone) < 3 and not at <= j < at + len(phrase) and left - x["weight"][j] >= licenses.ACCEPT:
                gone.append(j)
                left -= x["weight"][j]
        if len(gone) == 3:
            texts.append("tail of another text " + " ".join("changed" if j in gone else w for j, w in enumerate(plain)))
            want.append((t.label, round(left, 6)))
    assert len(want) >= 3
    found = {r.doc_id: r for r in licenses.scan(docs(texts), index).collect()}
    for i, (label, share) in enumerate(want):
        assert any((s.label, round(s.share, 6), s.start) == (label, share, 4) for s in found[i].spans)
