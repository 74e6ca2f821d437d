"""Whole texts reach the quality score: long words and long labelled texts."""

from __future__ import annotations

import numpy as np

from pointline.llm import quality


def test_every_character_of_a_long_word_counts():
    scalar = np.random.default_rng(1).normal(size=1 << 12).astype(np.float32)
    scores = quality.WordScores((scalar, 0.0, 2, 4, quality.REPEAT))
    ends = ("start" * 6, "close" * 6)
    a, b, c = (ends[0] + middle * 2_000 + ends[1] for middle in ("好的文字", "差的文字", "好的文字"))
    x = scores.score([a, b, c, f"{a} {b}", ""])
    assert x[0] == x[2] and abs(x[0] - x[1]) > 1e-6
    assert min(x[0], x[1]) <= x[3] <= max(x[0], x[1])
    again = quality.WordScores((scalar, 0.0, 2, 4, quality.REPEAT))
    assert np.allclose(again.score([b]), x[1]) and np.allclose(again.score([a]), x[0])


def test_long_labelled_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad### junk$$$ ") * 10_000) for i in range(1, 41)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert model.buckets > 2
    rows = quality.score_quality(docs, model).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in rows)
