"""The near-duplicate stage against brute-force Jaccard similarity, and rows with null or repeated ids."""

from __future__ import annotations

import random

import corpus_pipeline
from pointline.llm import shingles

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)


def stage(spark, rows):
    return corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()


def brute_classes(texts):
    """The smallest place that each text reaches by links of Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        own = (t or "").lower().split()
        sets.append({tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set())
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


def texts_of(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    passage = " ".join(rng.choices(words, k=40))
    out = []
    for _ in range(60):
        own = rng.choices(words, k=rng.randint(1, 160))
        out.append(" ".join(own))
        for _ in range(rng.randint(0, 4)):
            near = list(own)
            for _ in range(rng.randint(0, 1 + len(near) // 30)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    # a passage in many texts, and a chain
    out += [passage + " " + " ".join(rng.choices(words, k=rng.randint(2, 60))) for _ in range(80)]
    own = rng.choices(words, k=100)
    for k in range(12):
        out.append(" ".join(own))
        own = own[2:] + rng.choices(words, k=2)
    return out + ["", None, " \n", "one two", "ONE  two", "one two three"]


def test_stage_equals_brute_force_jaccard(spark, monkeypatch):
    texts = texts_of()
    want = {min(i for i, x in enumerate(label) if x == c) for label in [brute_classes(texts)] for c in label}
    for block, frequent in ((shingles.BLOCK, shingles.FREQUENT), (8, 10_000)):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles, "FREQUENT", frequent)
        assert {r.doc_id for r in stage(spark, list(enumerate(texts)))} == want


def test_rows_without_an_id_or_with_another_texts_id_stay(spark):
    clean = ["first text of five words", "second text that says other things", "third text about something else here"]
    rows = [(None, t) for t in clean]
    assert sorted(r.text for r in stage(spark, rows)) == sorted(clean)
    # a fourth copies a text with an id
    rows += [(7, "a document with an id of its own"), (None, "a document with an id of its own"), (None, clean[0])]
    assert sorted((str(r.doc_id), r.text) for r in stage(spark, rows)) == sorted([("None", t) for t in clean] + [("7", rows[3][1])])
    # one id, two texts
    rows = [(1, clean[0]), (1, clean[1]), (1, clean[1]), (2, clean[1])]
    assert sorted((r.doc_id, r.text) for r in stage(spark, rows)) == [(1, clean[0]), (1, clean[1])]
