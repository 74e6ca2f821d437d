"""Keys of near-duplicate sets: complete at 0.8, and seldom common to texts that share a passage; fingerprints come first."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pointline.llm import shingles

RNG = np.random.default_rng(3)


def hashes(n):
    return np.unique(RNG.integers(-(2**63), 2**63, n, dtype=np.int64))


def test_similar_sets_share_a_key():
    for n in [*range(4, 90), 150, 333, 1000, 4000] * 4:
        own = hashes(n)
        gone = RNG.integers(0, n // 5 + 1)
        # as many come as the similarity allows
        come = max(0, (5 * (n - gone) - 4 * n) // 4)
        other = np.unique(np.r_[RNG.permutation(own)[: n - gone], hashes(come)])
        both = len(np.intersect1d(own, other))
        assert both >= 0.8 * (n + len(other) - both)
        assert len(np.intersect1d(shingles.keys_of(own), shingles.keys_of(other)))


def test_sets_whose_hashes_crowd_share_a_key():
    # all hashes in few parts: the first shingles are keys
    for n in (8, 40, 300):
        own = np.sort(RNG.choice(10_000, n, replace=False)).astype(np.int64)
        other = np.delete(own, RNG.choice(n, n // 5, replace=False))
        assert len(np.intersect1d(shingles.keys_of(own), shingles.keys_of(other)))


def test_a_passage_in_all_texts_makes_few_keys_common():
    passage = hashes(46)
    sets = [np.unique(np.r_[passage, hashes(280)]) for _ in range(300)]
    common = Counter(k for s in sets for k in set(shingles.keys_of(s).tolist()))
    pairs = sum(n * (n - 1) // 2 for n in common.values())
    assert pairs < 0.2 * 300 * 299 / 2  # the first fifth of the shingles made 7 keys common to every pair


def test_shared_keys_over_batches_with_repeats():
    rows = [(1, 5), (1, 5), (2, 1), (2, 1), (2, 3), (2, 4), (4, 1), (5, 1), (5, 2), (5, 2)]
    want = [(2, 1), (2, 3), (2, 4), (5, 1), (5, 2)]
    for size in range(1, 11):
        batches = [pa.record_batch({"key": pa.array([k for k, _ in part], pa.int64()), "sig": pa.array([s for _, s in part], pa.int64())}) for part in itertools.batched(rows, size)]
        got = [tuple(r.values()) for out in shingles.shared_keys(iter([*batches[:1], batches[0].slice(0, 0), *batches[1:]])) for r in out.to_pylist()]
        assert got == want


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(6):
        own = rng.choices(words, k=300)
        texts += [" ".join(own), " ".join([*own[:-1], "end"])]
    asked = []

    def near_links(prints, *more):
        asked.append(prints.count())
        return links(prints, *more)

    links = shingles.near_links
    monkeypatch.setattr(shingles, "near_links", near_links)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 12, 2))
    assert len(asked) == 1 and asked[0] >= 6
