"""Top-k over many blocks against brute force, and mixing where sources are many."""

from __future__ import annotations

import numpy as np
import pytest

from pointline.llm import mixing, topk


@pytest.mark.parametrize("table", [topk.BLOCK_TABLE, 0])
def test_top_k_of_clustered_vectors_in_many_blocks(spark, monkeypatch, table):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK_TABLE", table)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8)) * 40
    rows = [(i, (centers[i % 12] + rng.normal(size=8) * (0 if i < 200 else 1)).tolist()) for i in range(600)]
    rows += [(10_000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(df, every=10).collect()}
    ints = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    want = {}
    for q in (i for i in ints if i % 10 == 0):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_blocks_are_ruled_out_where_vectors_cluster():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8)) * 1000
    x = np.rint(centers[np.arange(600) % 12] + rng.normal(size=(600, 8)))
    pivots = topk.choose_pivots(x, 12)
    far, square = topk.pivot_distances(x, pivots), (x**2).sum(axis=1)
    least = np.sort(x[:1] @ x.T)[0, -6]
    left = 0
    for p in range(12):
        own = far.argmin(axis=1) == p
        gap = np.maximum(np.maximum(far[own].min(axis=0) - far[0], far[0] - far[own].max(axis=0)), 0).max()
        left += topk.most_product(np.array(gap), 1e4, square[0], square[own].max()) >= least
    assert left <= 6


def test_values_beyond_16_bits_are_packed_whole():
    x = np.array([[1, -2, 32767], [40000, 2, -(2.0**40)]])
    assert (topk.unpack(topk.pack(x), 3) == x).all() and [len(b) for b in topk.pack(x)] == [6, 24]


def test_many_sources_mix_as_few_do(spark, monkeypatch):
    rows = [(i, "w " * (i % 50), None if i % 37 == 0 else f"s{i % 61}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    few = sorted(map(tuple, mixing.mix_sources(docs, carry=["doc_id"]).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs, carry=["doc_id"]).collect())) == few
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.rate, r.copies) for r in mixing.mix_sources(docs).collect()) == few
    assert len(few) == 900


def test_very_long_texts_and_no_rows_mix(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.size for r in mixing.mix_sources(docs).orderBy("doc_id").collect()] == [300_000, 0]
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.emit_copies(mixing.mix_sources(docs.limit(0)), ["doc_id"]).count() == 0
