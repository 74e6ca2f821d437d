"""What workers hold: one operator's table, no steps of many times the size of the Golay table, no turns that lead nowhere."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

import corpus_pipeline
from pointline.llm import batches, bpe, quality, shingles, simhash
from pointline.llm.queries import vocabulary


def test_the_golay_table_is_made_in_pieces():
    tracemalloc.start()
    table = simhash.decoder.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * table.nbytes
    # every codeword's neighbours within three flips decode to it: 2^11 words each
    assert (np.bincount(table, minlength=1 << 12) == 1 << 11).all()
    rng = np.random.default_rng(5)
    word = rng.integers(0, 1 << 23, 1000)
    near = np.stack([table[word ^ (1 << k)] for k in range(23)], axis=1)
    assert (near == table[word][:, None]).any(axis=1).all()


def test_a_worker_keeps_one_table():
    first = bpe.worker_encoder(vocabulary())
    assert bpe.worker_encoder(vocabulary()) is first
    made = batches.kept("another", lambda: quality.WordScores((np.zeros(9, np.float32), 0.0, 2, 4, 0)))
    assert list(batches._kept.values()) == [made]
    batches.forget()
    assert not batches._kept


def test_turns_end_when_they_lessen_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(5000)]
    passage = rng.choices(words, k=200)
    texts = []
    for _ in range(40):
        # alike in 160 to 180 of 200 shingles, so pairs are on either side of the threshold
        own = list(passage)
        own[:20] = rng.choices(words, k=20)
        texts.append(" ".join(own + rng.choices(words, k=rng.randint(0, 60))))
    turns = []

    def connected_components(links, *more):
        turns.append(links.count())
        return components(links, *more)

    components = shingles.connected_components
    monkeypatch.setattr(shingles, "connected_components", connected_components)
    monkeypatch.setattr(shingles, "LEFT", 0.0)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    ended = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    few = len(turns)
    monkeypatch.setattr(shingles, "LEFT", float("inf"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ended
    assert few <= 4 and len(turns) - few >= few


def test_stages_hand_workers_bounded_batches(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text", "'en' AS lang", "'s' AS source", "100000L AS n_chars").coalesce(1)
    corpus_pipeline.bpe(spark, docs, "")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"bytes": [batch.nbytes]})

    found = [r[0] for r in docs.select("text").mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) >= 60_000_000 and max(found) < 12_000_000
