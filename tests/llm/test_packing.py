"""Mixture-controlled packing against a literal round-robin, token by token, and on odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointline.llm import packing
from pointline.llm.packing import FRACTION, Rounds, Sequences
from pointline.llm.queries import op11_mixture_packing, vocabulary


def literal(sizes, weights, window):
    """The stream that deficit counters give when they are run round by round."""
    left, deficit, out = list(sizes), [0] * len(sizes), []
    while any(left):
        live = [s for s in range(len(sizes)) if left[s]]
        w = {s: weights[s] for s in live}
        if not sum(w.values()):
            w = dict.fromkeys(live, 1.0)
        for s in live:
            if w[s]:
                deficit[s] += max(1, round(window * (1 << FRACTION) * w[s] / sum(w.values())))
            take = min(left[s], deficit[s] >> FRACTION)
            out += [(s, sizes[s] - left[s] + j) for j in range(take)]
            left[s] -= take
            deficit[s] = deficit[s] - (take << FRACTION) if left[s] else 0
    return out


@pytest.mark.parametrize("seed", range(40))
def test_places_equal_the_literal_rounds(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, r.randint(0, 3000)]) for _ in range(r.randint(1, 6))]
    weights = [r.choice([0, 0.001, 1, 2.5, float(n)]) for n in sizes]
    length = r.choice([16, 64, 100])
    window = length * r.choice([1, 3])
    where = {t: i for i, t in enumerate(literal(sizes, weights, window))}
    rounds, sequences = Rounds(sizes, weights, window), Sequences(sum(sizes), length)
    for s, size in enumerate(sizes):
        cuts = sorted({0, size, *(r.randint(0, size) for _ in range(8))})
        if not size:
            continue
        first, n = np.array(cuts[:-1]), np.diff(cuts)
        doc, start, size_, place = rounds.places(s, first, n)
        got = {(s, int(first[d]) + a + j): p + j for d, a, k, p in zip(doc.tolist(), start.tolist(), size_.tolist(), place.tolist()) for j in range(k)}
        assert got == {t: i for t, i in where.items() if t[0] == s}
        for d, a, k, q, o in zip(*(x.tolist() for x in sequences.cut(doc, start, size_, place))):
            begin = int(sequences.start(np.array([q]))[0])
            assert all(where[s, int(first[d]) + a + j] == begin + o + j for j in range(k)) and o + k <= length


def whole(rows, ids, length):
    """Every id of every document in one piece, every sequence gapless, full or a power of two."""
    spans, sequences = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert spans.keys() == ids.keys()
    for doc, parts in spans.items():
        at = 0
        for start, n, crc, total in sorted(parts):
            assert start == at and n > 0 and total == len(ids[doc])
            assert crc == zlib.crc32(np.array(ids[doc][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids[doc])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_query_packs_every_id_and_keeps_every_window_to_the_sources_shares(spark, sf):
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    ids = {d.doc_id: [*library.encode(d.text or "", add_special_tokens=False).ids, 0] for d in docs}
    rows = op11_mixture_packing(spark, sf).collect()
    sequences = whole(rows, ids, 1024)
    total = sum(map(len, ids.values()))
    share = Counter()
    for d in docs:
        share[d.source] += len(ids[d.doc_id]) / total
    full = [q for q in sequences if q < total // 1024]
    found = {q: Counter() for q in full}
    for r in rows:
        if r.sequence_id in found:
            found[r.sequence_id][r.source] += r.length
    own = {s for s, p in share.items() if p * 1024 >= packing.LEAST}
    # a window's ends lie within one token a queue of a round's ends
    assert all(abs(found[q][s] - share[s] * 1024) <= len(own) + 3 for q in full[:-1] for s in own)


def test_odd_rows_weights_and_sequences(spark):
    texts = ["", None, "one two", "x" * 9_000, "same text", "same text", "é中😀 end"]
    rows = [(i, t, None if i == 2 else f"s{i % 2}", 7) for i, t in enumerate(texts)] + [(None, "no id", "s0", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, LENGTH int")
    docs = docs.union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(9)))
    library = Tokenizer.from_file(vocabulary())
    ids = {d.doc_id: [*library.encode(d.text or "", add_special_tokens=False).ids, 0] for d in docs.collect()}
    for weights in (None, {"s0": 3, "s1": 1}, {"s1": 1, None: 2, "absent": 5}):
        pieces = packing.pack_mixture(docs, vocabulary(), length=64, window=128, weights=weights, with_ids=True)
        sequences = whole(pieces.collect(), ids, 64)
        made = {r.sequence_id: r for r in packing.assemble_sequences(pieces).collect()}
        assert {q: r.n_tokens for q, r in made.items()} == {q: sum(n for _, n in parts) for q, parts in sequences.items()}
        assert Counter(i for r in made.values() for i in r.input_ids) == Counter(i for own in ids.values() for i in own)
    assert packing.pack_mixture(docs.limit(0), vocabulary()).count() == 0


def test_encoder_that_forgets_stays_right():
    encoder = packing.FrequentEncoder(vocabulary())
    encoder.limit = 60
    r = random.Random(3)
    library = Tokenizer.from_file(vocabulary())
    for _ in range(40):
        texts = [" ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(30)) for _ in range(4)]
        ids, n = encoder.encode_texts(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
