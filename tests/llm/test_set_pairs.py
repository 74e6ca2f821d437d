"""Pairs of sets that are verified: near-linear in a group of near copies, each told a few times, and none lost."""

from __future__ import annotations

import random

import numpy as np

from pointline.llm import shingles
from test_near_dedup import brute_classes, frame

RNG = np.random.default_rng(7)


def test_a_turn_takes_one_partner_for_each_set():
    sets = RNG.integers(-(2**63), 2**63, 50, dtype=np.int64)
    i, j = np.triu_indices(50, 1)
    firsts = []
    for turn in range(4):
        own, other = shingles.first_partners(sets[i], sets[j], turn)
        assert sorted(own.tolist()) == sorted(sets.tolist()) and (own != other).all()
        # all but the first itself go with it
        hub, n = np.unique(other, return_counts=True)
        assert n.max() == 49
        firsts.append(int(hub[n.argmax()]))
    assert len(set(firsts)) > 1
    none = np.zeros(0, np.int64)
    assert [len(x) for x in shingles.first_partners(none, none, 0)] == [0, 0]


def group_of(rng, copies, words=150, changed=11):
    """Near copies of a text whose pairs are alike to some 0.7 to 0.9, so that their fingerprints often differ."""
    base = [f"v{k}" for k in rng.sample(range(10**6), words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(1, changed // 3)):
            own[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_rows_to_verify_dont_grow_with_the_square_of_a_group(spark, monkeypatch):
    rng = random.Random(11)
    made = []
    for copies in (40, 160):
        asked = []
        whole = shingles.stable

        def stable(df, asked=asked, whole=whole):
            out = whole(df)
            if out.columns == ["a", "b"]:
                asked.append(out.count())
            return out

        monkeypatch.setattr(shingles, "stable", stable)
        texts = group_of(rng, copies)
        found = shingles.jaccard_classes(frame(spark, list(enumerate(texts)))).collect()
        monkeypatch.setattr(shingles, "stable", whole)
        classes = {r.id: r["class"] for r in found}
        want = brute_classes(texts)
        assert len(set(classes.values())) == len(set(want)) and len({(classes[i], want[i]) for i in range(copies)}) == len(set(want))
        made.append(sum(asked))
    assert made[1] <= 8 * made[0]  # 16 if it grew with the square
    assert made[1] < 160 * 10
