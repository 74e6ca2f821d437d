"""Lines that the pipeline's line_dedup drops beyond op2's rule."""

from __future__ import annotations

import random

import corpus_pipeline
from pointline.llm import linededup

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], FIELDS)
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def test_long_lines_go_from_two_texts_on(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ab", "ed", "im", "or", "un", "ast", "ell")]
    line = lambda n: " ".join(rng.choices(words, k=n))
    long, short, footer = line(60), line(20), line(12)
    changed = long.split()
    changed[40] = "changed"
    texts = [f"{line(70)}\n{long}\n{footer}", f"{line(40)}\n{long}", f"{line(40)}\n{' '.join(changed)}\n{short}", f"{line(90)}\n{short}"]
    texts += [f"{line(30)}\n{footer}" for _ in range(5)]
    variant = footer.split()
    variant[7] = "variant"
    texts += [f"{line(30)}\n{' '.join(variant)}"]
    got = staged(spark, texts)
    assert got[0] == texts[0] and got[3] == texts[3]
    assert got[1] == texts[1].split("\n")[0]
    assert got[2].split("\n") == [texts[2].split("\n")[0], short]
    for i in range(4, 10):
        assert got[i] == texts[i].split("\n")[0]
    # near copies keep their lines for near_dedup
    near = line(300)
    copies = [f"{near}\nfirst end of it", f"{near}\nsecond end of it"]
    assert staged(spark, copies) == dict(enumerate(copies))


def test_variants_are_found_by_any_piece(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ab", "ed", "im", "or", "un")]
    base = rng.choices(words, k=25)
    rows = [(i, f"own {i}\n" + " ".join(base)) for i in range(5)]
    want = {}
    for i in range(5, 60):
        own, k = list(base), rng.randint(0, 8)
        for p in rng.sample(range(3, 25), k):
            own[p] = f"{own[p]}x{'abcdefgh'[rng.randrange(8)]}{'abcdefgh'[rng.randrange(8)]}"
        rows.append((i, " ".join(own)))
        want[i] = k <= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs, variants=True).collect()}
    assert all(got[i] == 1 for i, near in want.items() if near)
    assert sum(got[i] == 0 for i, near in want.items() if not near) > 0
