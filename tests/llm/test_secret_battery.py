"""Which random tokens the battery finds, by alphabet and length, and the false-discovery rule against brute force."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pointline.llm import secretscan as S

WORDS = "the of and to in that was with from this have which their there would about other into more time only some could these than first people made over such work well year also back after under through between house world still where most great again never part small found place right while last might long another take good Every State Many London Paris John Report2 part2 v10 20240512 1998 x86 ABC DEF0 cafe face 12ab".split()


@pytest.fixture(scope="module")
def ordinary():
    rng = random.Random(1)
    return S.Ordinary(S.ordinary_counts([" ".join(rng.choices(WORDS, k=2_000)) for _ in range(50)]))


#: Least share of random tokens with a p-value below 1e-3: (20 to 40 characters, 64 characters). Decimals look as
#: random in ordinary numbers, so they can't be told; single-case letters need length.
FOUND = {"decimal": (0, 0), "hex": (0.6, 0.9), "HEX": (0.6, 0.9), "lower": (0.15, 0.9), "upper": (0.15, 0.9), "base32": (0.3, 0.9), "base36": (0.3, 0.9), "BASE36": (0.3, 0.9), "alnum": (0.8, 0.95), "base64": (0.8, 0.95), "base64url": (0.6, 0.95)}


@pytest.mark.parametrize("name", FOUND)
def test_detection_by_alphabet_and_length(ordinary, name):
    symbols, rng = dict(S.ENCODINGS)[name], random.Random(name)
    shares = []
    for lengths in (range(20, 41), [64]):
        found = 0
        for _ in range(300):
            got = S.measure("".join(rng.choices(symbols, k=rng.choice(lengths))))
            found += got is not None and got[-1] and ordinary.log_p(*got[:-1]) < math.log(1e-3)
        shares.append(found / 300)
    print(name, shares)
    assert all(s >= least for s, least in zip(shares, FOUND[name], strict=True)), shares


def test_ordinary_tokens_have_calibrated_p_values(ordinary):
    rng, low, n = random.Random(4), 0, 4_000
    for _ in range(n):
        token = ""
        while len(token) < 20:
            token += rng.choice(WORDS).lower()
        got = S.measure(token)
        low += got is not None and got[-1] and ordinary.log_p(*got[:-1]) < math.log(1e-3)
    assert low <= 0.01 * n


def test_known_ordinary_tokens_are_not_found(ordinary):
    for token in ("Access-Control-Allow-Origin", "com_example_foo_bar_baz", "Rechtsschutzversicherungsgesellschaften", "MAX_BUFFER_SIZE_IN_BYTES", "a" * 30, "-" * 30, "0" * 30, "AbstractSingletonProxyFactoryBean"):
        got = S.measure(token)
        assert got is None or not got[-1] or ordinary.log_p(*got[:-1]) > math.log(1e-3), token


def test_counts_of_ordinary_words_equal_brute_force():
    texts = ["the cat_7 Hello-World abc1 ABC1 12345 añob deadbeef", "x" * 19 + " " + "y" * 20 + " abc", ""]
    want = np.zeros((len(S.ENCODINGS), S.WIDTH), dtype=int)
    for text in texts:
        word = ""
        for c in text + "\n":
            if c in S.SYMBOLS:
                word += c
                continue
            e = next((k for k, (_, symbols) in enumerate(S.ENCODINGS) if set(word) <= set(symbols)), -1) if word else -1
            if S.SHORT <= len(word) < S.LEAST_TOKEN and e >= 0:
                own = [S.SYMBOLS.index(x) for x in word]
                for x in own:
                    want[e, x] += 1
                for a, b in zip(own, own[1:]):
                    want[e, -4] += 1
                    for k in range(3):
                        want[e, k - 3] += S.PARTS[e, k, a] != S.PARTS[e, k, b]
            word = ""
    assert (S.ordinary_counts(texts) == want).all()


def brute_level(ps, tested, rate):
    """Benjamini-Hochberg: the largest p with p <= rate * (number of p-values up to it) / tested."""
    ps = sorted(ps)
    return max((p for k, p in enumerate(ps, 1) if p <= rate * k / tested), default=0.0)


@pytest.mark.parametrize("rate", [0.001, 0.01, 0.2, 0.5])
def test_level_equals_brute_force_on_binned_values(rate):
    rng = random.Random(9)
    for _ in range(200):
        bins = [min(int(-math.log(max(rng.random() ** rng.choice((1, 4, 30)), 1e-40)) * S.BINS), S.BINS * S.DEPTH) for _ in range(rng.randint(1, 60))]
        tested = len(bins) + rng.randint(0, 200)
        got = S.level({b: bins.count(b) for b in bins}, tested, rate)
        want = brute_level([math.exp(-b / S.BINS) for b in bins], tested, rate)
        assert (got == -math.inf and want == 0) or math.isclose(math.exp(got), want)


def test_spans_of_a_corpus(spark):
    rng = random.Random(2)
    draw = lambda name, n: "".join(rng.choices(dict(S.ENCODINGS)[name], k=n))
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 300))) for _ in range(300)]
    planted = {k: draw(name, 64) for k, name in ((10, "alnum"), (20, "base64"), (30, "HEX"), (40, "base64url"), (50, "lower"))}
    for k, token in planted.items():
        texts[k] += " (" + token + ") é"
    texts += [None, "", "Rechtsschutzversicherungsgesellschaften " + "w" * 100_000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[10], "x"), (10, texts[10], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = S.scan_secrets(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[10 if r.doc_id is None else r.doc_id] or ""
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        token = planted.get(10 if r.doc_id is None else r.doc_id)
        assert [text[a:b] for a, b in spans] == ([token] if token else []), r


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.2), (40, 0.9), (300, 0.37), (900, 0.62)])
def test_binomial_tail_is_the_sum(n, p):
    for k in range(n + 1):
        exact = sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1)) if n < 50 else None
        got = S.binomial_tail(n, k, p)
        if exact is not None:
            assert got == pytest.approx(math.log(exact), rel=1e-9, abs=1e-12)
        # both tails of a long token make one
        elif 0 < k:
            assert math.exp(got) + math.exp(S.binomial_tail(n, n - k + 1, 1 - p)) == pytest.approx(1, rel=1e-9)


@pytest.mark.parametrize("n", [25_000, 200_000, 5_000_000])
def test_binomial_tail_of_very_long_tokens(n):
    i = np.arange(n)
    logs = np.r_[0, np.cumsum(np.log((n - i) / (i + 1)))] + np.arange(n + 1) * math.log(0.8) + np.arange(n, -1, -1) * math.log(0.2)
    terms = np.exp(logs)
    for z in (-4, -2, -0.5, 0.5, 2, 4):
        k = round(n * 0.8 + z * math.sqrt(n * 0.16))
        assert S.binomial_tail(n, k, 0.8) == pytest.approx(math.log1p(-terms[:k].sum()) if z < 0 else math.log(terms[k:].sum()), rel=1e-6)
