"""Secret scan: fixed patterns, and a battery of randomness tests on opaque tokens.

A token is a run of letters, digits and the signs of base64. Its encoding is inferred from its
alphabet. Three tests look at it: chi-squared uniformity over cells of the alphabet, runs (changes
between kinds of symbols) and serial correlation (how often neighbours differ in being a vowel, or in
the half of the alphabet). Each is read twice. Under the hypothesis of randomness the token must not
stand out. Under the hypothesis that it is ordinary, each test has a p-value towards randomness,
whose distribution follows from the token's length and from what all shorter words of the corpus
with that encoding look like. The harmonic mean of the three, valid however they depend on one
another, is what the Benjamini-Hochberg rule ranks over all tested tokens of the corpus, by a
histogram; it keeps the expected share of false finds below ``rate``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text, stable

#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20}

#: Tokens tested: at least this long. Shorter words, from SHORT on, tell what is ordinary.
LEAST_TOKEN, SHORT = 20, 4
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, most special first: name, symbols in order.
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + LOWER[:6]),
    ("HEX", DIGITS + UPPER[:6]),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + DIGITS[2:8]),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("alnum", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
SYMBOLS = UPPER + LOWER + DIGITS + "+/-_"
VOWELS = frozenset("aeiouyAEIOUY")
#: A token is not random if the battery's p-value under randomness is below this.
BATTERY = 1e-3
#: Pairs of ordinary neighbours of any encoding that stand in for those of a rare one.
PRIOR = 2_000
#: Cells of the chi-squared test, at most; draws that tell its distribution over ordinary tokens.
CELLS, DRAWS = 16, 400
#: The histogram's bins: so many per factor of e, down to this exponent.
BINS, DEPTH = 8, 60


def chi2_tail(x: float, k: float) -> float:
    """Upper tail of the chi-squared distribution, by the Wilson-Hilferty approximation."""
    if k <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def char_class(c: str) -> int:
    """Bits that tell which encodings hold the character."""
    return sum(1 << k for k, (_, symbols) in enumerate(ENCODINGS) if c in symbols)


#: For each byte, the encodings that hold it and its place among SYMBOLS.
HOLDS = np.array([char_class(chr(b)) for b in range(256)], dtype=np.uint16)
PLACE = np.array([SYMBOLS.find(chr(b)) for b in range(256)], dtype=np.int16)


def kind_of(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3


def parts_of(symbols: str) -> list[list[int]]:
    """For each of SYMBOLS its kind, whether it is a vowel, and its half of an alphabet."""
    return [[kind_of(c) for c in SYMBOLS], [int(c in VOWELS) for c in SYMBOLS], [int(symbols.find(c) >= len(symbols) / 2) for c in SYMBOLS]]


#: By encoding: the three partitions of SYMBOLS, the symbols it has, and the partitions of its runs and serial tests.
PARTS = np.array([parts_of(symbols) for _, symbols in ENCODINGS], dtype=np.int8)
INSIDE = np.array([[c in symbols for c in SYMBOLS] for _, symbols in ENCODINGS])
LETTERS = np.array([any(c in LOWER + UPPER for c in symbols) for _, symbols in ENCODINGS])
MIXED = np.array([len({kind_of(c) for c in symbols}) > 1 for _, symbols in ENCODINGS])
TESTS = [(0, 1) if mixed and letters else (1, 2) if letters else (2, 2) for mixed, letters in zip(MIXED, LETTERS, strict=True)]
#: Per encoding: counts of symbols, of pairs of neighbours and of those that each partition tells apart.
WIDTH = len(SYMBOLS) + 4


def lowest_bit(x: np.ndarray) -> np.ndarray:
    """The most special encoding of each set of bits; -1 for none."""
    x = x.astype(np.int64)
    return np.where(x == 0, -1, np.log2(np.maximum(x & -x, 1)).astype(np.int64))


def ordinary_counts(texts: list[str]) -> np.ndarray:
    """What the words of SHORT to LEAST_TOKEN - 1 characters are like: a row of WIDTH counts per encoding."""
    out = np.zeros((len(ENCODINGS), WIDTH), dtype=np.int64)
    data = np.frombuffer("\n".join(texts).encode(errors="replace"), dtype=np.uint8)
    place = PLACE[data]
    inner = np.flatnonzero(place >= 0)
    if not len(inner):
        return out
    first = np.r_[True, np.diff(inner) > 1]
    size = np.diff(np.r_[np.flatnonzero(first), len(inner)])
    encoding = lowest_bit(np.bitwise_and.reduceat(HOLDS[data[inner]], np.flatnonzero(first)))
    encoding[(size < SHORT) | (size >= LEAST_TOKEN)] = -1
    e, symbol = np.repeat(encoding, size), place[inner].astype(np.int64)
    some = e >= 0
    out[:, : len(SYMBOLS)] = np.bincount(e[some] * len(SYMBOLS) + symbol[some], minlength=out.shape[0] * len(SYMBOLS)).reshape(len(out), -1)
    pair = np.flatnonzero(~first[1:] & some[1:])
    pe, a, b = e[pair], symbol[pair], symbol[pair + 1]
    out[:, -4] = np.bincount(pe, minlength=len(out))
    for k in range(3):
        out[:, k - 3] = np.bincount(pe[PARTS[pe, k, a] != PARTS[pe, k, b]], minlength=len(out))
    return out


def infer_encoding(token: str) -> int:
    """Number of the most special encoding; -1 for none."""
    return int(lowest_bit(np.bitwise_and.reduce(HOLDS[np.frombuffer(token.rstrip("=").encode(), np.uint8)], keepdims=True))[0])


def cell_shares(weights: np.ndarray, cells: int) -> np.ndarray:
    """Symbols' weights summed over equal cells of the alphabet."""
    return np.bincount(np.arange(len(weights)) * cells // len(weights), weights=weights, minlength=cells)


def measure(token: str) -> tuple[int, int, int, float, int, int, bool] | None:
    """(encoding, length, cells, chi-squared, differing pairs of the runs and of the serial test, whether it may be random); None without an encoding."""
    e = infer_encoding(token)
    if e < 0:
        return None
    symbols = ENCODINGS[e][1]
    token = token.rstrip("=")
    x = np.array([symbols.index(c) for c in token])
    n, m = len(x), len(symbols)
    # few symbols per cell: pool the alphabet into so many equal cells that each expects 2 or more
    cells = max(2, min(m, n // 2, CELLS))
    share = cell_shares(np.full(m, 1 / m), cells)
    count = np.bincount(x * cells // m, minlength=cells)
    chi = float(((count - n * share) ** 2 / (n * share)).sum())
    tails = [chi2_tail(chi, cells - 1)]
    own, differ = PLACE[np.frombuffer(token.encode(), np.uint8)], []
    inside = INSIDE[e]
    for k in TESTS[e]:
        part = PARTS[e, k]
        differ.append(int((part[own[1:]] != part[own[:-1]]).sum()))
        odds = 1 - float(((np.bincount(part[inside]) / m) ** 2).sum())
        tails.append(two_sided((differ[-1] - (n - 1) * odds) / math.sqrt((n - 1) * odds * (1 - odds))))
    # Fisher's combination: small if any test stands out under randomness
    fits = chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in tails), 6) >= BATTERY
    return e, n, cells, chi, differ[0], differ[1], fits


@lru_cache(65536)
def binomial_tail(n: int, k: int, p: float) -> float:
    """Natural log of P(Binomial(n, p) >= k), at any n: terms fall away from the mean, and those under 1e-18 of the sum are left out."""
    if k <= 0:
        return 0.0
    if p <= 0 or k > n:
        return -math.inf
    above = k > n * p  # else the other tail is summed, downwards
    i, odds = k if above else k - 1, p / (1 - p)
    first = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    term = total = 1.0
    while term > 1e-18 * total:
        term *= (n - i) / (i + 1) * odds if above else i / ((n - i + 1) * odds)
        i += 1 if above else -1
        total += term
    tail = min(first + math.log(total), -1e-15)
    return tail if above else math.log1p(-math.exp(tail))


def log_normal_tail(z: float) -> float:
    """Natural log of P(Z <= z)."""
    if z > -30:
        return math.log(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300))
    return -z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))


class Ordinary:
    """What ordinary tokens of each encoding are like."""

    def __init__(self, counts: np.ndarray):
        every = counts.sum(axis=0)
        # what stands in for a rare encoding: kinds as in all words of mixed kinds, vowels as in all with letters
        like = [counts[MIXED].sum(axis=0), counts[LETTERS].sum(axis=0), every]
        self.symbols, self.rates = [], []
        for e in range(len(ENCODINGS)):
            own = counts[e].astype(float)
            prior = every[: len(SYMBOLS)] * INSIDE[e]
            weight = own[: len(SYMBOLS)] + PRIOR * prior / max(prior.sum(), 1)
            weight = np.array([weight[SYMBOLS.index(c)] for c in ENCODINGS[e][1]])
            self.symbols.append(weight / weight.sum() if weight.sum() else np.full(len(weight), 1 / len(weight)))
            rates = []
            for k in TESTS[e]:
                share = np.bincount(PARTS[e, k][INSIDE[e]]) / INSIDE[e].sum()
                chance = 1 - float((share**2).sum())
                general = like[k][k - 3] / like[k][-4] if like[k][-4] else chance
                rates.append(((own[k - 3] + PRIOR * general) / (own[-4] + PRIOR), chance))
            self.rates.append(rates)
        self.spread: dict[tuple[int, int, int], tuple[float, float]] = {}

    def chi_root(self, e: int, n: int, cells: int) -> tuple[float, float]:
        """Mean and deviation of the root of chi-squared over ordinary tokens of n symbols."""
        if (e, n, cells) not in self.spread:
            m = len(self.symbols[e])
            share = cell_shares(np.full(m, 1 / m), cells)
            drawn = np.random.default_rng([e, n]).multinomial(n, cell_shares(self.symbols[e], cells), DRAWS)
            root = np.sqrt(((drawn - n * share) ** 2 / (n * share)).sum(axis=1))
            self.spread[e, n, cells] = float(root.mean()), float(max(root.std(), 0.25))
        return self.spread[e, n, cells]

    def log_p(self, e: int, n: int, cells: int, chi: float, runs: int, serial: int) -> float:
        """Natural log of the harmonic mean of the three p-values towards randomness."""
        mean, deviation = self.chi_root(e, n, cells)
        logs = [log_normal_tail((math.sqrt(chi) - mean) / deviation)]
        for (rate, chance), k in zip(self.rates[e], (runs, serial), strict=True):
            rate = min(max(rate, 1e-9), 1 - 1e-9)
            logs.append(binomial_tail(n - 1, k, rate) if chance > rate else binomial_tail(n - 1, n - 1 - k, 1 - rate))
        low = min(logs)
        return min(0.0, low + math.log(3) - math.log(sum(math.exp(low - x) for x in logs)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start and then kind as listed."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]] if ":" in text or "=" in text else []
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]] if "AKIA" in text else []
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def random_tokens(text: str) -> list[tuple[int, int, tuple]]:
    """(start, end, measures) of the tokens that may be random."""
    measured = [(*m.span(), measure(m.group())) for m in TOKEN.finditer(text)]
    return [(a, b, got[:-1]) for a, b, got in measured if got and got[-1]]


def level(counts: dict[int, int], tested: int, rate: float) -> float:
    """The largest p-value of the Benjamini-Hochberg rule, as a log; ``counts`` by bin of -log p."""
    seen, best = 0, -math.inf
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if -b / BINS <= math.log(rate * seen / max(tested, 1)):  # the bin's largest p-value
            best = -b / BINS
    return best


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """Secrets of every whole text.

    Returns ``id_col``, n_assign, n_access, n_hex, base_sha256 (of the base kinds' spans) and spans:
    kind:start:end of all spans in code points, end exclusive, by start and then kind (assign,
    access, hex, random), joined by commas. The test battery adds spans of kind random where no base
    span touches them. Null texts count as empty; null ids and repeated rows pass through; other
    columns aren't carried, so no name clashes. One pass over the texts writes the spans, the tokens'
    measures and, one row of each batch, the counts of ordinary words; only the sum of these counts
    (WIDTH numbers per encoding) and the histogram of p-values (BINS * DEPTH + 1 rows) reach the
    driver. Without ordinary words nothing tells random tokens apart, and there are no such spans.
    """
    token = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("e", T.IntegerType()), ("n", T.IntegerType()), ("cells", T.IntegerType()), ("chi", T.DoubleType()), ("runs", T.IntegerType()), ("serial", T.IntegerType()))]))
    base = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def make():
        def work(texts: list) -> list:
            spans, tokens, tested = [], [], []
            for text in texts:
                text = text or ""
                own = base_spans(text)
                found = [(a, b, got) for a, b, got in random_tokens(text) if not any(x < b and a < y for _, x, y in own)]
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                tokens.append([dict(zip(("start", "end", "e", "n", "cells", "chi", "runs", "serial"), (a, b, *got), strict=True)) for a, b, got in found])
                tested.append(sum(1 for _ in TOKEN.finditer(text)))
            digests = [hashlib.sha256(joined((s["kind"], s["start"], s["end"]) for s in own).encode()).hexdigest() for own in spans]
            counts = [ordinary_counts([t for t in texts if t]).ravel().tolist()] + [None] * (len(texts) - 1)
            return [spans, tokens, tested, digests, counts]

        return work

    fields = [T.StructField("base", base), T.StructField("tokens", token), T.StructField("tested", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("ordinary", T.ArrayType(T.LongType()))]
    rows = map_text(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")), ["__id"], "text", make, fields)
    rows = stable(rows)
    sums = dict(rows.select(F.posexplode("ordinary").alias("at", "n")).groupBy("at").agg(F.sum("n")).toLocalIterator())
    counts = np.array([sums.get(k, 0) for k in range(len(ENCODINGS) * WIDTH)], dtype=np.int64).reshape(-1, WIDTH)
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # a row per encoding

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = Ordinary(shared.value)
        for batch in batches:
            out = [[ordinary.log_p(*(t[c] for c in ("e", "n", "cells", "chi", "runs", "serial"))) for t in own] for own in batch.column(3).to_pylist()]
            columns = [batch.column(k) for k in range(3)]
            spans = pa.array([[{"start": t["start"], "end": t["end"]} for t in own] for own in batch.column(3).to_pylist()], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, spans, pa.array(out, pa.list_(pa.float64()))], names=["__id", "base", "base_sha256", "at", "p"])

    picked = rows.select("__id", "base", "base_sha256", "tokens")
    schema = T.StructType([*picked.schema.fields[:3], T.StructField("at", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("p", T.ArrayType(T.DoubleType()))])
    weighed = picked.mapInArrow(weigh, schema)
    bin_of = lambda p: F.least(F.floor(-p * BINS), F.lit(BINS * DEPTH))
    # rows without a token have no p-value, and the rule needs no others
    bins = picked.where(F.size("tokens") > 0).mapInArrow(weigh, schema).select(F.explode("p").alias("p")).groupBy(bin_of(F.col("p")).alias("bin")).count()
    found = {int(r[0]): int(r[1]) for r in bins.toLocalIterator()}
    most = level(found, int(rows.agg(F.coalesce(F.sum("tested"), F.lit(0))).first()[0]), rate)
    # a bin passes whole or not at all
    floor = int(round(-most * BINS)) if found and most > -math.inf else BINS * DEPTH + 1
    passed = F.filter(F.arrays_zip("at", "p"), lambda t: bin_of(t["p"]) >= floor)
    order = F.transform(F.col("base"), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    more = F.transform(passed, lambda t: F.struct(t["at"]["start"].alias("start"), F.lit(4).cast("long").alias("rank"), F.lit("random").alias("kind"), t["at"]["end"].alias("end")))
    text = F.transform(F.array_sort(F.concat(order, more)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return weighed.select(F.col("__id").alias(id_col), *count, "base_sha256", F.array_join(text, ",").alias("spans"))
