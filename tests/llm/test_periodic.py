"""Periodic runs against all periods, tried one by one, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pointline.llm.periodic import detect_runs, document_runs
from pointline.llm.queries import op13_periodic_runs


def all_runs(w, times=4, words=6):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(words, times * q) and not any(w[i : i + n - p] == w[i + p : i + n] for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_all_periods(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(12):
        n = r.randint(0, 70)
        w = [r.choice([b"a", b"b", b"c"][: r.choice([1, 2, 3])]) for _ in range(n)]
        if n and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // (3 + r.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        docs.append(w)
    assert document_runs(docs) == [all_runs(w) for w in docs]


def test_unary_and_long_documents():
    assert document_runs([[b"a"] * 30_000, [], [b"a", b"b"] * 9_000]) == [[(0, 30_000, 1)], [], [(0, 18_000, 2)]]


def test_query_equals_all_periods(spark, sf):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w, h = re.findall(r"[^\x20\x09-\x0D]+", d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 2_500:
            continue
        runs, gone = all_runs(w), set()
        for s, n, q in runs:
            gone |= set(range(s + q, s + n))
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (None, "a b " * 5), (3, "a b " * 5), (3, "a b " * 5), (4, "é x " * 7), (5, "w " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_RUNS", F.lit("x"))
    got = [(r.doc_id, r.n_runs, r.exponent_milli, r.collapsed) for r in detect_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(0, 0, None, None), (1, 0, None, ""), (2, 0, None, ""), (None, 1, 5000, "a b"), (3, 1, 5000, "a b"), (3, 1, 5000, "a b"), (4, 1, 7000, "é x"), (5, 1, 40_000_000, "w")], key=str
    )
    assert detect_runs(docs.limit(0)).count() == 0
