"""Indexes and pruned joins against plain loops: names, similarity, ranges of days, streaming by buckets."""

from __future__ import annotations

import datetime
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pointline.operators import events as ops
from pointline.operators import intervals
from pointline.plans import search, similarity
from pointline.standins import match_events
from pointline.streaming import ingest as streaming


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_name_index_equals_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
    names = [(f"P{i}", f"{word()} {word().upper()}-{word()}") for i in range(150)] + [("none", None), ("empty", " !"), ("P0", "aa aa")]
    asks = [(i, f"{word()} {word()[:2]}" if i % 2 else word()) for i in range(60)] + [(90, ""), (91, None), (92, "zz zz")]
    people = spark.createDataFrame(names, "player_id string, display_name string")
    for share in (0.2, 0.34):
        index = search.name_index(people, share=share)
        got = {tuple(x) for x in search.search_names(*index, spark.createDataFrame(asks, "query_id int, query string"), share=share).collect()}
        want = set()
        for q, text in asks:
            own = set(re.findall("[a-z0-9]+", (text or "").lower()))
            for p, name in names:
                total = 0
                for a in own:
                    costs = [0 if w.startswith(a) else d for w in re.findall("[a-z0-9]+", (name or "").lower()) if (d := distance(a, w)) <= int(len(a) * share + 0.5) or w.startswith(a)]
                    total += min(costs, default=10**6)
                if own and total < 10**6:
                    want.add((q, p, name, total))
        assert got == want and len(want) > 20
    plan = search.search_names(*index, people.selectExpr("player_id AS query_id", "display_name AS query"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similarity_compares_few_rows_and_is_exact(spark):
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(40, 6))
    x = np.concatenate([h + rng.normal(size=(50, 6)) * 0.05 for h in heads])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # ties
    x[11] = 0.0
    rows = [(f"P{i:05}", [float(v) for v in own]) for i, own in enumerate(x)] + [("gone", None)]
    vectors = spark.createDataFrame(rows, "player_id string, vector array<double>")
    queries = vectors.where("player_id IN ('P00011', 'gone', 'nobody') OR substr(player_id, 6) = '3'")
    best, effort = similarity.search_similar(vectors, queries.select("player_id"), k=5)
    got = {}
    for q in best.orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.player_id, q.score))
    asked = [i for i in range(len(x)) if i == 11 or i % 10 == 3]
    for i in asked:
        s = np.round(x @ x[i], 9)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [p for p, _ in got[f"P{i:05}"]] == [f"P{j:05}" for j in order]
    assert set(got) == {f"P{i:05}" for i in asked}
    seen = {r.query_id: r.compared for r in effort.collect()}
    assert sum(n for q, n in seen.items() if q != "P00011") < 0.2 * len(x) * len(asked)
    none = vectors.limit(0)
    assert similarity.top_k_similar(none, queries.select("player_id")).count() == 0
    assert similarity.top_k_similar(vectors.where("player_id = 'P00003'"), queries.select("player_id")).count() == 0


def test_similarity_by_name(spark):
    vectors = spark.createDataFrame([("P1", [1.0, 0.0]), ("P2", [0.8, 0.6]), ("P3", [0.0, 1.0]), ("P4", [0.6, 0.8])], "player_id string, vector array<double>")
    names = spark.createDataFrame([("P1", "Ann Lee"), ("P2", "Bo Ray"), ("P3", "ann lee"), ("P4", "P1"), ("P5", "No Vector")], "player_id string, display_name string")
    asks = spark.createDataFrame([(1, "ANN LEE"), (2, "P1"), (3, "nobody"), (4, None), (5, "No Vector"), (6, "bo ray")], "ask_id int, query string")
    got = {(r.ask_id, r.rank): (r.player_id, r.display_name, r.score) for r in similarity.similar_to_names(vectors, names, asks, k=2).collect()}
    assert got == {
        (1, 1): ("P2", "Bo Ray", 0.8), (1, 2): ("P4", "P1", 0.6), (2, 1): ("P2", "Bo Ray", 0.8), (2, 2): ("P4", "P1", 0.6), (6, 1): ("P4", "P1", 0.96), (6, 2): ("P1", "Ann Lee", 0.8),
    }


def test_overlap_join_equals_all_pairs(spark):
    r = random.Random(6)
    day = lambda n: None if n is None else datetime.date(1969, 6, 1) + datetime.timedelta(days=n)

    def some(n):
        out = []
        for i in range(n):
            start = r.randint(0, 700)
            end = start + r.choice([0, 3, 20, 200, -2, -40])
            out.append((i, None if r.random() < 0.1 else start, None if r.random() < 0.1 else end))
        return out

    left, right = some(80), some(60)
    a = spark.createDataFrame([(i, day(s), day(e)) for i, s, e in left], "l int, ls date, le date")
    b = spark.createDataFrame([(i, day(s), day(e)) for i, s, e in right], "r int, rs date, re date")
    want = sorted((i, j) for i, s, e in left for j, u, v in right if None not in (s, e, u, v) and s <= v and e >= u)
    for days in (1, 16, 64, 5_000):
        joined = intervals.overlap_join(a, b, ("ls", "le"), ("rs", "re"), days)
        assert sorted((x.l, x.r) for x in joined.collect()) == want
        assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def test_stream_reads_only_touched_buckets(spark, sf, tmp_path):
    e = match_events(spark, sf).withColumn("ingested_at", F.lit("2002-01-01").cast("timestamp"))
    kept = e.orderBy("match_id").limit(400).collect()
    first = spark.createDataFrame(kept, e.schema)
    root = str(tmp_path)

    def arrive(rows, n):
        rows.coalesce(1).write.parquet(f"{root}/in{n}")
        stream = streaming.stream_events(spark, f"{root}/in{n}", e.schema)
        streaming.maintain(stream, f"{root}/events", f"{root}/table", ops.player_matches, f"{root}/c{n}", buckets=32, first_epoch=100 * n).awaitTermination()

    arrive(first, 0)
    # one event gets another player: the old one, the new one and the opponent are touched
    moved = first.where(F.col("match_id") == kept[5].match_id).withColumn("player1_id", F.lit("P999999999")).withColumn("winner_id", F.lit("P999999999")).withColumn("ingested_at", F.lit("2002-01-02").cast("timestamp"))
    before = {b.bucket: b.n for b in spark.read.parquet(f"{root}/events/log").groupBy("bucket").count().withColumnRenamed("count", "n").collect()}
    arrive(moved, 1)
    log = spark.read.parquet(f"{root}/events/log")
    touched = [b.bucket for b in log.where("epoch >= 100").select("bucket").distinct().collect()]
    assert 1 <= len(touched) <= 3
    read = streaming.touched_events(spark, f"{root}/events/log", touched)
    assert {int(re.search(r"bucket=(\d+)", f).group(1)) for f in read.inputFiles()} == set(touched)
    assert read.count() <= sum(before.get(b, 0) for b in touched) + len(touched) < 400
    now = first.where(F.col("match_id") != kept[5].match_id).union(moved)
    full, table = ops.player_matches(now), spark.read.parquet(f"{root}/table").drop("bucket")
    assert full.exceptAll(table.select(*full.columns)).count() == 0 and table.count() == full.count() == 800
