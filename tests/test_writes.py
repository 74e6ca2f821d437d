"""Validated inserts, bucketed upserts and batched ratios."""

from __future__ import annotations

import glob
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pointline.catalog import serve, train
from pointline.operators import identity, writes
from pointline.operators.ratios import ratios
from pointline.standins import match_events


def test_validated_insert_counts_and_reasons(spark, tmp_path):
    rules = {"odd": F.col("v") % 2 == 1, "named": F.col("surface") != ""}
    first = spark.createDataFrame([("a", 1, "Clay"), ("a", 3, "grass"), ("b", 2, "x"), (None, 5, None), ("c", None, "hard")], "id string, v int, surface string")
    path = str(tmp_path / "t")
    assert writes.validated_insert(first, rules, ["id"], path, 0) == {"n_input": 5, "n_valid": 3, "n_dropped": 2, "n_skipped": 1, "n_inserted": 2}
    again = {"n_input": 5, "n_valid": 3, "n_dropped": 2, "n_skipped": 1, "n_inserted": 2}
    assert writes.validated_insert(first, rules, ["id"], path, 0) == again  # a batch replaces itself
    second = spark.createDataFrame([("a", 7, "clay"), ("d", 9, " GRASS ")], "id string, v int, surface string")
    assert writes.validated_insert(second, rules, ["id"], path, 1) == {"n_input": 2, "n_valid": 2, "n_dropped": 0, "n_skipped": 1, "n_inserted": 1}
    assert {tuple(r) for r in writes.inserted_rows(spark, path).select("id", "v", "surface").collect()} == {("a", 1, "clay"), (None, 5, "hard"), ("d", 9, "grass")}
    assert {(r.id, tuple(r.issues)) for r in writes.quarantined_rows(spark, path).collect()} == {("b", ("odd",)), ("c", ("odd",))}


def test_upsert_leaves_untouched_files(spark, sf, tmp_path):
    e = match_events(spark, sf).select("match_id", "surface").limit(300)
    path, at = str(tmp_path / "u"), lambda s: F.to_timestamp_ntz(F.lit(s))
    assert writes.upsert_buckets(path, e, ["match_id"], at("2002-01-01"), buckets=16).where("action = 'inserted'").count() == 300
    files = lambda: {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    one = e.orderBy("match_id").limit(1)
    assert writes.upsert_buckets(path, one, ["match_id"], at("2002-02-02"), buckets=16).count() == 0 and files() == before
    new = one.withColumn("surface", F.lit("ice"))
    assert writes.upsert_buckets(path, new, ["match_id"], at("2002-02-02"), overwrite=False, buckets=16).count() == 0 and files() == before
    got = writes.upsert_buckets(path, new.union(new), ["match_id"], at("2002-02-02"), buckets=16).collect()
    assert [(r.match_id, r.action) for r in got] == [(one.first().match_id, "updated")]
    gone = {f.split("/")[-2] for f in before - files()}
    assert len(gone) == 1 and {f.split("/")[-2] for f in files() - before} == gone
    table = spark.read.parquet(path)
    assert table.count() == 300 and table.where("ingested_at > '2002-01-15'").count() == 1 and table.where("surface = 'ice'").count() == 1


def test_ratios_equal_difflib():
    r = random.Random(5)
    word = lambda sizes: "".join(r.choice("abcdé😀"[: r.choice([1, 2, 4, 6])]) for _ in range(r.choice(sizes)))
    a = [word([0, 1, 5, 12, 30]) for _ in range(600)]
    b = [word([0, 1, 5, 12, 30, 220]) for _ in range(600)]
    assert ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]


def test_identity_by_ratio_equals_plain_loops(spark, sf):
    got = {r.source_id: (r.player_id, r.ratio) for r in train.fuzzy_identity_ratio(spark, sf).collect()}
    plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    players = [(p.player_id, plain(p.name)) for p in serve.player_names(spark, sf).collect()]
    stats = {s.player_id: (-s.matches, s.best_rank or 10**9) for s in identity.activity(match_events(spark, sf)).collect()}
    for s in serve.source_names(spark, sf).collect():
        keys = [plain(s.name), plain(" ".join(reversed(s.name.split(" "))))]
        exact = [p for k in keys for p, n in players if n == k][:1] and next([p for p, n in players if n == k] for k in keys if any(n == k for _, n in players))
        score = {p: max(SequenceMatcher(None, k, n).ratio() for k in keys) for p, n in players}
        best = max(score.values())
        found = exact or ([p for p, x in score.items() if x == best] if best >= 0.8 else [])
        want = min(found, key=lambda p: (*stats.get(p, (0, 10**9)), p)) if found else None
        assert got.get(s.source_id, (None,))[0] == want
        assert want is None or got[s.source_id][1] == round(1.0 if exact else best, 6)
