"""Metrics, calibration, promotion, drift, identity, sources and publishing on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointline.catalog.base import Tables
from pointline.functions import scalars as fn
from pointline.operators import identity, incremental
from pointline.plans import evaluation as ev
from pointline.plans import models
from pointline.plans.similarity import similarity_vectors
from pointline.sources import files, pages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_auc_with_ties_and_constant_scores(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, p double")
    assert ev.auc_table(same, "y", "p").first()[0] == 0.5
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert ev.auc_table(rows, "y", "p").first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    single = spark.createDataFrame([(1, 0.9)], "y int, p double")
    assert ev.auc_table(single, "y", "p").first()[0] is None


def test_loss_is_finite_at_the_ends(spark):
    rows = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double")
    assert ev.gate_metrics(rows, "y", "p").first().log_loss < 100


def test_temperature_recovers_and_keeps_auc(spark):
    rows = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("u"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0).alias("v"))
    rows = rows.select(fn.temperature_scaled(F.col("u"), F.lit(2.0)).alias("p"), (F.col("v") < F.col("u")).cast("int").alias("y")).persist()
    t = ev.fit_temperature(rows, "y", "p")
    assert 0.4 < t < 0.6
    scaled = rows.withColumn("q", fn.temperature_scaled(F.col("p"), F.lit(t)))
    assert ev.auc_table(scaled, "y", "q").first()[0] == pytest.approx(ev.auc_table(rows, "y", "p").first()[0])
    folded = rows.withColumn("fold", (F.pmod(F.xxhash64("p", "y"), F.lit(3)) + 1).cast("int"))
    got = ev.select_temperature(folded, "y", "p", "fold")
    assert got["accepted"] and got["scaled_log_loss"] < got["raw_log_loss"]


def test_promotion_rules():
    base = {"log_loss": 0.6, "roc_auc": 0.7}
    args = dict(champion_run="a", candidate_run="b", champion_hash="h", candidate_hash="h")
    assert not ev.decide_promotion(base, base, **args)
    assert ev.decide_promotion({"log_loss": 0.59, "roc_auc": 0.695}, base, **args)
    assert not ev.decide_promotion({"log_loss": 0.59, "roc_auc": 0.68}, base, **args)
    assert ev.decide_promotion({"log_loss": 0.605, "roc_auc": 0.71}, base, **args)
    assert ev.decide_promotion(base, base, **(args | {"candidate_hash": "x"}))
    assert not ev.decide_promotion({"log_loss": 0.1, "roc_auc": 0.9}, base, **(args | {"candidate_run": "a"}))
    assert ev.decide_promotion(base, base, force=True, **args)


def test_psi_of_equal_windows_is_zero(spark):
    rows = spark.range(200).select(F.explode(F.array(F.lit("current"), F.lit("reference"))).alias("window"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("flat"))
    got = {r["column"]: r.psi for r in ev.stability_index(rows, ["x", "flat"]).collect()}
    assert got["x"] == pytest.approx(0) and got["flat"] == pytest.approx(0)


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [("20 March - 2 April, 2024", (2024, 3, 20), (2024, 4, 2)), ("7 - 15 July, 2023", (2023, 7, 7), (2023, 7, 15)), ("30 December - 6 January, 2024", (2023, 12, 30), (2024, 1, 6)), ("5 May, 2025", (2025, 5, 5), (2025, 5, 5)), ("soon", None, None)],
)
def test_date_ranges(spark, text, start, end):
    a, b = fn.date_range(F.lit(text), F.lit(2026))
    got = one(spark, a.alias("a"), b.alias("b"))
    assert (got.a, got.b) == (start and dt.date(*start), end and dt.date(*end))


def test_event_ids_and_best_of(spark):
    r = one(spark, fn.event_id(F.lit("2026-418"), F.lit(26), F.lit(2026)).alias("a"), fn.event_id(F.lit("1987"), F.lit(1234), F.lit(20260105)).alias("b"), fn.best_of(F.lit("4"), F.lit("masters"), F.lit("f"), F.lit("6-4 4-6 6-4 6-4")).alias("c"), fn.best_of(F.lit(""), F.lit("grand_slam"), F.lit("RR"), F.lit(None).cast("string")).alias("d"))
    assert (r.a, r.b, r.c, r.d) == ("2026-418-026", "2026-1987-1234", 5, 1)


def test_sigmoid_is_stable(spark):
    r = one(spark, fn.sigmoid(F.lit(-1000.0)).alias("a"), fn.sigmoid(F.lit(1000.0)).alias("b"))
    assert (r.a, r.b) == (0.0, 1.0)


def test_sequence_ratio_matching_keeps_every_alike_name(spark):
    from difflib import SequenceMatcher

    names = ["annaberg", "anneberg", "johansson", "johanson", "petrova", "petrovna", "li", "wu yibing", "rafa nadal", "rafael nadal"]
    canonical = spark.createDataFrame([(f"P{i}", n) for i, n in enumerate(names)], "player_id string, name string")
    asks = ["annberg", "yibing wu", "nadal rafa", "petrov", "zzz", "johannsson", "rafael nadall"]
    sources = spark.createDataFrame([(f"S{i}", n) for i, n in enumerate(asks)], "source_id string, name string")
    stats = spark.createDataFrame([("P0", 3, 5)], "player_id string, matches long, best_rank int")
    got = {r.source_id: (r.player_id, r.ratio) for r in identity.match_names(sources, canonical, stats).collect()}
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    for i, a in enumerate(asks):
        turns = [key(a), key(" ".join(reversed(a.split())))]
        best = max(max(SequenceMatcher(None, t, key(n)).ratio() for t in turns) for n in names)
        assert (f"S{i}" in got) == (best >= 0.8), a
        if best >= 0.8:
            assert got[f"S{i}"][1] == pytest.approx(best)


def test_unknown_level_raises(spark, tmp_path):
    header = ",".join(files.RAW_REQUIRED)
    cells = dict.fromkeys(files.RAW_REQUIRED, "1") | {"tourney_level": "Q", "tourney_date": "20200101"}
    (tmp_path / "matches_2020.csv").write_text(header + "\n" + ",".join(cells[c] for c in files.RAW_REQUIRED) + "\n")
    (tmp_path / "challenger_2020.csv").write_text(header + "\n" + ",".join(cells[c] for c in files.RAW_REQUIRED) + "\n")
    rows = files.read_matches(spark, str(tmp_path))
    assert rows.count() == 1
    with pytest.raises(Exception, match="unknown tournament level"):
        files.to_match_events(rows).collect()


def test_wrong_header_fails(spark, tmp_path):
    (tmp_path / "r.csv").write_text("rank,ranking_date,player,points\n1,20240101,A,5\n")
    with pytest.raises(Exception):
        files.read_rankings(spark, str(tmp_path)).collect()


def test_publish_keeps_the_old_version_when_a_check_fails(spark, tmp_path):
    root = str(tmp_path / "snap")
    incremental.publish(spark.range(3).toDF("x"), root, "v1", [("empty", lambda d: d.where("x < 0"))])
    with pytest.raises(ValueError, match="negative"):
        incremental.publish(spark.createDataFrame([(-1,)], "x long"), root, "v2", [("negative", lambda d: d.where("x < 0"))])
    assert incremental.read_current(spark, root).count() == 3


def test_deleted_and_corrected_rows_are_seen(spark):
    built = spark.createDataFrame([("A", 1, 5), ("B", 2, 6), ("C", 3, 7)], "e string, k int, v int")
    fresh = spark.createDataFrame([("A", 1, 5), ("B", 2, 9), ("D", 4, 1)], "e string, k int, v int")
    got = {r.e for r in incremental.changed_by_windows(fresh, built, ["e", "k"], ["v"], "e").collect()}
    assert got == {"B", "C", "D"}


def test_payload_reasons(spark):
    rows = spark.createDataFrame([("p1", "A", "B", "not json"), ("p2", "A", "B", '{"Match": {"MatchId": "MS001"}}')], "payload_id string, player1_id string, player2_id string, json string")
    got = {r.payload_id: r.reason for r in pages.payload_events(rows).collect()}
    assert got == {"p1": "unreadable", "p2": "player missing"}


def test_similarity_of_players_without_matches(spark):
    people = spark.createDataFrame([("A", None, None, None, None), ("B", "R", "2H", 180, 2000)], "player_id string, handedness string, backhand string, height int, turned_pro int")
    life = ", ".join(f"{c} double" for c in ("first_serve_in_pct", "overall_serve_points_won_pct", "aces_per_service_game", "return_points_won_pct", "break_point_conversion_pct", "hard_win_rate", "clay_win_rate", "grass_win_rate", "hard_matches", "clay_matches", "grass_matches", "dominance", "match_count", "career_win_rate"))
    got = {r.player_id: r for r in similarity_vectors(people, spark.createDataFrame([], "player_id string, " + life), F.lit("2020-01-01").cast("date")).collect()}
    assert len(got["A"].vector) == 19 and got["A"].block_norms["identity"] == 0.0
    assert sum(x * x for x in got["B"].vector) == pytest.approx(1.0)


def test_out_of_fold_skips_the_first_band(spark, sf):
    from pointline.catalog.base import Tables

    rows = Tables(spark, sf).features
    folds = ev.assign_folds(rows, "match_id", "match_date", 2)
    preds = models.out_of_fold(rows, folds, "linear", {"maxIter": 3}, "linear")
    assert {r[0] for r in preds.select("fold").distinct().collect()} == {1, 2}
    evidence = ev.evidence_pairs(preds, ["linear"]).join(folds.select("match_id", "fold"), "match_id")
    assert 0.0 <= models.cross_fitted(evidence, ["linear"]).agg(F.avg("p_win")).first()[0] <= 1.0


def test_walk_forward_rejects_bad_folds(spark):
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("y"), F.lit(0.4).alias("p"), (F.col("id") % 3).cast("double").alias("fold"))
    ev.walk_forward(rows.withColumn("fold", F.col("fold") + 1), "y", "p", "fold", rounds=1)
    for bad in (F.col("fold") + 0.5, F.lit(1.0), F.when(F.col("y") == 1, 1.0).otherwise(2.0), F.when(F.col("fold") > 0, F.col("fold"))):
        with pytest.raises(ValueError):
            ev.walk_forward(rows.withColumn("fold", bad), "y", "p", "fold", rounds=1)


def test_alignment_is_one_to_one(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "id int, y int")
    preds = labels.select("id", "y", F.lit(0.5).alias("p"))
    assert ev.alignment_issues(preds, labels, ["id"], ["y"]).count() == 0
    assert ev.aligned(preds.where("id > 0"), labels.where("id > 0"), ["id"], ["y"]).count() == 2
    wrong = preds.where("id = 1").union(preds.where("id = 1")).union(spark.createDataFrame([(3, 1, 0.5), (2, 0, 0.5)], preds.schema))
    assert {r.id: r.issue for r in ev.alignment_issues(wrong, labels, ["id"], ["y"]).collect()} == {1: "repeated", 2: "differs", 3: "unexpected", None: "missing"}
    with pytest.raises(ValueError, match="1 differs, 1 missing, 1 repeated, 1 unexpected"):
        ev.aligned(wrong, labels, ["id"], ["y"])
    assert ev.alignment_issues(preds.limit(0), labels.limit(0), ["id"], ["y"]).count() == 0


def test_a_set_is_published_whole_or_not_at_all(spark, tmp_path):
    a, b = spark.range(3), spark.range(4)
    equal = ("equal", lambda s: s["a"].join(s["b"], "id", "left_anti"))
    incremental.publish_set({"a": a, "b": b}, str(tmp_path), "1", [equal])
    with pytest.raises(ValueError, match="equal"):
        incremental.publish_set({"a": b, "b": a}, str(tmp_path), "2", [equal])
    assert [t.count() for t in incremental.read_set(spark, str(tmp_path), ["a", "b"]).values()] == [3, 4]
    incremental.publish_set({"a": b, "b": b}, str(tmp_path), "3", [equal])
    assert incremental.read_set(spark, str(tmp_path), ["a"])["a"].count() == 4


def test_watermark_stays_where_a_build_fails(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2020-01-01' AS ingested_at")
    path = str(tmp_path / "state")
    with pytest.raises(RuntimeError):
        incremental.advance_watermark(events, path, "silver", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert not (tmp_path / "state").exists()
    incremental.advance_watermark(events, path, "silver", lambda: None)
    assert not incremental.watermarks(events, spark.read.parquet(path), "silver").first().stale


def test_search_tries_each_setting_once(spark, sf):
    rows = Tables(spark, sf).features.limit(400).cache()
    got = models.trials("linear", {"regParam": [0.01, 1.0], "maxIter": [2]}, 8, rows, rows)
    assert sorted(p["regParam"] for p, _ in got) == [0.01, 1.0]
    assert models.search("linear", {"regParam": [0.01, 1.0], "maxIter": [2]}, 8, rows, rows)[1] == min(m["log_loss"] for _, m in got)
