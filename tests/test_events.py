"""Directional rows, windows and point-in-time joins on hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointline import standins
from pointline.catalog.base import Tables
from pointline.operators import asof, events, features, incremental
from pointline.schemas import COUNT_STATS, FEATURE_COLS


def day(n: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def match_frame(spark, rows):
    """rows: (id, day number, winner, loser, surface); all counts are 1, or 0 with a trailing flag."""
    cols = "match_id string, match_date date, player1_id string, player2_id string, winner_id string, surface string, tournament string, round string, best_of short, is_indoor short, " + ", ".join(
        f"player{i}_{s} int" for i in (1, 2) for s in (*COUNT_STATS, "ranking", "rank_points")
    ) + ", player1_age double, player2_age double"
    data = []
    for r in rows:
        mid, d, w, l, s = r[:5]
        n = 0 if len(r) > 5 and r[5] == "walkover" else 1
        side = [n, n, 6 * n, 10 * n, 4 * n, 2 * n, 5 * n, n, 2 * n, None if len(r) > 5 and r[5] == "unranked" else 10, 500]
        data.append((mid, day(d), w, l, w, s, "masters", "f", 3, 0, *side, *side, 20.0, 0.0))
    return spark.createDataFrame(data, cols)


def test_expansion_zero_as_missing_and_ordinals(spark):
    e = match_frame(spark, [("m1", 0, "A", "B", "clay"), ("m2", 0, "A", "C", "hard"), ("m3", 31, "B", "A", "clay")])
    rows = {(r.match_id, r.player_id): r for r in events.player_matches(e).collect()}
    assert len(rows) == 6
    assert rows["m1", "B"].player_age is None and rows["m1", "A"].player_age == 20.0
    assert [rows[m, "A"].player_match_number for m in ("m1", "m2", "m3")] == [1, 2, 3]
    # same day doesn't count, 31 days before doesn't either
    assert [rows[m, "A"].matches_30d_before for m in ("m1", "m2", "m3")] == [0, 0, 0]
    assert rows["m1", "A"].return_points_won == 10 - 6
    assert rows["m3", "A"].match_won == 0 and rows["m3", "B"].match_won == 1


@pytest.mark.parametrize(("gap", "expected"), [(1, 1), (30, 1), (31, 0)])
def test_prior_count_boundaries(spark, gap, expected):
    e = match_frame(spark, [("m1", 0, "A", "B", "clay"), ("m2", gap, "A", "B", "clay")])
    assert events.player_matches(e).where("match_id = 'm2' AND player_id = 'A'").first().matches_30d_before == expected


def test_empty_and_walkover(spark):
    empty = match_frame(spark, [("m", 0, "A", "B", "clay")]).limit(0)
    assert events.rolling_features(events.player_matches(empty)).count() == 0
    one = events.rolling_features(events.player_matches(match_frame(spark, [("m", 0, "A", "B", "carpet", "walkover")]))).where("player_id = 'A'").first()
    assert one.ace_rate_10 == 0.5 and one.aces_per_svc_game_10 is None
    assert one.clay_win_rate_10 is None and one.dominance == pytest.approx(0.5 / 0.5)


def test_streak_decay_and_surface_carry(spark):
    e = match_frame(spark, [("m1", 0, "A", "B", "clay"), ("m2", 1, "A", "B", "hard"), ("m3", 2, "B", "A", "hard"), ("m4", 3, "B", "A", "grass")])
    rows = [r for r in events.rolling_features(events.player_matches(e)).where("player_id = 'A'").orderBy("player_match_number").collect()]
    assert [r.streak for r in rows] == [1, 2, -1, -2]
    assert rows[3].clay_win_rate_10 == pytest.approx(2 / 3) and rows[3].hard_win_rate_10 == pytest.approx(0.5) and rows[0].hard_win_rate_10 is None
    assert rows[2].weighted_form_10 == pytest.approx((0.81 + 0.9) / (0.81 + 0.9 + 1))


def test_decay_does_not_underflow(spark):
    long = spark.range(9000).select(F.array(F.lit(1.0), F.lit(0.0)).alias("v")).limit(1)
    assert long.select(events.decayed_mean(F.col("v"))).first()[0] == pytest.approx(0.9 / 1.9)


def test_all_null_ranking_window(spark):
    r = events.rolling_features(events.player_matches(match_frame(spark, [("m", 0, "A", "B", "clay", "unranked")]))).first()
    assert r.avg_player_rank_10 is None and r.latest_player_ranking is None


def test_as_of_is_strict_and_breaks_ties(spark):
    left = spark.createDataFrame([("A", day(1)), ("A", day(2)), ("B", day(5)), (None, day(9)), ("A", None)], "k string, d date")
    right = spark.createDataFrame([("A", day(1), "x", 1), ("A", day(1), "y", 2), ("A", day(2), "z", 3)], "k string, s date, id string, v int")
    got = {(r.k, r.d): r.v for r in asof.as_of_join(left, right, ["k"], "d", "s", ["v"], tie=["id"]).collect()}
    assert got == {("A", day(1)): None, ("A", day(2)): 2, ("B", day(5)): None, (None, day(9)): None, ("A", None): None}
    on = {(r.k, r.d): r.v for r in asof.as_of_join(left, right, ["k"], "d", "s", ["v"], tie=["id"], inclusive=True).collect()}
    assert on["A", day(2)] == 3 and on["A", day(1)] == 2


def test_last_n_prior_orders_and_excludes_the_day(spark):
    rows = [(f"m{i}", i // 2, "A", "B", "clay") for i in range(14)]
    got = {r.match_id: [p.tie for p in r.prior] for r in asof.last_n_prior(match_frame(spark, rows), "player1_id", "player2_id", "match_date", "match_id", ["winner_id"]).collect()}
    assert got["m0"] == got["m1"] == []
    assert set(got["m2"]) == {"m0", "m1"} and got["m2"] == got["m3"]
    asked = spark.createDataFrame([(1, "B", "A", day(3)), (2, "B", "A", day(0)), (3, "X", "A", day(9))], "q int, player1_id string, player2_id string, match_date date")
    found = {r.q: [p.tie for p in r.prior] for r in asof.last_n_prior_for(asked, match_frame(spark, rows), "player1_id", "player2_id", "match_date", "match_id", ["winner_id"]).collect()}
    assert found[1] == ["m5", "m4", "m3", "m2", "m1"] and found[2] == [] and found[3] == []


def test_swap_law_and_request_parity(spark, sf):
    t = Tables(spark, sf)
    gold = t.features.persist()
    assert features.swap_violations(gold).count() == 0
    asked = t.events.select(F.col("match_id").alias("request_id"), F.col("player1_id").alias("player_id"), F.col("player2_id").alias("opponent_id"), "match_date", "surface", "tournament", "round", "is_indoor", "best_of")
    got = features.request_features(asked, t.events, t.snapshots, t.defaults, t.profiles)
    both = got.join(gold.select(F.col("match_id").alias("request_id"), "player_id", *[F.col(c).alias(f"g_{c}") for c in FEATURE_COLS]), ["request_id", "player_id"])
    assert both.count() == t.events.count()
    off = [F.col(c).cast("double") - F.col(f"g_{c}").cast("double") for c in FEATURE_COLS]
    worst = both.select(F.greatest(*[F.abs(x) for x in off]).alias("x")).agg(F.max("x")).first()[0]
    assert worst < 1e-9
    gold.unpersist()


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_any_arrival_order_gives_the_full_build(spark, sf, order):
    e = standins.match_events(spark, sf).persist()
    full = events.player_matches(e)
    seen, built = None, None
    for k in order:
        part = e.where(F.col("batch") % 3 == k)
        seen = part if seen is None else seen.unionByName(part)
        touched = part.select(F.explode(F.array("player1_id", "player2_id")).alias("player_id")).distinct()
        built = events.player_matches(seen) if built is None else incremental.rebuild(seen, built, touched, events.player_matches)
    assert built.exceptAll(full).count() == 0 and full.exceptAll(built).count() == 0
    e.unpersist()
