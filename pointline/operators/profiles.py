"""Lifetime aggregates of players, the one-row defaults table, and head-to-head summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import POOL_CONSTANTS, POOL_MEDIANS, SNAPSHOT_VALUES
from .events import dominance_ratio
from .ordered import exact_medians, shared_folder

#: Weighted lifetime ratios: name, numerator, denominator.
OWN_RATIOS = {
    "first_serve_in_pct": ("first_serves_made", "total_serve_points"),
    "aces_per_first_serve": ("aces", "first_serves_made"),
    "first_serve_points_won_pct": ("first_serve_points_won", "first_serves_made"),
    "second_serve_points_won_pct": ("second_serve_points_won", "total_serve_points - first_serves_made"),
    "overall_serve_points_won_pct": ("first_serve_points_won + second_serve_points_won", "total_serve_points"),
    "double_faults_per_serve_point": ("double_faults", "total_serve_points"),
    "aces_per_service_game": ("aces", "service_games"),
    "break_points_saved_pct": ("break_points_saved", "break_points_faced"),
    "return_points_won_pct": ("return_points_won", "return_points_available"),
}
#: The same of the other side's statistics.
RETURN_RATIOS = {
    "first_serve_return_points_won_pct": ("first_serves_made - first_serve_points_won", "first_serves_made"),
    "second_serve_return_points_won_pct": ("total_serve_points - first_serves_made - second_serve_points_won", "total_serve_points - first_serves_made"),
    "return_games_won_pct": ("break_points_faced - break_points_saved", "service_games"),
    "break_point_conversion_pct": ("break_points_faced - break_points_saved", "break_points_faced"),
    "break_point_opportunities_per_return_game": ("break_points_faced", "service_games"),
}
#: Benchmarks over all rows.
TOUR_RATIOS = {
    "tour_ace_rate": ("aces", "first_serves_made"),
    "tour_first_serve_pct": ("first_serves_made", "total_serve_points"),
    "tour_break_points_saved_pct": ("break_points_saved", "break_points_faced"),
    "tour_first_serve_win_pct": ("first_serve_points_won", "first_serves_made"),
    "tour_second_serve_win_pct": ("second_serve_points_won", "total_serve_points - first_serves_made"),
    "tour_serve_win_pct": ("first_serve_points_won + second_serve_points_won", "total_serve_points"),
    "tour_return_points_won_pct": ("return_points_won", "return_points_available"),
    "tour_df_rate": ("double_faults", "total_serve_points"),
    "tour_aces_per_svc_game": ("aces", "service_games"),
    "tour_break_point_opportunities_per_return_game": ("break_points_faced", "service_games"),
    "tour_return_games_won_pct": ("break_points_faced - break_points_saved", "service_games"),
}


def weighted_ratio(numerator: str, denominator: str) -> Column:
    """Sum over sum; null without opportunities."""
    return F.try_divide(F.sum(F.expr(numerator)).cast("double"), F.sum(F.expr(denominator)))


def opponent_rows(matches: DataFrame) -> DataFrame:
    """The other side's row of each event, under the player's id."""
    swap = {"player_id": "opponent_id", "opponent_id": "player_id"}
    return matches.select(*[F.col(c).alias(swap.get(c, c)) for c in matches.columns])


def latest_by(value: str, *order: str, where: Column | None = None) -> Column:
    """The value of the latest row, by the order's columns; rows where ``where`` fails don't count."""
    rank = F.struct(*order)
    return F.max_by(F.col(value), rank if where is None else F.when(where, rank))


def earliest_by(value: str, *order: str, where: Column | None = None) -> Column:
    rank = F.struct(*order)
    return F.min_by(F.col(value), rank if where is None else F.when(where, rank))


def lifetime_profiles(profiles: DataFrame, matches: DataFrame, snapshots: DataFrame, rankings: DataFrame) -> DataFrame:
    """One row per profile, also for players without matches.

    The opponents' statistics are a second aggregation of the same rows under the other id: each
    directional row carries both ids, so no self-join on the event is needed.
    """
    by = ("match_date", "match_id")
    ranked, points = F.col("player_ranking").isNotNull(), F.col("player_rank_points") > 0
    on = lambda s: F.col("surface") == s
    own = matches.groupBy("player_id").agg(
        F.countDistinct("match_id").alias("match_count"),
        F.max("match_date").alias("latest_match_date"),
        latest_by("player_rank_points", *by, where=points).alias("latest_rank_points"),
        earliest_by("player_rank_points", *by, where=points).alias("earliest_rank_points"),
        F.min(F.when(points, F.col("match_date"))).alias("earliest_rank_points_date"),
        F.max(F.when(points, F.col("match_date"))).alias("latest_rank_points_date"),
        latest_by("player_ranking", *by, where=ranked).alias("last_match_rank"),
        *[weighted_ratio(*r).alias(n) for n, r in OWN_RATIOS.items()],
        *[F.count_if(on(s)).alias(f"{s}_matches") for s in ("hard", "clay", "grass")],
        *[F.try_divide(F.sum(F.when(on(s), F.col("match_won"))).cast("double"), F.count_if(on(s))).alias(f"{s}_win_rate") for s in ("hard", "clay", "grass")],
        dominance_ratio(F.sum("return_points_won"), F.sum("return_points_available"), F.sum(F.expr("first_serve_points_won + second_serve_points_won")), F.sum("total_serve_points")).alias("dominance"),
        F.avg("match_won").alias("career_win_rate"),
    )
    faced = opponent_rows(matches).groupBy("player_id").agg(*[weighted_ratio(*r).alias(n) for n, r in RETURN_RATIOS.items()])
    latest = snapshots.groupBy("player_id").agg(F.max("snapshot_date").alias("recent_snapshot_date"), latest_by("win_rate_10", "snapshot_date", "match_id").alias("win_rate_10"))
    official = rankings.groupBy("player_id").agg(latest_by("rank", "ranking_date").alias("official_rank"))
    out = profiles.select("player_id")
    for part in (own, faced, latest, official):
        out = out.join(part, "player_id", "left")
    zero = ("match_count", "hard_matches", "clay_matches", "grass_matches")
    return (
        out.withColumn("rank_points_delta", F.col("latest_rank_points") - F.col("earliest_rank_points"))
        .withColumn("current_rank", F.coalesce("official_rank", "last_match_rank"))
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
        .drop("official_rank", "last_match_rank")
    )


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def pool_defaults(snapshots: DataFrame, matches: DataFrame, profiles: DataFrame, today: Column | None = None) -> DataFrame:
    """The one-row table of fallback values and benchmarks over the whole pool.

    Medians are rounded half to even, everything to 5 places; an empty pool gives the constants. The
    as-of date is the day after the last snapshot, or after ``today`` where there is none.
    """
    plain = [c for c in SNAPSHOT_VALUES if c not in POOL_MEDIANS]
    # per player first: what follows are sums of these rows
    people_ = snapshots.groupBy("player_id").agg(F.max("snapshot_date").alias("last_date"), F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in plain for f in (F.sum, F.count)])
    pool = people_.agg(
        F.date_add(F.coalesce(F.max("last_date"), today if today is not None else F.current_date()), 1).alias("pool_as_of_date"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("snapshot_pool_rows"),
        F.count("*").alias("snapshot_pool_players"),
        *[F.try_divide(F.sum(f"sum_{c}").cast("double"), F.sum(f"count_{c}")).alias(c) for c in plain],
    )
    shared_folder(snapshots.sparkSession)
    pool = pool.checkpoint()  # one row, used four times
    one = F.broadcast(pool.select("pool_as_of_date"))
    recent = matches.crossJoin(one).where("match_date >= date_sub(pool_as_of_date, 30) AND match_date < pool_as_of_date").groupBy("player_id").agg(F.count("*").alias("recent"))
    active = people_.select("player_id", "last_date").join(recent, "player_id", "left").crossJoin(one)
    cell = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("double").alias("value"))
    cells = snapshots.select(F.explode(F.array(*[cell(c, F.col(c)) for c in POOL_MEDIANS])).alias("x")).select("x.*")
    cells = cells.union(active.select(F.explode(F.array(cell("days_since_default", F.datediff("pool_as_of_date", "last_date")), cell("matches_30d_default", F.coalesce("recent", F.lit(0))))).alias("x")).select("x.*"))
    middles = exact_medians(cells, "name", "value")
    medians = middles.agg(*[half_even(F.max(F.when(F.col("name") == c, F.col("median")))).alias(c) for c in (*POOL_MEDIANS, "days_since_default", "matches_30d_default")])
    hand = F.when(F.col("handedness") == "L", 1.0).when(F.col("handedness") == "R", 0.0)
    people = profiles.crossJoin(one).agg(F.avg(hand).alias("left_handed_rate"), F.avg(F.year("pool_as_of_date") - F.col("turned_pro")).alias("avg_years_pro"), F.count("*").alias("profile_rows"))
    tour = matches.agg(F.count("*").alias("player_match_rows"), *[weighted_ratio(*r).alias(n) for n, r in TOUR_RATIOS.items()])
    fill = POOL_CONSTANTS | {"days_since_default": 365.0, "matches_30d_default": 0.0, "left_handed_rate": 0.0, "avg_years_pro": 8.0}
    row = pool.crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(people)).crossJoin(F.broadcast(tour))  # one row each
    return row.select(
        F.lit(1).alias("singleton_id"), "pool_as_of_date", "snapshot_pool_rows", "snapshot_pool_players", "profile_rows", "player_match_rows",
        *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(v)), 5).alias(c) for c, v in fill.items()],
        F.lit(0.5).alias("rate_default"),
        *[F.round(c, 5).alias(c) for c in TOUR_RATIOS],
    )


def head_to_head(prior: Column, me: Column, surface: Column) -> list[Column]:
    """Exposure and signed advantages from a list of prior meetings with winner_id and surface."""
    wins = F.size(F.filter(prior, lambda m: m["winner_id"] == me))
    here = F.filter(prior, lambda m: m["surface"] == surface)
    here_wins = F.size(F.filter(here, lambda m: m["winner_id"] == me))
    edge = lambda w, n: (w + F.lit(1.0)) / (n + F.lit(2.0)) - F.lit(0.5)
    return [F.size(prior).alias("h2h_exposure"), edge(wins, F.size(prior)).alias("h2h_advantage"), edge(here_wins, F.size(here)).alias("h2h_surface_advantage")]


def pair_summary(events: DataFrame, recent: int = 5) -> DataFrame:
    """Per unordered pair: meetings, wins of each side, the smaller id's win rate and recent rate.

    Rates are rounded to 4 places.
    """
    pair = events.select(F.least("player1_id", "player2_id").alias("player_a"), F.greatest("player1_id", "player2_id").alias("player_b"), "match_id", "match_date", "winner_id")
    newest = Window.partitionBy("player_a", "player_b").orderBy(F.desc("match_date"), F.desc("match_id"))
    won = (F.col("winner_id") == F.col("player_a")).cast("long")
    rows = pair.withColumn("__new", F.row_number().over(newest) <= recent).withColumn("__won", won)
    out = rows.groupBy("player_a", "player_b").agg(
        F.count("*").alias("meetings"), F.sum("__won").alias("wins_a"), F.sum((F.col("winner_id") == F.col("player_b")).cast("long")).alias("wins_b"), F.round(F.avg("__won"), 4).alias("win_rate_a"), F.round(F.avg(F.when(F.col("__new"), F.col("__won"))), 4).alias("recent_rate_a")
    )
    return out
