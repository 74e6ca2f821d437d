"""Read models: what a user asks of the tables, for any number of players at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import benchmark_delta, rank_label
from ..operators.asof import as_of_join

#: A lifetime value and the benchmark it is compared with.
COMPARISONS = {
    "first_serve_in_pct": "tour_first_serve_pct", "aces_per_first_serve": "tour_ace_rate", "first_serve_points_won_pct": "tour_first_serve_win_pct",
    "second_serve_points_won_pct": "tour_second_serve_win_pct", "overall_serve_points_won_pct": "tour_serve_win_pct", "double_faults_per_serve_point": "tour_df_rate",
    "aces_per_service_game": "tour_aces_per_svc_game", "break_points_saved_pct": "tour_break_points_saved_pct", "return_points_won_pct": "tour_return_points_won_pct",
    "return_games_won_pct": "tour_return_games_won_pct", "break_point_opportunities_per_return_game": "tour_break_point_opportunities_per_return_game",
}
#: The same against the complement of a benchmark of the other side's serve.
COMPLEMENTS = {"first_serve_return_points_won_pct": "tour_first_serve_win_pct", "second_serve_return_points_won_pct": "tour_second_serve_win_pct", "break_point_conversion_pct": "tour_break_points_saved_pct"}


def player_profiles(profiles: DataFrame, lifetime: DataFrame, defaults: DataFrame) -> DataFrame:
    """Metadata, lifetime aggregates, differences from the tour, surface rates and recent form."""
    one = F.broadcast(defaults.select(*sorted({*COMPARISONS.values(), *COMPLEMENTS.values()})))
    rows = profiles.join(lifetime, "player_id", "left").crossJoin(one)
    deltas = [benchmark_delta(F.col(c), F.col(b)).alias(c) for c, b in COMPARISONS.items()] + [benchmark_delta(F.col(c), 1 - F.col(b)).alias(c) for c, b in COMPLEMENTS.items()]
    return rows.select(
        "player_id", "display_name", "handedness", "backhand", "height", "turned_pro", "match_count", "current_rank",
        F.struct(*COMPARISONS, *COMPLEMENTS, "dominance", "career_win_rate").alias("lifetime"),
        F.struct(*deltas).alias("against_tour"),
        F.struct("hard_win_rate", "clay_win_rate", "grass_win_rate", "hard_matches", "clay_matches", "grass_matches").alias("surfaces"),
        F.struct("win_rate_10", "recent_snapshot_date").alias("recent"),
        F.struct("latest_rank_points", "earliest_rank_points", "rank_points_delta").alias("points"),
    )


def match_history(matches: DataFrame, events: DataFrame, profiles: DataFrame, rankings: DataFrame, limit: int = 20) -> DataFrame:
    """Each player's newest matches with the opponent's name and rank as it is shown.

    The rank is the event's own, else the official one on or before its day; a player with official
    ranks but none by then shows as beyond the list.
    """
    newest = Window.partitionBy("player_id").orderBy(F.desc("match_date"), F.desc("match_id"))
    page = matches.select("player_id", "opponent_id", "match_id", "match_date", "surface", "match_won", "opponent_ranking").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= max(1, min(limit, 100)))
    page = as_of_join(page, rankings.withColumnRenamed("player_id", "opponent_id"), ["opponent_id"], "match_date", "ranking_date", ["rank"], inclusive=True)
    known = rankings.select(F.col("player_id").alias("opponent_id"), F.lit(True).alias("known")).distinct()
    names = profiles.select(F.col("player_id").alias("opponent_id"), F.col("display_name").alias("opponent_name"))
    rows = page.join(events.select("match_id", "tournament", "round"), "match_id", "left").join(names, "opponent_id", "left").join(known, "opponent_id", "left")
    shown = rank_label(F.coalesce("opponent_ranking", "rank"), F.coalesce("known", F.lit(False)))
    return rows.select("player_id", "rn", "match_id", "match_date", "tournament", "round", "surface", "match_won", "opponent_id", "opponent_name", shown.alias("opponent_rank"))


def pair_page(events: DataFrame, a: str, b: str, limit: int = 20) -> DataFrame:
    """The newest meetings of two players."""
    both = (F.least("player1_id", "player2_id") == F.least(F.lit(a), F.lit(b))) & (F.greatest("player1_id", "player2_id") == F.greatest(F.lit(a), F.lit(b)))
    return events.where(both).orderBy(F.desc("match_date"), F.desc("match_id")).limit(max(1, min(limit, 100))).select("match_id", "match_date", "tournament", "round", "surface", "winner_id")


def directory(profiles: DataFrame, lifetime: DataFrame, countries: DataFrame) -> DataFrame:
    """All players in rank order with their country; unknown countries resolve to UNK."""
    rows = profiles.join(lifetime.select("player_id", "match_count", "current_rank"), "player_id", "left").join(F.broadcast(countries), "country_key", "left")
    return rows.select("player_id", "display_name", F.coalesce("match_count", F.lit(0)).alias("matches_played"), "current_rank", F.coalesce("country", F.lit("UNK")).alias("country")).orderBy(F.asc_nulls_last("current_rank"), "display_name", "player_id")


def directory_totals(profiles: DataFrame, events: DataFrame) -> DataFrame:
    return profiles.agg(F.count("*").alias("players")).crossJoin(events.agg(F.count("*").alias("matches"), F.max("match_date").alias("latest_match_date")))
