"""Column contracts of the tables, in the order that readers and writers keep."""

from __future__ import annotations

from pyspark.sql import types as T

#: The per-side statistics of an event, as they follow player1_ / player2_.
COUNT_STATS = (
    "aces", "double_faults", "first_serves_made", "total_serve_points", "first_serve_points_won",
    "second_serve_points_won", "service_games", "break_points_saved", "break_points_faced",
)
SIDE_STATS = (*COUNT_STATS, "ranking", "rank_points", "age")

SURFACES = ("clay", "grass", "hard", "carpet")
FORM_SURFACES = ("clay", "grass", "hard")
ROUNDS = ("r128", "r64", "r32", "r16", "qf", "sf", "f")
#: Encodings of context; anything else is 0.
TOURNAMENT_LEVEL = {"grand_slam": 4, "masters": 3, "atp_500": 2, "atp_250": 1}
ROUND_LEVEL = {r: i + 1 for i, r in enumerate(ROUNDS)}

MATCH_EVENTS = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("match_id", "player1_id", "player2_id", "winner_id", "tournament")]
    + [T.StructField("match_date", T.DateType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("tournament_name", "round", "score", "surface")]
    + [T.StructField(c, T.ShortType()) for c in ("best_of", "is_indoor")]
    + [T.StructField(f"player{i}_{s}", T.DoubleType() if s == "age" else T.IntegerType()) for i in (1, 2) for s in SIDE_STATS]
    + [T.StructField("ingested_at", T.TimestampType())]
)

#: Snapshot values that a missing prior state is filled from the defaults.
SNAPSHOT_VALUES = (
    "latest_player_ranking", "latest_player_rank_points", "latest_player_age", "weighted_form_10", "win_rate_10",
    "ace_rate_10", "first_serve_pct_10", "break_points_saved_pct_10", "first_serve_win_pct_10",
    "second_serve_win_pct_10", "serve_win_pct_10", "return_points_won_pct_10", "dominance", "df_rate_10",
    "aces_per_svc_game_10", "avg_player_rank_10", "avg_rank_faced_10", "streak", "clay_win_rate_10",
    "grass_win_rate_10", "hard_win_rate_10",
)

#: The model's 37 features in their order.
DIFF_COLS = (
    "rank_diff", "rank_points_diff", "age_diff", "win_rate_diff", "ace_rate_diff", "first_serve_pct_diff",
    "break_points_saved_pct_diff", "first_serve_win_pct_diff", "second_serve_win_pct_diff", "serve_win_pct_diff",
    "return_points_won_pct_diff", "dominance_diff", "df_rate_diff", "aces_per_svc_game_diff", "rank_trend_diff",
    "avg_rank_faced_diff", "streak_diff", "surface_form_diff", "days_since_last_match_diff",
)
#: What each difference is taken of; the last is the log of the rest.
DIFF_SOURCES = (
    "ranking", "rank_points", "age", "win_rate_10", "ace_rate_10", "first_serve_pct_10", "break_points_saved_pct_10",
    "first_serve_win_pct_10", "second_serve_win_pct_10", "serve_win_pct_10", "return_points_won_pct_10", "dominance",
    "df_rate_10", "aces_per_svc_game_10", "rank_trend_10", "avg_rank_faced_10", "streak", "surface_form", "log_rest",
)
#: Per-side, head-to-head and context features, and what is kept beside the features.
SIDE_COLS = ("weighted_form_10", "matches_10", "is_left_handed", "years_pro")
H2H_COLS = ("h2h_exposure", "h2h_advantage", "h2h_surface_advantage")
CONTEXT_COLS = ("is_clay", "is_grass", "is_hard", "is_indoor", "best_of", "tournament_level", "round_encoded")
PAIRED_COLS = tuple(f"{side}_{c}" for c in SIDE_COLS for side in ("player", "opponent"))
FEATURE_COLS = (*DIFF_COLS, *PAIRED_COLS, *H2H_COLS, *CONTEXT_COLS)
SIMILARITY_SIDE = ("first_serve_pct_10", "first_serve_win_pct_10", "second_serve_win_pct_10", "serve_win_pct_10", "return_points_won_pct_10")
SIMILARITY_COLS = tuple(f"{side}_{c}" for c in SIMILARITY_SIDE for side in ("player", "opponent"))
META_COLS = ("match_id", "match_date", "player_id", "opponent_id", "tournament", "round", "surface", "match_won")

#: What an empty pool falls back to.
POOL_CONSTANTS = {
    "latest_player_ranking": 100.0, "latest_player_rank_points": 500.0, "streak": 0.0, "avg_player_rank_10": 100.0,
    "avg_rank_faced_10": 100.0, "latest_player_age": 26.0, "weighted_form_10": 0.0, "win_rate_10": 0.0,
    "ace_rate_10": 0.0, "first_serve_pct_10": 0.0, "break_points_saved_pct_10": 0.0, "first_serve_win_pct_10": 0.0,
    "second_serve_win_pct_10": 0.0, "serve_win_pct_10": 0.0, "return_points_won_pct_10": 0.0, "dominance": 0.0,
    "df_rate_10": 0.0, "aces_per_svc_game_10": 0.0, "clay_win_rate_10": 0.0, "grass_win_rate_10": 0.0,
    "hard_win_rate_10": 0.0,
}
#: What is a median in a pool that isn't empty.
POOL_MEDIANS = ("latest_player_ranking", "latest_player_rank_points", "streak", "avg_player_rank_10", "avg_rank_faced_10")
