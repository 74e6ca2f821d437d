"""Queries over the event, snapshot, default, profile and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, events, features
from ..operators.profiles import pair_summary
from ..schemas import FEATURE_COLS, SIMILARITY_COLS
from .base import Tables, rounded
from .sql import DOUBLES, with_tables
from .sql import rounded as sql_rounded

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return register


@query(with_tables("SELECT * FROM pm", "pm"))
def directional_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B3, E1, E2, B11."""
    return Tables(spark, sf_dir).matches


# rates of up to some thousand points have fewer than 9 places where they end at all, so none is rounded at a tie
@query(with_tables(sql_rounded("SELECT * FROM rf", DOUBLES["rf"], 9), "rf"))
def rolling_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3-E10, C9."""
    return rounded(Tables(spark, sf_dir).snapshots, 9)


@query(
    with_tables(
        "SELECT m.match_id, m.player_id, round(coalesce(s.win_rate_10, 0.5::DOUBLE), 6) AS prior_win_rate FROM pm m LEFT JOIN LATERAL (SELECT win_rate_10 FROM rf WHERE rf.player_id = m.player_id AND rf.snapshot_date < m.match_date ORDER BY rf.snapshot_date DESC, rf.match_id DESC LIMIT 1) s ON true",
        "rf",
    )
)
def strict_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 where snapshots and events are the same rows: one window, no join."""
    rows = Tables(spark, sf_dir).snapshots
    prior = asof.prior_state(rows, ["player_id"], "snapshot_date", F.struct("snapshot_date", "match_id", "win_rate_10"), "prior")
    return prior.select("match_id", "player_id", F.round(F.coalesce("prior.win_rate_10", F.lit(0.5)), 6).alias("prior_win_rate"))


@query(
    with_tables(
        "SELECT m.match_id, m.player_id, r.rank AS as_of_rank FROM pm m LEFT JOIN LATERAL (SELECT rank FROM rankings r WHERE r.player_id = m.player_id AND r.ranking_date <= m.match_date ORDER BY ranking_date DESC LIMIT 1) r ON true WHERE m.player_ranking IS NULL",
        "pm",
        "rankings",
    )
)
def inclusive_as_of_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The official rank on or before the day, where the event has none."""
    t = Tables(spark, sf_dir)
    rows = t.matches.where("player_ranking IS NULL").select("match_id", "player_id", "match_date")
    return asof.as_of_join(rows, t.rankings, ["player_id"], "match_date", "ranking_date", ["rank"], inclusive=True).select("match_id", "player_id", F.col("rank").alias("as_of_rank"))


@query(with_tables("SELECT m.match_id, m.player_id, coalesce(h.n, 0)::INT AS meetings, coalesce(h.w, 0)::INT AS wins, coalesce(h.sn, 0)::INT AS surface_meetings, coalesce(h.sw, 0)::INT AS surface_wins FROM pm m LEFT JOIN h2h h USING (match_id, player_id)", "h2h"))
def prior_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last five strictly earlier meetings of the pair, counted from each side."""
    t = Tables(spark, sf_dir)
    prior = asof.last_n_prior(t.events, "player1_id", "player2_id", "match_date", "match_id", ["winner_id", "surface"]).select("match_id", "surface", "prior", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    won = lambda m: m["winner_id"] == F.col("player_id")
    here = F.filter("prior", lambda m: m["surface"] == F.col("surface"))
    return prior.select("match_id", "player_id", F.size("prior").alias("meetings"), F.size(F.filter("prior", won)).alias("wins"), F.size(here).alias("surface_meetings"), F.size(F.filter(here, won)).alias("surface_wins"))


@query(with_tables("SELECT * FROM ta", "ta"))
def tour_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row defaults table."""
    return Tables(spark, sf_dir).defaults


@query()
def lifetime_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D7, C8, F6."""
    return rounded(Tables(spark, sf_dir).lifetime)


_LP_DOUBLES = [
    "first_serve_in_pct", "aces_per_first_serve", "first_serve_points_won_pct", "second_serve_points_won_pct", "overall_serve_points_won_pct",
    "double_faults_per_serve_point", "aces_per_service_game", "break_points_saved_pct", "return_points_won_pct", "first_serve_return_points_won_pct",
    "second_serve_return_points_won_pct", "return_games_won_pct", "break_point_conversion_pct", "break_point_opportunities_per_return_game",
    "hard_win_rate", "clay_win_rate", "grass_win_rate", "dominance", "career_win_rate", "win_rate_10",
]
O["lifetime_profiles"] = with_tables(sql_rounded("SELECT * FROM lp", _LP_DOUBLES), "lp")


@query(with_tables(sql_rounded("SELECT * FROM mf", DOUBLES["mf"]), "mf"))
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 37 features, meta and similarity columns."""
    return rounded(Tables(spark, sf_dir).features)


@query(with_tables("SELECT match_id, player_id, 'rank_diff' AS \"column\" FROM pm WHERE CAST(match_id AS BIGINT) % 97 = 0 UNION ALL SELECT match_id, player_id, CASE WHEN player_id < opponent_id THEN 'player_weighted_form_10' ELSE 'opponent_weighted_form_10' END FROM pm WHERE CAST(match_id AS BIGINT) % 89 = 0 UNION ALL SELECT match_id, player_id, 'best_of' FROM pm WHERE CAST(match_id AS BIGINT) % 101 = 0", "pm"))
def swap_law_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: cells where a row isn't the mirror of its event's other row, with a signed, a paired and an invariant feature of one side falsified."""
    k, own = F.col("match_id").cast("long"), F.col("player_id") < F.col("opponent_id")
    false = {c: F.when(own & (k % n == 0), F.col(c) + 1).otherwise(F.col(c)) for c, n in {"rank_diff": 97, "player_weighted_form_10": 89, "best_of": 101}.items()}
    return features.swap_violations(Tables(spark, sf_dir).features.withColumns(false))


@query(with_tables(sql_rounded(f"SELECT match_id AS request_id, player_id, opponent_id, {', '.join(FEATURE_COLS)} FROM mf WHERE player_id < opponent_id", [c for c in DOUBLES["mf"] if c not in SIMILARITY_COLS]), "mf"))
def scoring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asked again as a request from the smaller id's side."""
    t = Tables(spark, sf_dir)
    asked = t.events.select(F.col("match_id").alias("request_id"), F.least("player1_id", "player2_id").alias("player_id"), F.greatest("player1_id", "player2_id").alias("opponent_id"), "match_date", "surface", "tournament", "round", "is_indoor", "best_of")
    return rounded(features.request_features(asked, t.events, t.kept_snapshots, t.defaults, t.profiles))


@query(
    with_tables(
        "SELECT player_a, player_b, meetings, wins_a::BIGINT AS wins_a, wins_b::BIGINT AS wins_b, round(wins_a / meetings, 4) AS win_rate_a, round(last_wins / last_n, 4) AS recent_rate_a FROM (SELECT least(player1_id, player2_id) AS player_a, greatest(player1_id, player2_id) AS player_b, count(*) AS meetings, count(*) FILTER (WHERE winner_id = least(player1_id, player2_id)) AS wins_a, count(*) FILTER (WHERE winner_id = greatest(player1_id, player2_id)) AS wins_b, count(*) FILTER (WHERE rn <= 5) AS last_n, count(*) FILTER (WHERE rn <= 5 AND winner_id = least(player1_id, player2_id)) AS last_wins FROM (SELECT *, row_number() OVER (PARTITION BY least(player1_id, player2_id), greatest(player1_id, player2_id) ORDER BY match_date DESC, match_id DESC) AS rn FROM match_events) GROUP BY 1, 2)",
        "match_events",
    )
)
def head_to_head_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16, N4."""
    return pair_summary(Tables(spark, sf_dir).events)


@query(
    with_tables(
        "SELECT match_id, player_id, coalesce(sum(match_won) OVER w, 0)::BIGINT AS wins_last, count(*) OVER w AS events_last FROM pm WINDOW w AS (PARTITION BY player_id ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)",
        "pm",
    )
)
def recent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own wins among the ten events before each."""
    return events.recent_form_before(Tables(spark, sf_dir).matches, "player_id", "match_date", "match_id", "match_won").select("match_id", "player_id", "wins_last", "events_last")


@query(
    with_tables(
        "SELECT match_id, sum(a) OVER w::BIGINT AS wins_a, sum(1 - a) OVER w::BIGINT AS wins_b FROM (SELECT *, (winner_id = least(player1_id, player2_id))::INT AS a, least(player1_id, player2_id) AS lo, greatest(player1_id, player2_id) AS hi FROM match_events) WINDOW w AS (PARTITION BY lo, hi ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)".replace("OVER w::BIGINT", "OVER w").replace("sum(a) OVER w", "(sum(a) OVER w)::BIGINT").replace("sum(1 - a) OVER w", "(sum(1 - a) OVER w)::BIGINT"),
        "match_events",
    )
)
def meeting_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of either side up to each meeting."""
    rows = Tables(spark, sf_dir).events.select("match_id", "match_date", F.least("player1_id", "player2_id").alias("lo"), F.greatest("player1_id", "player2_id").alias("hi"), (F.col("winner_id") == F.least("player1_id", "player2_id")).cast("long").alias("a"))
    return events.cumulative_wins(rows, ["lo", "hi"], ["match_date", "match_id"], "a").select("match_id", "wins_a", "wins_b")


@query(
    with_tables(
        "SELECT player_id, arg_min(rank, (rank, ranking_date)) AS best_rank, arg_min(ranking_date, (rank, ranking_date)) AS best_date, (year(max(ranking_date)) - year(min(ranking_date)))::INT AS year_ticks FROM rankings GROUP BY 1", "rankings"
    )
)
def career_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rank with its earliest date, and the January firsts inside the history."""
    r = Tables(spark, sf_dir).rankings.groupBy("player_id").agg(F.min(F.struct("rank", "ranking_date")).alias("best"), F.min("ranking_date").alias("first"), F.max("ranking_date").alias("last"))
    ticks = F.filter(F.transform(F.sequence(F.year("first"), F.year("last")), lambda y: F.make_date(y, F.lit(1), F.lit(1))), lambda d: (d >= F.col("first")) & (d <= F.col("last")))
    return r.select("player_id", F.col("best.rank").alias("best_rank"), F.col("best.ranking_date").alias("best_date"), F.size(ticks).alias("year_ticks"))


@query(
    with_tables(
        "SELECT band::INT AS band, min(d) AS first, max(d) AS last FROM (SELECT d, ntile(6) OVER (ORDER BY d) - 1 AS band FROM (SELECT DISTINCT match_date AS d FROM match_events)) GROUP BY 1", "match_events"
    )
)
def chronological_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15."""
    return events.date_bands(Tables(spark, sf_dir).events, "match_date", 6)


@query(
    with_tables(
        "SELECT player_id, match_id, match_date FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS rn FROM pm) WHERE rn <= 20", "pm"
    )
)
def match_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each player's newest 20 matches."""
    newest = Window.partitionBy("player_id").orderBy(F.desc("match_date"), F.desc("match_id"))
    return Tables(spark, sf_dir).matches.withColumn("rn", F.row_number().over(newest)).where("rn <= 20").select("player_id", "match_id", "match_date")
