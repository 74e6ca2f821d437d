"""Queries of requests, imports, seed selection, displays and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import identity, requests
from ..operators.profiles import TOUR_RATIOS
from ..plans import explore
from ..plans.similarity import table_hash
from .base import Tables, rounded
from .sql import rounded as sql_rounded
from .sql import with_tables

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return register


@query(with_tables("SELECT match_id, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'self play' END, CASE WHEN k % 13 = 0 THEN 'surface unknown' END, CASE WHEN k % 17 = 0 THEN 'round given twice' END, CASE WHEN k % 19 = 0 THEN 'best_of out of domain' END], lambda x: x IS NOT NULL), '; ') AS issues FROM (SELECT match_id, CAST(match_id AS BIGINT) AS k FROM match_events)", "match_events"))
def request_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with planted faults."""
    k = F.col("match_id").cast("long")
    e = Tables(spark, sf_dir).events
    asked = e.select(
        "match_id", F.lower("player1_id").alias("player_id"), F.when(k % 11 == 0, F.col("player1_id")).otherwise(F.col("player2_id")).alias("opponent_id"), F.lit(None).cast("date").alias("match_date"), F.when(k % 13 == 0, " Ice ").otherwise(F.upper("surface")).alias("surface"),
        "tournament", F.lit(None).cast("int").alias("tournament_level"), "round", F.when(k % 17 == 0, 3).alias("round_encoded"), "is_indoor", F.when(k % 19 == 0, 2).otherwise(F.col("best_of")).alias("best_of"),
    )
    return requests.normalised(asked, F.current_date()).select("match_id", F.array_join("issues", "; ").alias("issues"))


@query(with_tables("SELECT match_id, s::INT AS side, CASE s WHEN 0 THEN player1_id ELSE player2_id END AS player_id, CASE s WHEN 0 THEN player2_id ELSE player1_id END AS opponent_id, (1 - s)::INT AS match_won, CASE WHEN round = 'rr' THEN NULL ELSE round END AS round, CASE WHEN tournament = 'davis_cup' THEN NULL ELSE tournament END AS tournament FROM match_events, (SELECT unnest([0, 1]) AS s)", "match_events"))
def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orientations of every event, unsupported categories at their defaults."""
    return requests.both_orientations(requests.supported(Tables(spark, sf_dir).events)).select("match_id", "side", "player_id", "opponent_id", "match_won", "round", "tournament")


@query(with_tables("SELECT k AS position, CASE WHEN k % 31 = 0 THEN 'no response' ELSE 'other players' END AS issue FROM (SELECT CAST(match_id AS BIGINT) AS k FROM match_events) WHERE k % 31 = 0 OR k % 37 = 0", "match_events"))
def response_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22."""
    asked = Tables(spark, sf_dir).events.select(F.col("match_id").cast("long").alias("position"), F.col("player1_id").alias("player_id"), F.col("player2_id").alias("opponent_id"))
    got = asked.where("position % 31 <> 0").withColumn("player_id", F.when(F.col("position") % 37 == 0, "X").otherwise(F.col("player_id")))
    return requests.response_mismatches(asked, got)


@query(with_tables("SELECT player_id, arg_max(v, (match_date, match_id)) AS rank_points FROM (SELECT player_id, match_date, match_id, player_rank_points AS v FROM pm) WHERE v > 0 GROUP BY 1", "pm"))
def latest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21."""
    return identity.latest_positive(Tables(spark, sf_dir).events, "rank_points")


@query(with_tables("SELECT player_id, rank FROM rankings WHERE ranking_date = (SELECT max(ranking_date) FROM rankings)", "rankings"))
def latest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22."""
    return identity.latest_official(Tables(spark, sf_dir).rankings)


@query(with_tables("SELECT 'S' || c AS source_id, display_name AS name, count(*) AS n FROM rankings JOIN player_profiles USING (player_id) WHERE c % 4 = 3 GROUP BY ALL", "rankings", "player_profiles"))
def unmapped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids that nothing resolves, with names and rows."""
    t = Tables(spark, sf_dir)
    src = t.profiles.select("player_id", F.concat(F.lit("S"), "c").alias("source_id"), F.col("display_name").alias("name"), "c")
    rows = t.rankings.join(src, "player_id").select("source_id")
    resolved = src.where("c % 4 <> 3").select("source_id", "player_id")
    return identity.unmapped(rows, resolved, src.select("source_id", "name"))


@query(with_tables("SELECT count(*) AS sources, count(*) FILTER (WHERE c % 4 <> 3) AS covered, count(*) FILTER (WHERE c % 4 = 0) AS auto_mapped, count(*) FILTER (WHERE c % 4 = 3) AS unresolved FROM player_profiles", "player_profiles"))
def identity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20."""
    src = Tables(spark, sf_dir).profiles.select(F.concat(F.lit("S"), "c").alias("source_id"), "player_id", "c")
    return identity.coverage(src, src.where("c % 4 <> 3"), src.where("c % 4 = 0"))


@query(with_tables("SELECT ranking_date, player_id, CASE WHEN c % 4 <> 3 AND rank + 1 <= 200 THEN rank + 1 ELSE rank END::SMALLINT AS rank, points FROM rankings JOIN player_profiles USING (player_id)".replace("ELSE rank END::SMALLINT", "ELSE rank END").replace("CASE WHEN", "(CASE WHEN").replace("END AS rank", "END)::SMALLINT AS rank"), "rankings", "player_profiles"))
def ranking_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of twice-given rows over what was stored."""
    t = Tables(spark, sf_dir)
    src = t.profiles.select("player_id", F.concat(F.lit("S"), "c").alias("source_id"), "c")
    stored = t.rankings.select("ranking_date", "player_id", "rank", "points")
    given = stored.join(src, "player_id").withColumn("sequence", F.explode(F.array(F.lit(0), F.lit(1))))
    raw = given.select("ranking_date", F.col("source_id").alias("player_id"), (F.col("rank") + F.col("sequence")).cast("short").alias("rank"), "points", F.lit(None).cast("string").alias("reject_reason"), "sequence").where("rank <= 200 OR sequence = 1")
    # a row that moves past the limit is out, so its first version must not stand in for it
    raw = raw.join(given.where("sequence = 1 AND rank + 1 > 200").select("ranking_date", F.col("source_id").alias("player_id")).hint("merge"), ["ranking_date", "player_id"], "left_anti")
    auto = src.where("c % 4 IN (0, 1)").select("source_id", "player_id")
    reviewed = src.where("c % 4 = 2").select("source_id", "player_id")
    return identity.import_rankings(raw, t.profiles, auto, reviewed, stored)


@query(with_tables("SELECT DISTINCT match_id FROM (SELECT match_id, match_date, player_id, row_number() OVER (PARTITION BY player_id, year(match_date) = 2000 ORDER BY match_date DESC, match_id DESC) AS rn FROM pm WHERE player_id IN (SELECT player_id FROM rankings WHERE ranking_date = (SELECT max(ranking_date) FROM rankings) ORDER BY rank, player_id LIMIT 5)) WHERE year(match_date) = 2000 OR rn <= 10", "pm", "rankings"))
def seed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the best five players' year and their ten newest other events."""
    t = Tables(spark, sf_dir)
    return identity.seed_selection(t.events, identity.latest_official(t.rankings), 2000, 5, 10)


#: Scores that vary with the event: two to four sets, some lost by the winner, some broken off. Spark and DuckDB read the same text.
_SCORE = "concat_ws(' ', concat(6 + k % 2, '-', k % 5), CASE WHEN k % 3 = 0 THEN concat(k % 4, '-6') END, CASE WHEN k % 7 = 0 THEN 'RET' ELSE concat('7-', 5 + k % 2) END, CASE WHEN k % 5 = 0 THEN '6-6' END)"
_SETS = f"SELECT match_id, player1_ranking, k, string_split({_SCORE}, ' ') AS parts FROM (SELECT *, CAST(match_id AS BIGINT) AS k FROM match_events)"


@query(
    with_tables(
        "SELECT match_id, array_to_string(parts, ' ') AS score, len(parts)::INT AS n_sets, array_to_string(list_filter(parts, lambda s: CASE WHEN k % 2 = 0 THEN coalesce(TRY_CAST(split_part(s, '-', 1) AS INT) > TRY_CAST(split_part(s, '-', 2) AS INT), false) ELSE coalesce(TRY_CAST(split_part(s, '-', 1) AS INT) < TRY_CAST(split_part(s, '-', 2) AS INT), false) END), ' ') AS bold, CASE WHEN player1_ranking IS NOT NULL THEN player1_ranking::VARCHAR ELSE '200+' END AS rank_text FROM sets",
        "match_events",
        more={"sets": _SETS},
    )
)
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score segments, those that the viewing side won, and the rank as shown."""
    e = Tables(spark, sf_dir).events.withColumn("k", F.col("match_id").cast("long")).withColumn("score", F.expr(_SCORE))
    parts = fn.score_segments(F.col("score"), F.col("k") % 2 == 0)
    bold = F.array_join(F.transform(F.filter(parts, lambda p: p["bold"]), lambda p: p["text"]), " ")
    return e.select("match_id", F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("score"), F.size(parts).alias("n_sets"), bold.alias("bold"), fn.rank_label(F.col("player1_ranking"), F.lit(True)).alias("rank_text"))


@query(with_tables("SELECT surface, CASE WHEN surface IS NULL THEN NULL ELSE round END AS round, n, round(win_rate, 6) AS win_rate, level FROM (SELECT surface, round, count(*) AS n, avg((winner_id = least(player1_id, player2_id))::INT) AS win_rate, grouping(surface, round) AS level FROM match_events GROUP BY ROLLUP (surface, round))", "match_events"))
def win_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the smaller id wins, by surface and round, rolled up."""
    e = Tables(spark, sf_dir).events.withColumn("match_won", (F.col("winner_id") == F.least("player1_id", "player2_id")).cast("int"))
    return rounded(explore.win_rates(e.select("surface", "round", "match_won"), "surface", "round"))


@query(with_tables("SELECT floor((player_ranking - opponent_ranking) / 25)::BIGINT AS bin, count(*) AS n, round(avg(match_won), 6) AS win_rate FROM pm GROUP BY 1", "pm"))
def rank_gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rate by rank gap."""
    rows = Tables(spark, sf_dir).matches.withColumn("gap", F.col("player_ranking") - F.col("opponent_ranking"))
    return rounded(explore.gap_bins(rows, "gap", 25))


_CORR = ["aces", "double_faults", "service_games", "return_points_won"]


@query(with_tables(sql_rounded(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, match_won) AS correlation FROM pm" for c in _CORR), ["correlation"]), "pm"))
def label_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of statistics with the outcome."""
    return rounded(explore.label_correlations(Tables(spark, sf_dir).matches, _CORR, "match_won"))


_MISSING = ["player_ranking", "player_rank_points", "surface", "opponent_id"]


@query(with_tables(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS n_distinct FROM pm" for c in _MISSING), "pm"))
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and distinct values."""
    return explore.missing_profile(Tables(spark, sf_dir).matches, _MISSING)


@query(with_tables("SELECT 'events' AS name, count(*) AS n FROM match_events UNION ALL SELECT 'matches', count(*) FROM pm UNION ALL SELECT 'rankings', count(*) FROM rankings", "pm", "rankings"))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts after a build."""
    t = Tables(spark, sf_dir)
    out = None
    for name, df in (("events", t.events), ("matches", t.matches), ("rankings", t.rankings)):
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query(with_tables("SELECT match_date, count(*) AS n, NOT bool_or(CAST(match_id AS BIGINT) % 83 = 0) AS same FROM match_events GROUP BY 1", "match_events"))
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which days' events are as they were, by fingerprints that don't depend on the order of rows; some events have changed."""
    e = Tables(spark, sf_dir).events.select("match_id", "surface", "match_date")
    changed = e.repartition(3, "surface").withColumn("surface", F.when(F.col("match_id").cast("long") % 83 == 0, "x").otherwise(F.col("surface")))
    before, now = table_hash(e, "match_date"), table_hash(changed, "match_date").select("match_date", F.col("fingerprint").alias("now"))
    return before.join(now, "match_date").select("match_date", "n", (F.col("fingerprint") == F.col("now")).alias("same"))


@query(with_tables(sql_rounded(f"SELECT player_id, {', '.join(f'l.{a} - d.{b} AS {a}' for a, b in (('aces_per_first_serve', 'tour_ace_rate'), ('break_points_saved_pct', 'tour_break_points_saved_pct')))}, 1 - l.break_points_saved_pct AS broken FROM lp l, ta d", ["aces_per_first_serve", "break_points_saved_pct", "broken"]), "lp", "ta"))
def benchmark_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences from the tour and complements; null stays null."""
    t = Tables(spark, sf_dir)
    rows = t.lifetime.crossJoin(F.broadcast(t.defaults.select(*TOUR_RATIOS)))
    delta = lambda a, b: fn.benchmark_delta(F.col(a), F.col(b)).alias(a)
    return rounded(rows.select("player_id", delta("aces_per_first_serve", "tour_ace_rate"), delta("break_points_saved_pct", "tour_break_points_saved_pct"), (1 - F.col("break_points_saved_pct")).alias("broken")))


