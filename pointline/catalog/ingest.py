"""Queries of readers, writers, parsers, scalar functions, incremental rebuilds, streams and fits.

Files, pages and payloads are made by Spark from the given tables, written in the shared folder
where a reader needs files, and read back by the operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import events as ops
from ..operators import identity, incremental
from ..operators.ordered import shared_folder
from ..plans import models
from ..schemas import COUNT_STATS, FEATURE_COLS
from ..sources import files, pages
from ..streaming import ingest as streaming
from .base import Tables
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


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in events with ids of the raw files' form and the columns those have."""
    year = F.year("match_date").cast("string")
    e = Tables(spark, sf_dir).events
    return e.withColumn("match_id", F.concat_ws("-", year, F.substring("match_id", 5, 6), F.lit("007"))).withColumn("tournament_name", F.initcap("tournament")).withColumn("score", F.when(F.col("best_of") == 5, "6-4 6-4 6-4").otherwise("6-4 6-4"))


_COLS = ["match_id", "match_date", "tournament", "round", "surface", "is_indoor", "score", "winner_id", "player1_id", "player2_id", *[f"player{i}_{s}" for i in (1, 2) for s in (*COUNT_STATS, "ranking", "rank_points", "age")]]
_KEYED = "SELECT * REPLACE (year(match_date) || '-' || substr(match_id, 5, 6) || '-007' AS match_id), CASE WHEN best_of = 5 THEN '6-4 6-4 6-4' ELSE '6-4 6-4' END AS score FROM match_events"


@query(with_tables(f"SELECT {', '.join(_COLS)}, coalesce(best_of, CASE WHEN round = 'rr' THEN 1 WHEN tournament = 'grand_slam' THEN 5 ELSE 3 END)::SMALLINT AS best_of FROM ({_KEYED})", "match_events"))
def raw_match_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as raw files and read back."""
    path = shared_path(spark, "raw-matches")
    files.to_raw_rows(keyed_events(spark, sf_dir)).write.option("header", True).csv(path)
    return files.to_match_events(files.read_matches(spark, path)).select(*_COLS, "best_of")


def _cell(x: str) -> str:
    return f"CASE WHEN {x} <> 0 THEN CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE printf('%.3f', ({x})::DOUBLE) END END"


#: What pages would say of an event beside the stand-in's columns. Spark and DuckDB read the same text.
_PAGE = (
    "*", "CAST(substr(match_id, 6, 6) AS BIGINT) AS n", "CASE WHEN n % 5 = 0 THEN '3' END AS winner_seed", "CASE WHEN n % 7 = 0 THEN 'WC' END AS winner_entry",
    "CASE WHEN n % 3 = 0 THEN '12' END AS loser_seed", "CASE WHEN n % 11 = 0 THEN 'Q' ELSE '' END AS loser_entry",
    "CAST(CASE WHEN n % 6 = 0 THEN 0 ELSE 32 END AS INT) AS draw_size", "CAST(CASE WHEN n % 10 = 0 THEN NULL ELSE 60 + n % 241 / CAST(2 AS DOUBLE) END AS DOUBLE) AS minutes",
    "concat('page ', player1_id) AS player1_name", "concat('page ', player2_id) AS player2_name",
)
_KNOWN = "SELECT player_id, display_name, handedness, height, CASE WHEN c % 5 = 0 THEN 'UNK' ELSE concat('N', nation) END AS ioc FROM player_profiles WHERE c % 4 <> 0"


def _raw_side(i: int, side: str, s: str) -> str:
    stats = ", ".join(f"player{i}_{x}::VARCHAR AS \"{s}_{c}\"" for c, x in files.RAW_STATS.items())
    return f"player{i}_id AS {side}_id, {side}_seed, nullif({side}_entry, '') AS {side}_entry, coalesce({s}.display_name, player{i}_name) AS {side}_name, {s}.handedness AS {side}_hand, {s}.height::VARCHAR AS {side}_ht, nullif({s}.ioc, 'UNK') AS {side}_ioc, {', '.join(f'{_cell(f'player{i}_{c}')} AS {side}_{n}' for c, n in (('age', 'age'), ('ranking', 'rank'), ('rank_points', 'rank_points')))}, {stats}"


@query(
    with_tables(
        f"SELECT substr(match_id, 1, 11) AS tourney_id, upper(left(tournament, 1)) || substr(tournament, 2) AS tourney_name, upper(left(surface, 1)) || substr(surface, 2) AS surface, {_cell('draw_size')} AS draw_size, CASE tournament {' '.join(f"WHEN '{n}' THEN '{c}'" for c, n in files.LEVELS.items())} END AS tourney_level, CASE is_indoor WHEN 1 THEN 'I' WHEN 0 THEN 'O' END AS indoor, strftime(match_date, '%Y%m%d') AS tourney_date, '7' AS match_num, score, best_of::VARCHAR AS best_of, upper(round) AS round, {_cell('minutes')} AS minutes, {_raw_side(1, 'winner', 'w')}, {_raw_side(2, 'loser', 'l')} FROM (SELECT {', '.join(_PAGE)} FROM ({_KEYED})) e LEFT JOIN known w ON w.player_id = player1_id LEFT JOIN known l ON l.player_id = player2_id",
        "match_events", "player_profiles",
        more={"known": _KNOWN},
    )
)
def raw_mirror_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the raw files as text, read back, with profiles of three players of four and what pages say."""
    path = shared_path(spark, "raw-mirror")
    known = Tables(spark, sf_dir).profiles.where("c % 4 <> 0").selectExpr("player_id", "display_name", "handedness", "height", "CASE WHEN c % 5 = 0 THEN 'UNK' ELSE concat('N', nation) END AS ioc")
    files.to_raw_rows(keyed_events(spark, sf_dir).selectExpr(*_PAGE), known).write.option("header", True).csv(path)
    return files.read_strings(spark, path, files.RAW_COLUMNS)


@query(with_tables("SELECT strptime(CASE WHEN week % 50 = 0 THEN NULL ELSE strftime(ranking_date, '%Y%m%d') END, '%Y%m%d')::DATE AS ranking_date, rank, player_id, points, CASE WHEN week % 50 = 0 THEN 'ranking_date' END AS reject_reason FROM (SELECT *, ((ranking_date - DATE '1995-01-02') / 7)::INT AS week FROM rankings) WHERE rank <= 150", "rankings"))
def ranking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: strict ranking rows with reasons; every fiftieth week has a malformed date."""
    path = shared_path(spark, "rankings")
    week = (F.datediff("ranking_date", F.lit("1995-01-02").cast("date")) / 7).cast("int")
    r = Tables(spark, sf_dir).rankings.select(F.when(week % 50 == 0, "2024-02-30").otherwise(F.date_format("ranking_date", "yyyyMMdd")).alias("ranking_date"), "rank", F.col("player_id").alias("player"), "points")
    r.write.option("header", True).csv(path)
    return files.read_rankings(spark, path, 150)


@query(with_tables("SELECT player_id, display_name, make_date(1960 + c % 40, 1 + c % 12, 1 + c % 28) AS birthdate, height::SMALLINT AS height, turned_pro, handedness, backhand FROM player_profiles", "player_profiles"))
def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed profiles, the last row of each id."""
    path = shared_path(spark, "profiles")
    p = Tables(spark, sf_dir).profiles
    text = lambda c: F.col(c).cast("string")
    born = F.date_format(F.make_date(1960 + F.col("c") % 40, 1 + F.col("c") % 12, 1 + F.col("c") % 28), "yyyyMMdd")
    row = p.select(F.lower("player_id").alias("id"), F.col("display_name").alias("player"), F.lit("x").alias("atpname"), born.alias("birthdate"), F.lit("0").alias("weight"), text("height").alias("height"), F.coalesce(text("turned_pro"), F.lit("0")).alias("turnedpro"), F.lit("").alias("birthplace"), F.lit("").alias("coaches"), F.col("handedness").alias("hand"), "backhand", F.lit("esp").alias("ioc"))
    # what stands in the later file counts
    row.withColumn("height", F.lit("1")).write.option("header", True).csv(f"{path}/1")
    row.write.option("header", True).csv(f"{path}/2")
    return files.read_profiles(spark, f"{path}/*").select("player_id", "display_name", "birthdate", "height", "turned_pro", "handedness", "backhand")


@query(with_tables("SELECT 'S' || c AS source_id, CASE c % 4 WHEN 0 THEN display_name ELSE trim(concat(CASE WHEN c % 3 <> 0 THEN substr(display_name, 1, 8) ELSE '' END, ' ', substr(display_name, 10))) END AS name, CASE WHEN c % 5 = 0 THEN 'UNK' ELSE 'FRA' END AS country FROM player_profiles WHERE c % 11 <> 0", "player_profiles"))
def source_player_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and countries of a source's player files, with blank ids and cells, further columns, and a later file that corrects a quarter of the rows."""
    path, k = shared_path(spark, "source-players"), F.col("c")
    p = Tables(spark, sf_dir).profiles
    source = F.when(k % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" S"), k))
    country = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(" fra "))
    first = p.select(source.alias("player_id"), F.when(k % 3 != 0, F.substring("display_name", 1, 8)).alias("name_first"), F.concat(F.substring("display_name", 10, 50), F.lit(" ")).alias("name_last"), F.lit("R").alias("hand"), country.alias("ioc"))
    later = p.where(k % 4 == 0).select(source.alias("player_id"), F.lit(None).cast("string").alias("name_first"), F.col("display_name").alias("name_last"), F.lit("L").alias("hand"), country.alias("ioc"))
    for n, rows in enumerate((first, later)):
        rows.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/{n}")
    return files.read_source_names(spark, f"{path}/*")


@query(with_tables("SELECT match_id, nullif(player1_ranking, 7) AS player1_ranking, player2_ranking, CASE WHEN k % 43 = 0 THEN NULL WHEN k % 37 = 0 OR k % 41 = 0 THEN 'hard' ELSE surface END AS surface FROM (SELECT *, CAST(match_id AS BIGINT) AS k FROM match_events)", "match_events"))
def backfilled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of 0 become missing and unknown surfaces hard, twice over, in events that hold both."""
    k = F.col("match_id").cast("long")
    e = Tables(spark, sf_dir).events.withColumn("player1_ranking", F.when(F.col("player1_ranking") == 7, 0).otherwise(F.col("player1_ranking")))
    e = e.withColumn("surface", F.when(k % 43 == 0, F.lit(None)).when(k % 37 == 0, "0").when(k % 41 == 0, "nan").otherwise(F.col("surface")))
    return incremental.backfilled(incremental.backfilled(e)).select("match_id", "player1_ranking", "player2_ranking", "surface")


@query(with_tables("SELECT 'silver' AS pipeline, max(match_date)::TIMESTAMP AS watermark, count(*) AS built FROM match_events WHERE batch < 9 UNION ALL SELECT 'silver', max(match_date)::TIMESTAMP, count(*) FROM match_events", "match_events"))
def advanced_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watermark advances after each build that ends, with what it saw, and not after one that fails."""
    state, built = shared_path(spark, "watermarks"), shared_path(spark, "built")
    e = Tables(spark, sf_dir).events.withColumn("ingested_at", F.col("match_date").cast("timestamp"))

    def build(rows: DataFrame, n: int, fails: bool = False) -> None:
        rows.agg(F.max("ingested_at").alias("watermark"), F.count("*").alias("built")).write.parquet(f"{built}/run={n}")
        if fails:
            raise RuntimeError("a build that fails")

    for n, (rows, fails) in enumerate([(e.where("batch < 9"), False), (e.limit(0), True), (e, False)]):
        try:
            incremental.advance_watermark(rows, state, "silver", lambda rows=rows, n=n, fails=fails: build(rows, n, fails))
        except RuntimeError:
            pass  # as it must: nothing is appended
    kept = spark.read.parquet(state).groupBy("pipeline", "watermark").agg(F.count("*").alias("times"))
    runs = spark.read.parquet(built).where("run <> 1").select("watermark", "built")
    return runs.join(kept, "watermark").select("pipeline", F.col("watermark").cast("timestamp_ntz").alias("watermark"), "built")


@query(with_tables("SELECT source_id, issue FROM (SELECT 'S' || c AS source_id, CASE WHEN c % 9 = 0 THEN 'blank cell' END AS issue FROM player_profiles UNION ALL SELECT 'S' || c, 'unknown target' FROM player_profiles WHERE c % 9 = 0 OR c % 10 = 1 UNION ALL SELECT 'S1', 'repeated source' UNION ALL SELECT 'S1', 'unknown target') WHERE issue IS NOT NULL", "player_profiles"))
def identity_map_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: faults planted in a reviewed map."""
    t = Tables(spark, sf_dir).profiles
    rows = t.select(F.concat(F.lit("S"), "c").alias("source_id"), F.when(F.col("c") % 9 == 0, " ").when(F.col("c") % 10 == 1, "nobody").otherwise(F.col("player_id")).alias("player_id"))
    return files.map_issues(rows.union(rows.where("source_id = 'S1'")), t)


@query(with_tables("SELECT match_id, CASE WHEN k % 10 = 0 THEN 'inserted' WHEN k % 10 = 1 THEN 'skipped' WHEN k % 10 = 2 THEN 'updated' ELSE 'noop' END AS action, CASE WHEN k % 10 = 1 THEN 'held back' END AS reason FROM (SELECT match_id, CAST(match_id AS BIGINT) AS k FROM match_events)", "match_events"))
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert does with each key."""
    e = Tables(spark, sf_dir).events.select("match_id", "surface", F.col("match_id").cast("long").alias("k"))
    new = e.withColumn("surface", F.when(F.col("k") % 10 == 2, "moved").otherwise(F.col("surface")))
    return incremental.upsert_actions(e.where("k % 10 <> 0"), new, ["match_id"], ["surface"], skip=F.when(F.col("k") % 10 == 1, "held back"))


@query(with_tables("SELECT CASE WHEN k % 10 = 0 THEN 'inserted' WHEN k % 10 = 1 THEN 'skipped' WHEN k % 10 = 2 THEN 'updated' ELSE 'noop' END AS action, count(*) AS n, count(*) FILTER (WHERE k % 10 = 1) AS with_reason FROM (SELECT CAST(match_id AS BIGINT) AS k FROM match_events) GROUP BY 1", "match_events"))
def upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return incremental.action_summary(upsert_actions(spark, sf_dir))


@query(with_tables("SELECT match_id, CASE WHEN batch >= 5 THEN 'new' ELSE surface END AS surface FROM match_events", "match_events"))
def keyed_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrite by key."""
    e = Tables(spark, sf_dir).events.select("match_id", "surface", "batch")
    new = e.where("batch >= 5").withColumn("surface", F.lit("new"))
    return incremental.overwrite(e.where("batch < 7"), new, ["match_id"]).select("match_id", "surface")


@query(with_tables("SELECT match_id, surface FROM match_events", "match_events"))
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, A14, C11."""
    e = Tables(spark, sf_dir).events.select("match_id", "surface", "batch")
    new = e.where("batch >= 5").withColumn("surface", F.when(F.col("batch") < 7, "old").otherwise(F.col("surface")))
    return incremental.insert_absent(e.where("batch < 7"), new, ["match_id"]).select("match_id", "surface")


@query(with_tables("SELECT * FROM pm", "pm"))
def incremental_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table built without two arrival batches and with false rows,
    rebuilt for the affected players only, equals the full build."""
    e = Tables(spark, sf_dir).events
    first = e.where("batch < 9").withColumn("player1_aces", F.when(F.col("batch") == 3, 0).otherwise(F.col("player1_aces")))
    built = ops.player_matches(first)
    arrived = e.where("batch IN (3, 9)")
    players = arrived.select(F.explode(F.array("player1_id", "player2_id")).alias("player_id")).distinct()
    return incremental.rebuild(e, built, players, ops.player_matches)


@query(with_tables("SELECT DISTINCT player_id FROM (SELECT player1_id AS player_id FROM match_events WHERE match_date > DATE '2001-07-20' UNION ALL SELECT player2_id FROM match_events WHERE match_date > DATE '2001-07-20')", "match_events"))
def changed_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players whose window values a built table lacks or has otherwise."""
    e = Tables(spark, sf_dir).events
    built = ops.player_matches(e.where("match_date <= '2001-07-20'"))
    return incremental.changed_by_windows(ops.player_matches(e), built, ["player_id", "match_id"], ["player_match_number", "matches_30d_before"], "player_id")


@query(with_tables("SELECT DISTINCT match_id FROM match_events WHERE substr(player1_id, 2)::BIGINT % 20 = 1 OR substr(player2_id, 2)::BIGINT % 20 = 1", "match_events"))
def affected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4, Q8: every event with a changed player on either side, where every twentieth player is changed."""
    t = Tables(spark, sf_dir)
    return incremental.affected_events(t.events, t.profiles.where("c % 20 = 1").select("player_id"))


@query(with_tables("SELECT max(match_date)::TIMESTAMP AS source, TIMESTAMP '2001-01-01' AS built, max(match_date) > DATE '2001-01-01' AS stale FROM match_events", "match_events"))
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, I2, B16."""
    e = Tables(spark, sf_dir).events.withColumn("ingested_at", F.col("match_date").cast("timestamp_ntz"))
    state = spark.createDataFrame([("etl", "2001-01-01"), ("other", "2009-01-01")], "pipeline string, watermark string").withColumn("watermark", F.col("watermark").cast("timestamp_ntz"))
    return incremental.watermarks(e, state, "etl")


@query(with_tables("SELECT player_id, d::DATE AS ranking_date FROM player_profiles, (SELECT unnest(generate_series(DATE '1994-12-05', DATE '2001-12-31', INTERVAL 7 DAY)) AS d) WHERE NOT EXISTS (SELECT 1 FROM rankings r WHERE r.player_id = player_profiles.player_id AND r.ranking_date = d)", "rankings"))
def missing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's Mondays without a ranking."""
    t = Tables(spark, sf_dir)
    return incremental.missing_mondays(t.rankings, "ranking_date", F.lit("1994-12-01").cast("date"), F.lit("2001-12-31").cast("date"), t.profiles.select("player_id"))


@query(with_tables("SELECT player_id, CASE WHEN c % 3 = 0 THEN 'ESP' WHEN c % 2 = 0 THEN 'FRA' ELSE 'UNK' END AS ioc FROM player_profiles", "player_profiles"))
def country_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill unknown codes, keep known ones."""
    p = Tables(spark, sf_dir).profiles
    stored = p.select("player_id", F.when(F.col("c") % 3 == 0, "ESP").when(F.col("c") % 3 == 1, "UNK").otherwise(" ").alias("ioc"))
    return incremental.enrich(stored, p.where("c % 2 = 0").select("player_id", F.lit("FRA").alias("ioc")), "player_id", "ioc")


@query(with_tables("SELECT match_id, CASE WHEN k % 3 = 0 THEN match_id WHEN k % 50 = 1 THEN NULL ELSE 'N' || match_id END AS assigned, CASE WHEN k % 3 <> 0 AND k % 50 = 1 THEN 'id shared in this run' END AS reason FROM (SELECT match_id, CAST(match_id AS BIGINT) AS k FROM match_events)", "match_events"))
def assigned_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ids are reused, shared ones are refused."""
    e = Tables(spark, sf_dir).events.withColumn("k", F.col("match_id").cast("long")).withColumn("tournament", F.concat("tournament", F.lit("#"), "match_id"))
    derived = F.when(F.col("k") % 50 == 1, "shared").otherwise(F.concat(F.lit("N"), "match_id"))
    candidates = e.select(F.col("match_id").alias("original"), "match_date", "tournament", "player1_id", "player2_id", derived.alias("derived_id"))
    out = identity.assign_event_ids(candidates, e.where("k % 3 = 0"))
    return out.select(F.col("original").alias("match_id"), F.col("match_id").alias("assigned"), "reason")


@query(with_tables("SELECT 'S' || c AS source_id, CASE WHEN c % 4 = 0 THEN 'P000000000' WHEN c % 4 = 1 THEN 'P000000005' ELSE NULL END AS player_id FROM player_profiles", "player_profiles"))
def identity_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic map goes before the reviewed one."""
    p = Tables(spark, sf_dir).profiles
    src = p.select(F.concat(F.lit("S"), "c").alias("source_id"), "c")
    auto = src.where("c % 4 = 0").select("source_id", F.lit("P000000000").alias("player_id"))
    reviewed = src.where("c % 4 IN (0, 1)").select("source_id", F.lit("P000000005").alias("player_id"))
    return identity.resolve_by_precedence(src.select("source_id"), p, auto, reviewed)


@query(with_tables("SELECT match_id, (2 + k % 50)::INT AS sequence, ((k % 5) * 60 + (k % 60))::INT AS minutes, (year(match_date) - (1960 + k % 30))::INT - 1 + (month(match_date) > 6 OR month(match_date) = 6 AND day(match_date) >= 15)::INT AS age, CASE WHEN k % 7 = 0 THEN NULL ELSE '6-4 7-6' END AS score, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END::INT AS sets, '2026-' || (k % 900)::VARCHAR || '-' || lpad((2 + k % 50)::VARCHAR, 3, '0') AS id, ('0x' || substr(md5(match_id), 17, 8))::BIGINT % 256 AS bucket, (match_date - (isodow(match_date) - 1)::INT)::DATE AS monday FROM (SELECT match_id, match_date, CAST(match_id AS BIGINT) AS k FROM match_events)".replace("END::INT AS sets", "END AS sets"), "match_events"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over every event."""
    k = F.col("k")
    e = Tables(spark, sf_dir).events.select("match_id", "match_date", F.col("match_id").cast("long").alias("k"))
    seq = fn.sequence_of(F.concat(F.lit("MS"), F.lpad((2 + k % 50).cast("string"), 3, "0")))
    score = F.when(k % 7 == 0, F.lit("0")).otherwise(F.lit("6-4 7-6(5)"))
    clock = F.format_string("%02d:%02d:10", (k % 5).cast("int"), (k % 60).cast("int"))
    born = F.make_date((1960 + k % 30).cast("int"), F.lit(6), F.lit(15))
    return e.select(
        "match_id", seq.alias("sequence"), fn.minutes_of(clock).alias("minutes"), fn.age_at(born, F.col("match_date")).alias("age"), fn.clean_score(score).alias("score"), fn.completed_sets(score).alias("sets"),
        fn.event_id((k % 900).cast("string"), seq, F.lit(2026)).alias("id"), fn.md5_bucket(F.col("match_id")).cast("long").alias("bucket"), fn.previous_monday(F.col("match_date")).alias("monday"),
    )


@query(with_tables("SELECT match_id, match_date - (k % 20)::INT AS start_date, match_date AS end_date FROM (SELECT match_id, match_date, CAST(match_id AS BIGINT) AS k FROM match_events)", "match_events"))
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed date ranges parsed back."""
    e = Tables(spark, sf_dir).events.select("match_id", "match_date", (F.col("match_id").cast("long") % 20).cast("int").alias("n"))
    text = F.concat(F.date_format(F.date_sub("match_date", F.col("n")), "d MMMM"), F.lit(" - "), F.date_format("match_date", "d MMMM, yyyy"))
    start, end = fn.date_range(text, F.lit(1900))
    return e.select("match_id", start.alias("start_date"), end.alias("end_date"))


#: Consecutive event or player numbers that may share a page, so that pages stay small however many there are of a year or day.
PAGE = 1_000


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of tournament cards, one for each event of a year; a page holds at most PAGE cards."""
    e = Tables(spark, sf_dir).events.select("match_id", "match_date", "tournament")
    card = F.concat(F.lit('<li class="tournament row"><img src="/img/categorystamps_'), F.regexp_replace("tournament", "_", ""), F.lit('.png"><a href="/en/tournaments/'), "tournament", F.lit("/"), "match_id", F.lit('/overview"><span class="name">Open &amp; '), "tournament", F.lit('</span></a><span class="Date">'), F.date_format("match_date", "d MMMM, yyyy"), F.lit("</span></li>"))
    return e.groupBy(F.year("match_date").alias("year"), F.floor(F.col("match_id").cast("long") / PAGE).alias("page")).agg(F.concat(F.lit("<html><ul>"), F.array_join(F.array_sort(F.collect_list(card)), "\n"), F.lit("</ul></html>")).alias("html"))


@query(with_tables("SELECT year(match_date)::INT AS year, match_id AS tournament_id, tournament AS slug, 'Open & ' || tournament AS name, replace(tournament, '_', '') AS tier, match_date AS start_date, match_date AS end_date FROM match_events", "match_events"))
def archive_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tournaments parsed from pages."""
    return pages.archive_tournaments(archive_pages(spark, sf_dir)).drop("position")


@query(with_tables("SELECT match_date, round, player1_id AS winner_id, player2_id AS loser_id, '6-3 6-2' AS score FROM match_events", "match_events"))
def result_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches under their day headers parsed from pages, half of them loser first."""
    e = Tables(spark, sf_dir).events
    even = F.col("match_id").cast("long") % 2 == 0
    link = lambda c, won: F.concat(F.lit('<div class="player'), F.when(won, " winner").otherwise(""), F.lit('"><a href="/en/players/x-y/'), F.lower(c), F.lit('/overview">Name</a></div>'))
    games = lambda a, b: F.lit(f'<div class="scores"><span>{a}</span><span>{b}</span></div>')
    first = F.concat(link(F.col("player1_id"), F.lit(True)), games(6, 6), link(F.col("player2_id"), F.lit(False)), games(3, 2))
    second = F.concat(link(F.col("player2_id"), F.lit(False)), games(3, 2), link(F.col("player1_id"), F.lit(True)), games(6, 6))
    match = F.concat(F.lit('<div class="match"><span class="round">'), F.upper("round"), F.lit("</span>"), F.when(even, first).otherwise(second), F.lit("</div>"))
    day = e.groupBy(F.struct(F.trunc("match_date", "month"), F.floor(F.col("match_id").cast("long") / PAGE)).cast("string").alias("page_id"), "match_date").agg(F.concat(F.lit('<h4 class="tournament-day"> '), F.first("match_date").cast("string"), F.lit("</h4>"), F.array_join(F.collect_list(match), "")).alias("part"))
    page = day.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("match_date", "part"))), lambda x: x["part"]), "").alias("html"))
    return pages.result_matches(page).select("match_date", "round", "winner_id", "loser_id", "score")


@query(with_tables("SELECT ranking_date, rank, player_id, 'N ' || player_id AS name, points FROM rankings WHERE rank <= 100", "rankings"))
def ranking_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking rows parsed from pages with thousands separators; a page holds at most PAGE consecutive players of a day."""
    r = Tables(spark, sf_dir).rankings
    row = F.concat(F.lit("<tr><td>"), F.col("rank").cast("string"), F.lit('</td><td><a href="/en/players/n/'), F.lower("player_id"), F.lit('/overview">N '), "player_id", F.lit("</a></td><td>"), F.coalesce(F.format_number("points", 0), F.lit("-")), F.lit("</td></tr>"))
    page = r.groupBy("ranking_date", F.floor(F.substring("player_id", 2, 20).cast("long") / PAGE).alias("page")).agg(F.concat(F.lit("<table><tr><td>menu</td></tr></table><table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return pages.ranking_rows(page, 100)


@query(with_tables("SELECT player_id, display_name, height::SMALLINT AS height, turned_pro, handedness, backhand, CASE WHEN c % 10 = 0 THEN 'other player' END AS reject_reason FROM player_profiles", "player_profiles"))
def overview_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles parsed from pages; every tenth page is another player's."""
    p = Tables(spark, sf_dir).profiles
    fact = lambda n, v: F.concat(F.lit(f"<li><span>{n}</span><span>"), F.coalesce(v, F.lit("")), F.lit("</span></li>"))
    own = F.when(F.col("c") % 10 == 0, "X1").otherwise(F.col("player_id"))
    plays = F.concat_ws(", ", F.when(F.col("handedness") == "L", "Left-Handed").when(F.col("handedness") == "R", "Right-Handed"), F.when(F.col("backhand") == "2H", "Two-Handed Backhand").otherwise("One-Handed Backhand"))
    html = F.concat(F.lit('<div data-player-id="'), own, F.lit('"><div class="player_name"><span>'), "display_name", F.lit("</span></div><ul>"), fact("Height", F.concat(F.lit("5'9\" ("), F.col("height").cast("string"), F.lit("cm)"))), fact("Turned pro", F.col("turned_pro").cast("string")), fact("Plays", plays), F.lit("</ul></div>"))
    return pages.overview_profiles(p.select("player_id", html.alias("html"))).select("player_id", "display_name", "height", "turned_pro", "handedness", "backhand", "reject_reason")


@query(with_tables(f"SELECT match_id AS payload_id, CASE WHEN r IS NULL THEN player1_id END AS winner_id, {', '.join(f'CASE WHEN r IS NULL THEN player{i}_{s} END AS player{i}_{s}' for i in (1, 2) for s in COUNT_STATS)}, r AS reason FROM (SELECT *, CASE WHEN CAST(match_id AS BIGINT) % 41 = 0 THEN 'statistics missing' WHEN CAST(match_id AS BIGINT) % 43 = 0 THEN 'other players' END AS r FROM match_events) ", "match_events").replace("CASE WHEN CAST(match_id AS BIGINT) % 41 = 0 THEN 'statistics missing' WHEN CAST(match_id AS BIGINT) % 43 = 0 THEN 'other players' END", "CASE WHEN CAST(match_id AS BIGINT) % 43 = 0 THEN 'other players' WHEN CAST(match_id AS BIGINT) % 41 = 0 THEN 'statistics missing' END"))
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads, half with totals and half with per-set blocks, some loser first, some broken."""
    e = Tables(spark, sf_dir).events
    k = F.col("match_id").cast("long")

    def block(i: int, part: int | None) -> F.Column:
        value = lambda s: F.col(f"player{i}_{s}") if part is None else (F.floor(F.col(f"player{i}_{s}") / 2) if part == 0 else F.ceil(F.col(f"player{i}_{s}") / 2))
        return F.struct(*[F.when((k % 41 == 0) & F.lit(s == "aces"), None).otherwise(value(s)).cast("long").alias(pages.PAYLOAD_STATS[s]) for s in COUNT_STATS])

    def team(i: int) -> F.Column:
        set_ = lambda part: F.struct(F.struct(block(i, part).alias("ServiceStats")).alias("Stats"))
        return F.struct(F.lower(f"player{i}_id").alias("PlayerId"), F.when(k % 2 == 0, block(i, None)).alias("Totals"), F.array(set_(0), set_(1)).alias("Sets"))

    body = lambda a, b: F.struct(F.lit("MS007").alias("MatchId"), F.col("player1_id").alias("WinningPlayerId"), team(a).alias("PlayerTeam"), team(b).alias("OpponentTeam"))
    json = F.to_json(F.struct(F.when(k % 3 == 0, body(2, 1)).otherwise(body(1, 2)).alias("Match")))
    rows = e.select(F.col("match_id").alias("payload_id"), F.when(k % 43 == 0, "ZZ").otherwise(F.col("player1_id")).alias("player1_id"), "player2_id", json.alias("json"))
    return pages.payload_events(rows).drop("sequence")


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?s)^\s*(.*?)(?:\n\s*\n|$)', 1), '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, nullif(CASE WHEN length(x) <= 1000 THEN x WHEN regexp_extract(substr(x, 1, 1000), '(?s)^(.*\.)', 1) <> '' THEN regexp_extract(substr(x, 1, 1000), '(?s)^(.*\.)', 1) ELSE substr(x, 1, 1000) END, '') AS bio FROM t""")
def biographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead paragraph cut after its last full stop."""
    return Tables(spark, sf_dir).raw("documents").select("doc_id", pages.biography(F.col("text")).alias("bio"))


@query("SELECT event_type, coalesce(k, '') AS k, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1, 2")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 on the event stream's JSON."""
    e = Tables(spark, sf_dir).raw("events").select("event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("event_type", F.coalesce("k", F.lit("")).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 (extension): event-time windows, as a batch over the same function that streams use."""
    rows = streaming.windowed_counts(Tables(spark, sf_dir).raw("events"), "ts", "event_type", "value")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 (extension): session windows."""
    rows = streaming.sessions(Tables(spark, sf_dir).raw("events"), "ts", "user_id")
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


@query(with_tables("SELECT * FROM pm", "pm"))
def streamed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files arriving as a stream keep the directional table equal to a full build."""
    root = shared_path(spark, "stream")
    e = Tables(spark, sf_dir).events.withColumn("ingested_at", F.lit("2002-01-01 00:00:00").cast("timestamp"))
    e.repartition(2, "batch").write.parquet(f"{root}/in")
    stream = streaming.stream_events(spark, f"{root}/in", e.schema, files=1)
    streaming.maintain(stream, f"{root}/events", f"{root}/table", ops.player_matches, f"{root}/checkpoint", buckets=8).awaitTermination()
    return spark.read.parquet(f"{root}/table").drop("bucket")


@query(with_tables("SELECT * FROM pm", "pm"))
def streamed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that arrive out of order, the first with a false player in every seventh event
    and false counts in others, corrected by the last, leave the table of a full build."""
    root = shared_path(spark, "stream")
    k = F.col("match_id").cast("long")
    e = Tables(spark, sf_dir).events
    false = e.where("match_date > '1996-06-30'").withColumn("player1_id", F.when(k % 7 == 0, F.concat(F.lit("P9"), F.substring("player1_id", 3, 20))).otherwise(F.col("player1_id")))
    false = false.withColumn("player2_aces", F.when(k % 5 == 0, 0).otherwise(F.col("player2_aces")))
    parts = [(false, "2002-01-03"), (e.where("match_date <= '1996-06-30'"), "2002-01-01"), (e.where((F.col("match_date") > "1996-06-30") & ((k % 7 == 0) | (k % 5 == 0))), "2002-01-04")]
    for n, (part, stamp) in enumerate(parts):
        part.withColumn("ingested_at", F.lit(stamp).cast("timestamp")).write.parquet(f"{root}/in/part={n}")
    schema = e.withColumn("ingested_at", F.lit(None).cast("timestamp")).schema
    for n in range(len(parts)):  # one arrival after another
        stream = streaming.stream_events(spark, f"{root}/in/part={n}", schema, files=1_000)
        streaming.maintain(stream, f"{root}/events", f"{root}/table", ops.player_matches, f"{root}/checkpoint{n}", buckets=16, first_epoch=n * 1_000_000).awaitTermination()
    return spark.read.parquet(f"{root}/table").drop("bucket")


@query(with_tables("SELECT match_id, player_id, opponent_id, true AS in_range, true AS consistent FROM pm WHERE player_id < opponent_id AND match_date > DATE '2001-01-01'", "pm"))
def trained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two linear families fitted on early events score the later ones. Every
    later event has one row at its smaller id, a probability, and the winner that it implies."""
    t = Tables(spark, sf_dir)
    rows = t.stored(t.features)
    train = rows.where("match_date <= '2001-01-01'")
    fits = {"linear": models.linear({"maxIter": 10}).fit(train), "bayes": models.linear({"family": "bayes"}).fit(train)}
    late = rows.where("match_date > '2001-01-01'").select("match_id", "player_id", "opponent_id", *FEATURE_COLS)
    scored = models.score(late.limit(0), late, fits, [0.7, 0.3])
    implied = F.when(F.col("p_win") >= 0.5, F.col("player_id")).otherwise(F.col("opponent_id"))
    in_range = F.coalesce(F.col("p_win").between(0, 1), F.lit(False))
    return scored.select("match_id", "player_id", "opponent_id", in_range.alias("in_range"), F.coalesce(F.col("predicted_winner") == implied, F.lit(False)).alias("consistent"))


