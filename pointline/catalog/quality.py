"""Queries that return violations, and audits by a second derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, writes
from ..plans import contract
from ..schemas import COUNT_STATS, DIFF_COLS, DIFF_SOURCES, FEATURE_COLS, SNAPSHOT_VALUES, SURFACES
from .base import Tables
from .ingest import shared_path
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


#: Events with faults planted by their own key, so that the checks have something to find.
_FAULTS = {
    "match_id": "match_id", "match_date": "CASE WHEN k % 101 = 0 THEN NULL ELSE match_date END", "player1_id": "player1_id",
    "player2_id": "CASE WHEN k % 103 = 0 THEN player1_id ELSE player2_id END", "winner_id": "CASE WHEN k % 107 = 0 THEN player2_id ELSE winner_id END",
    "tournament": "CASE WHEN k % 109 = 0 THEN ' ' ELSE tournament END", "surface": "CASE WHEN k % 113 = 0 THEN 'ice' ELSE surface END",
    "best_of": "CASE WHEN k % 127 = 0 THEN 4 ELSE best_of END", "is_indoor": "is_indoor", "player1_aces": "CASE WHEN k % 131 = 0 THEN -1 ELSE player1_aces END",
}
_KEPT = [f"player{i}_{s}" for i in (1, 2) for s in (*COUNT_STATS, "ranking", "age") if f"player{i}_{s}" not in _FAULTS]
_FAULTY = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _FAULTS.items())}, {', '.join(_KEPT)} FROM (SELECT *, CAST(match_id AS BIGINT) AS k FROM match_events)"


def faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.withColumn("k", F.col("match_id").cast("long")).selectExpr(*[f"{e} AS {n}" for n, e in _FAULTS.items()], *_KEPT)


def _rule_sql() -> str:
    rules = [(f"{c} missing", f"coalesce(trim({c}::VARCHAR), '') <> ''") for c in ("match_id", "player1_id", "player2_id", "winner_id", "tournament", "surface")]
    rules += [("match_date missing", "match_date IS NOT NULL"), ("self play", "player1_id <> player2_id"), ("winner not first", "winner_id = player1_id")]
    rules += [("surface unknown", f"surface IN {SURFACES}"), ("best_of out of domain", "best_of IS NULL OR best_of IN (1, 3, 5)"), ("is_indoor out of domain", "is_indoor IS NULL OR is_indoor IN (0, 1)")]
    for i in (1, 2):
        rules += [(f"player{i}_ranking not positive", f"player{i}_ranking IS NULL OR player{i}_ranking >= 1"), (f"player{i}_age out of range", f"player{i}_age BETWEEN 0 AND 100")]
        rules += [(f"player{i}_{s} out of range", f"player{i}_{s} >= 0" + ("" if s == "total_serve_points" else f" AND player{i}_{s} <= 20000")) for s in COUNT_STATS]
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{n}' END" for n, ok in rules) + "], lambda x: x IS NOT NULL)"


@query(with_tables(f"SELECT match_id, array_to_string(issues, '; ') AS issues FROM (SELECT match_id, {_rule_sql()} AS issues FROM ({_FAULTY})) WHERE len(issues) > 0", "match_events"))
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of each faulty row."""
    rows = checks.validated(faulty_events(spark, sf_dir), checks.match_rules())
    return rows.where(F.size("issues") > 0).select("match_id", F.array_join("issues", "; ").alias("issues"))


@query(with_tables(f"SELECT match_id, issues[1] AS reason FROM (SELECT match_id, {_rule_sql()} AS issues FROM ({_FAULTY})) WHERE len(issues) > 0", "match_events"))
def first_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing reason."""
    return faulty_events(spark, sf_dir).select("match_id", checks.first_issue(checks.match_rules()).alias("reason")).where("reason IS NOT NULL")


#: A first batch of two thirds of the faulty events, then all of them; surfaces are canonical before they are judged.
_CANONICAL = f"SELECT * REPLACE (CASE WHEN surface IN {SURFACES} THEN surface ELSE 'hard' END AS surface) FROM ({_FAULTY})"
_JUDGED = f"SELECT match_id, CAST(match_id AS BIGINT) % 3 AS part, {_rule_sql()} AS issues FROM ({_CANONICAL})"


def inserted_batches(spark: SparkSession, sf_dir: str) -> tuple[str, list[dict[str, int]]]:
    path, rows = shared_path(spark, "inserted"), faulty_events(spark, sf_dir)
    first = rows.where(F.col("match_id").cast("long") % 3 != 0)
    return path, [writes.validated_insert(part, checks.match_rules(), ["match_id"], path, n) for n, part in enumerate((first, rows))]


@query(
    with_tables(
        "SELECT batch, count(*) AS n_input, count(*) FILTER (len(issues) = 0) AS n_valid, count(*) FILTER (len(issues) > 0) AS n_dropped, count(*) FILTER (len(issues) = 0 AND batch = 1 AND part <> 0) AS n_skipped, count(*) FILTER (len(issues) = 0 AND (batch = 0 OR part = 0)) AS n_inserted FROM j, (VALUES (0), (1)) b(batch) WHERE batch = 1 OR part <> 0 GROUP BY batch",
        "match_events",
        more={"j": _JUDGED},
    )
)
def insert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two validated inserts took in, dropped, skipped and stored, by the files written."""
    names = ("n_input", "n_valid", "n_dropped", "n_skipped", "n_inserted")
    counts = inserted_batches(spark, sf_dir)[1]
    return spark.createDataFrame([(n, *[c[x] for x in names]) for n, c in enumerate(counts)], "batch int, " + ", ".join(f"{x} long" for x in names))


@query(
    with_tables(
        "SELECT match_id, NULL AS batch, NULL AS issues FROM j WHERE len(issues) = 0 UNION ALL SELECT match_id, batch, array_to_string(issues, '; ') FROM j, (VALUES (0), (1)) b(batch) WHERE len(issues) > 0 AND (batch = 1 OR part <> 0)",
        "match_events",
        more={"j": _JUDGED},
    )
)
def inserted_and_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events, each once, and the dropped rows of each batch with their reasons."""
    path = inserted_batches(spark, sf_dir)[0]
    stored = writes.inserted_rows(spark, path).select("match_id", F.lit(None).cast("int").alias("batch"), F.lit(None).cast("string").alias("issues"))
    return stored.union(writes.quarantined_rows(spark, path).select("match_id", "batch", F.array_join("issues", "; ").alias("issues")))


@query(
    with_tables(
        "SELECT match_id, CASE WHEN k % 10 IN (2, 3) THEN concat('new ', surface) ELSE surface END AS surface, CASE WHEN k % 10 = 0 OR k % 10 = 2 THEN TIMESTAMP '2002-02-02' WHEN k % 10 = 3 THEN TIMESTAMP '2002-03-03' ELSE TIMESTAMP '2002-01-01' END AS ingested_at FROM (SELECT *, CAST(match_id AS BIGINT) AS k FROM match_events)",
        "match_events",
    )
)
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after inserts, an insert that overwrites nothing, and two that overwrite; only changed rows are stamped anew."""
    path, k = shared_path(spark, "upserted"), F.col("match_id").cast("long")
    e = Tables(spark, sf_dir).events.select("match_id", "surface")
    new = e.withColumn("surface", F.concat(F.lit("new "), "surface"))
    at = lambda day: F.to_timestamp_ntz(F.lit(day))
    writes.upsert_buckets(path, e.where(k % 10 != 0), ["match_id"], at("2002-01-01"), buckets=16)
    writes.upsert_buckets(path, e.where(k % 10 == 0).union(new.where(k % 10 == 5)), ["match_id"], at("2002-02-02"), overwrite=False, buckets=16)
    writes.upsert_buckets(path, new.where(k % 10 == 2).union(e.where(k % 10 == 4)), ["match_id"], at("2002-02-02"), buckets=16)
    writes.upsert_buckets(path, new.where(k % 10 == 3), ["match_id"], at("2002-03-03"), buckets=16)
    return spark.read.parquet(path).select("match_id", "surface", "ingested_at")


@query(with_tables(f"SELECT count(*) AS n_input, count(*) FILTER (WHERE len(issues) = 0) AS n_valid, count(*) FILTER (WHERE len(issues) > 0) AS n_dropped FROM (SELECT {_rule_sql()} AS issues FROM ({_FAULTY}))", "match_events"))
def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5."""
    return checks.drop_report(checks.validated(faulty_events(spark, sf_dir), checks.match_rules()))


#: Rows that a faulty table lacks: one side of some events, both sides of others.
_LACKS = "(CAST(match_id AS BIGINT) % 53 = 0 AND player_id < opponent_id) OR CAST(match_id AS BIGINT) % 71 = 0"


@query(with_tables(f"SELECT match_id, coalesce(n, 0) AS n FROM match_events LEFT JOIN (SELECT match_id, count(*) AS n FROM pm WHERE NOT ({_LACKS}) GROUP BY 1) USING (match_id) WHERE coalesce(n, 0) <> 2", "pm"))
def lost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, C14: events without both directional rows, in a table that lacks some."""
    t = Tables(spark, sf_dir)
    return checks.lost_events(t.events, t.matches.where(f"NOT ({_LACKS})"))


_REPEATED = "CASE WHEN CAST(match_id AS BIGINT) % 59 = 0 AND player_match_number > 1 THEN player_match_number - 1 ELSE player_match_number END"


@query(with_tables(f"SELECT player_id, {_REPEATED} AS player_match_number, count(*) AS n FROM pm GROUP BY 1, 2 HAVING count(*) > 1", "pm"))
def duplicate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals that repeat, in a table where those of some events are one too small."""
    rows = Tables(spark, sf_dir).matches.withColumn("player_match_number", F.expr(_REPEATED))
    return checks.duplicate_keys(rows, ["player_id", "player_match_number"])


#: Snapshots filed under an event that isn't theirs: every player's 20th, and those of some events.
_MISFILED = "CASE WHEN CAST(match_id AS BIGINT) % 43 = 0 OR player_match_number % 20 = 0 THEN 'lost ' || match_id ELSE match_id END"


@query(with_tables(f"SELECT player_id, match_id FROM pm WHERE NOT EXISTS (SELECT * FROM (SELECT player_id, {_MISFILED} AS match_id FROM rf) s WHERE s.player_id = pm.player_id AND s.match_id = pm.match_id)", "pm", "rf"))
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, C14: rows without a snapshot in the stored table of all snapshots, some of which are misfiled."""
    t = Tables(spark, sf_dir)
    return checks.orphans(t.kept_matches, t.kept_snapshots.withColumn("match_id", F.expr(_MISFILED)), ["player_id", "match_id"])


@query(with_tables("SELECT match_id, player_id FROM pm WHERE CAST(match_id AS BIGINT) % 211 = 0", "pm"))
def head_to_head_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: rows whose head-to-head a second derivation contradicts, with some falsified."""
    t = Tables(spark, sf_dir)
    rows = t.features.withColumn("h2h_exposure", F.when(F.col("match_id").cast("long") % 211 == 0, F.col("h2h_exposure") + 1).otherwise(F.col("h2h_exposure")))
    return checks.head_to_head_violations(rows, t.events)


#: Differences and per-side values that snapshots determine; rest days and profile values aren't theirs.
AUDITED = {d: s for d, s in zip(DIFF_COLS, DIFF_SOURCES, strict=True) if s != "log_rest"}
AUDITED_SIDES = ("weighted_form_10", "matches_10")
_CELLS = [*AUDITED, *(f"{side}_{c}" for c in AUDITED_SIDES for side in ("player", "opponent"))]
_SAMPLE = "SELECT DISTINCT match_id FROM (SELECT match_id FROM (SELECT * FROM match_events ORDER BY match_date, match_id LIMIT 20) UNION ALL SELECT match_id FROM (SELECT * FROM match_events ORDER BY match_date DESC, match_id DESC LIMIT 20) UNION ALL SELECT match_id FROM (SELECT player_id, min((match_date, match_id))[1] AS d, min((match_date, match_id))[2] AS match_id FROM pm GROUP BY 1 ORDER BY d, match_id LIMIT 20) UNION ALL SELECT match_id FROM (SELECT player_id, match_date, min(match_id) AS match_id FROM pm GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY match_date, match_id, player_id LIMIT 20) UNION ALL SELECT match_id FROM (SELECT least(player1_id, player2_id) AS a, greatest(player1_id, player2_id) AS b, max(match_id) AS match_id FROM match_events GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY a, b LIMIT 20) UNION ALL SELECT match_id FROM match_events WHERE ('0x' || substr(md5(match_id), 17, 8))::BIGINT % 256 = 0)"
#: The n-th cell is falsified where (event, player) leave n: every cell is wrong somewhere in a sample of some hundred rows.
_FALSE = f"(CAST(match_id AS BIGINT) + substr(player_id, 2)::BIGINT) % {len(_CELLS) + 1}"


@query(with_tables(f"SELECT match_id, player_id, (['none', {', '.join(repr(c) for c in _CELLS)}])[{_FALSE} + 1] AS \"column\" FROM pm WHERE match_id IN ({_SAMPLE}) AND {_FALSE} > 0", "pm"))
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, F8: sampled features that strictly earlier snapshots don't give again, with one cell of most rows falsified."""
    t = Tables(spark, sf_dir)
    turn = (F.col("match_id").cast("long") + F.expr("cast(substr(player_id, 2) AS bigint)")) % (len(_CELLS) + 1)
    false = {c: F.when(turn == n, F.col(c) + 1).otherwise(F.col(c)) for n, c in enumerate(_CELLS, 1)}
    return checks.leakage_cells(t.features.withColumns(false), t.kept_snapshots, t.defaults, checks.audit_sample(t.events), AUDITED, AUDITED_SIDES)


@query(with_tables(_SAMPLE, "pm"))
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified deterministic sample."""
    return checks.audit_sample(Tables(spark, sf_dir).events)


@query(with_tables("SELECT match_id, player_id, 'dominance_diff' AS \"column\" FROM pm WHERE CAST(match_id AS BIGINT) % 97 = 0", "pm"))
def non_finite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 37 features, with some made infinite or null."""
    k = F.col("match_id").cast("long")
    rows = Tables(spark, sf_dir).features.withColumn("dominance_diff", F.when(k % 194 == 0, F.lit(float("inf"))).when(k % 97 != 0, F.col("dominance_diff")))
    return checks.non_finite_cells(rows, ["match_id", "player_id"], FEATURE_COLS)


@query("SELECT CASE n WHEN 0 THEN 'rows' WHEN 1 THEN 'dominance' ELSE 'avg_years_pro' END AS \"column\" FROM (SELECT unnest(range(3)) AS n), (SELECT count(*) AS events FROM orders) WHERE events > 0")
def singleton_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: what keeps the defaults from being one finite row, with a second row that has two bad cells."""
    row = Tables(spark, sf_dir).defaults
    bad = row.withColumn("dominance", F.lit(float("nan"))).withColumn("avg_years_pro", F.lit(None).cast("double"))
    return checks.singleton_violations(row.union(bad), [*SNAPSHOT_VALUES, "days_since_default", "matches_30d_default", "rate_default", "left_handed_rate", "avg_years_pro"])


@query(with_tables("SELECT 'latest_player_ranking' AS \"column\", latest_player_ranking AS value FROM ta WHERE latest_player_ranking > 1", "ta"))
def rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: cells outside of 0 to 1, with the ranking among the checked."""
    rates = [c for c in SNAPSHOT_VALUES if c.endswith(("_pct_10", "rate_10"))]
    return checks.out_of_bounds(Tables(spark, sf_dir).defaults, {c: (0, 1) for c in [*rates, "latest_player_ranking", "left_handed_rate"]} | {"tour_ace_rate": (0, None)})


@query(with_tables("SELECT match_id, count(*) AS n, sum(match_won)::BIGINT AS positives FROM (SELECT match_id, CASE WHEN CAST(match_id AS BIGINT) % 89 = 0 THEN 1 ELSE match_won END AS match_won FROM pm) GROUP BY 1 HAVING count(*) <> 2 OR sum(match_won) <> 1", "pm"))
def pair_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without exactly one positive of two rows, with some labels falsified."""
    rows = Tables(spark, sf_dir).matches.withColumn("match_won", F.when(F.col("match_id").cast("long") % 89 == 0, 1).otherwise(F.col("match_won")))
    return checks.pair_invariants(rows, "match_id", "match_won")


#: Rows filed under an event that isn't theirs: every player's 20th, and the smaller side of some events.
_ELSEWHERE = "CASE WHEN (CAST(match_id AS BIGINT) % 61 = 0 AND player_id < opponent_id) OR player_match_number % 20 = 0 THEN 'lost ' || match_id ELSE match_id END"


@query(with_tables("SELECT a.match_id, a.player_id FROM filed a LEFT JOIN filed b ON a.match_id = b.match_id AND a.player_id = b.opponent_id WHERE b.player_id IS DISTINCT FROM a.opponent_id", "pm", more={"filed": f"SELECT * REPLACE ({_ELSEWHERE} AS match_id) FROM pm"}))
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: rows of the whole table whose other side isn't there, as rows of both kinds are misfiled."""
    return checks.reciprocity_violations(Tables(spark, sf_dir).matches.withColumn("match_id", F.expr(_ELSEWHERE)))


@query(with_tables("SELECT 'player_ranking' AS \"column\", count(*) AS count FROM pm WHERE player_ranking IS NULL UNION ALL SELECT 'player_rank_points', count(*) FROM pm WHERE player_rank_points IS NULL", "pm"))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of columns that should have none."""
    return checks.null_keys(Tables(spark, sf_dir).matches, ["match_id", "player_id", "player_ranking", "player_rank_points"])


#: The published tables and their columns.
_CONTRACT = contract.Contract(
    columns={
        "matches": [("match_id", "string"), ("player_id", "string"), ("opponent_id", "string"), ("match_won", "int"), ("best_of", "int"), ("age", "double")],
        "profiles": [("player_id", "string"), ("display_name", "string")],
    },
    keys={"profiles": ["player_id"]},
    pairs="matches",
    finite=["age"],
    domains={"best_of": (1, 3, 5)},
)
_K = "CAST(match_id AS BIGINT)"
#: What is wrong with each version, and how often its rules are broken, by SQL.
_VERSIONS = {
    "sound": {},
    "missing table": {"table set": "1"},
    "swapped columns": {"column order": "1"},
    "text labels": {"column type": "1"},
    "no profiles": {"empty table": "1"},
    "repeated profile": {"unique key": "(SELECT count(*) FROM player_profiles WHERE c % 40 = 0)"},
    "lost side": {"two rows": f"(SELECT count(DISTINCT match_id) FROM pm WHERE {_K} % 53 = 0)"},
    "repeated side": {rule: f"(SELECT count(DISTINCT match_id) FROM pm WHERE {_K} % 71 = 0)" for rule in ("directional key", "reciprocity")},
    "wrong opponent": {"reciprocity": f"(SELECT count(DISTINCT match_id) FROM pm WHERE {_K} % 61 = 0)"},
    "two winners": {"labels": f"(SELECT count(DISTINCT match_id) FROM pm WHERE {_K} % 89 = 0)"},
    "no age": {"finite cells": f"(SELECT count(*) FROM pm WHERE {_K} % 97 = 0)"},
    "best of four": {"domain": f"(SELECT count(*) FROM pm WHERE {_K} % 127 = 0)"},
}


@query(with_tables("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS version, '{r}' AS rule, CAST({n} AS BIGINT) AS n" for v, rules in _VERSIONS.items() for r, n in (rules or {"published": "1"}).items()) + ") WHERE n > 0", "pm", "player_profiles"))
def refused_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: a sound version is published; of the others, each with a fault of its own, none is, and the broken rules are counted."""
    t, root, k = Tables(spark, sf_dir), shared_path(spark, "versions"), F.col("match_id").cast("long")
    order = ["match_id", "player_id", "opponent_id", "match_won", "best_of", "age"]
    rows = t.matches.select("match_id", "player_id", "opponent_id", F.col("match_won").cast("int").alias("match_won"), F.when(k % 2 == 0, 5).otherwise(3).alias("best_of"), (k % 20 + 18.5).alias("age"))
    rows, people = t.stored(rows.select(*order)), t.profiles.select("player_id", "display_name")
    one = (k % 61 == 0) & (F.col("player_id") < F.col("opponent_id"))
    put = lambda c, when, value: rows.withColumn(c, F.when(when, value).otherwise(F.col(c)))
    changed = {
        "swapped columns": rows.select("player_id", "match_id", *order[2:]),
        "text labels": rows.withColumn("match_won", F.col("match_won").cast("string")),
        "lost side": rows.where(~((k % 53 == 0) & (F.col("player_id") < F.col("opponent_id")))),
        "repeated side": put("player_id", k % 71 == 0, F.least("player_id", "opponent_id")),
        "wrong opponent": put("opponent_id", one, F.lit("nobody")),
        "two winners": put("match_won", k % 89 == 0, F.lit(1)),
        "no age": put("age", k % 97 == 0, F.lit(None)),
        "best of four": put("best_of", k % 127 == 0, F.lit(4)),
    }
    out = []
    for version in _VERSIONS:
        tables = {"matches": changed.get(version, rows), "profiles": people}
        if version == "missing table":
            del tables["profiles"]
        if version == "no profiles":
            tables["profiles"] = people.limit(0)
        if version == "repeated profile":
            tables["profiles"] = people.union(t.profiles.where("c % 40 = 0").select(*people.columns))
        faults = contract.publish_contract(tables, root, version, _CONTRACT)
        out += [(version, rule, n) for rule, n in faults.items()]
    published = spark.read.parquet(f"{root}/pointers").select("version", F.lit("published").alias("rule"), F.lit(1).cast("long").alias("n"))
    return published.union(spark.createDataFrame(out, "version string, rule string, n long"))
