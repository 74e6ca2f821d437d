"""Queries of splits, folds, metrics, calibration and drift over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import antisymmetric_evidence, logit, sigmoid, temperature_scaled
from ..operators.ordered import exact_quantile
from ..plans import evaluation as ev
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


#: A fixed score of each labelled document, so that metrics have something to measure.
SCORED = "SELECT l.doc_id, l.quality AS y, ((l.doc_id * 37 + d.n_chars * 11) % 997 + 1) / 999.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y"), (((F.col("doc_id") * 37 + F.col("n_chars") * 11) % 997 + 1) / F.lit(999.0)).alias("p"))


_LOSS = "-(y * ln(p) + (1 - y) * ln(1 - p))"
_AUC = "SELECT (sum(r) FILTER (WHERE y = 1) - (count(*) FILTER (WHERE y = 1)) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s)"


@query(sql_rounded(f"WITH s AS ({SCORED}) SELECT avg({_LOSS}) AS log_loss, avg((p >= 0.5)::INT = y) AS accuracy, avg((y - p) ** 2) AS brier, count(*) AS n, any_value(roc_auc) AS roc_auc FROM s, ({_AUC})".replace("avg((p >= 0.5)::INT = y)", "avg(((p >= 0.5)::INT = y)::INT)"), ["log_loss", "accuracy", "brier", "roc_auc"]))
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss, exact AUC, accuracy and Brier score."""
    return rounded(ev.gate_metrics(scored(spark, sf_dir), "y", "p"))


@query(f"WITH s AS ({SCORED}) SELECT y::INT AS actual, (p >= 0.5)::INT AS predicted, count(*) AS count FROM s GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K19."""
    return ev.confusion(scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int")), "y", "pred")


@query(sql_rounded(f"WITH s AS ({SCORED}), c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM s) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c", ["precision", "recall", "f1"]))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K19."""
    return rounded(ev.class_report(scored(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int")), "y", "pred"))


@query(sql_rounded(f"WITH s AS ({SCORED}), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM s GROUP BY 1) SELECT sum(n * abs(mp - r)) / sum(n) AS ece FROM b", ["ece"]))
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K17."""
    return rounded(ev.calibration_error(scored(spark, sf_dir), "y", "p"))


@query(sql_rounded(f"WITH s AS ({SCORED}) SELECT greatest(ceil(p * 5)::INT - 1, 0) AS bin, avg(p) AS mean_p, avg(y) AS rate, count(*) AS n FROM s GROUP BY 1", ["mean_p", "rate"]))
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five right-closed bins."""
    return rounded(ev.reliability(scored(spark, sf_dir), "y", "p"))


_CURVE = f"WITH s AS ({SCORED}), g AS (SELECT p AS threshold, sum(y)::BIGINT AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT threshold, (sum(pos) OVER w)::DOUBLE AS tp, (sum(n) OVER w)::DOUBLE AS seen, (sum(pos) OVER ())::DOUBLE AS P, (sum(n) OVER ())::DOUBLE AS total FROM g WINDOW w AS (ORDER BY threshold DESC)), k AS (SELECT threshold, (seen - tp) / (total - P) AS fpr, tp / P AS tpr, tp / seen AS precision FROM c)"


@query(sql_rounded(f"{_CURVE} SELECT * FROM k", ["threshold", "fpr", "tpr", "precision"]).replace("FROM (WITH", "FROM (WITH"))
def roc_and_pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both curves' points."""
    return rounded(ev.curve_points(scored(spark, sf_dir), "y", "p"))


@query(sql_rounded(f"{_CURVE} SELECT sum((tpr - prev) * precision) AS average_precision FROM (SELECT *, lag(tpr, 1, 0) OVER (ORDER BY threshold DESC) AS prev FROM k)", ["average_precision"]))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K20."""
    return rounded(ev.average_precision(scored(spark, sf_dir), "y", "p"))


@query(sql_rounded(f"WITH s AS ({SCORED}), g AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS temperature), q AS (SELECT temperature, y, 1 / (1 + exp(-temperature * ln(greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))))) AS p FROM s, g) SELECT temperature, avg({_LOSS}) AS log_loss FROM q GROUP BY 1", ["temperature", "log_loss"]))
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of each temperature in one scan."""
    return rounded(ev.temperature_losses(scored(spark, sf_dir), "y", "p", [0.25, 0.5, 1.0, 2.0, 4.0]))


@query(sql_rounded(f"WITH s AS ({SCORED}), l AS (SELECT doc_id, p, ln(p / (1 - p)) AS logit FROM s) SELECT doc_id, logit, 1 / (1 + exp(-logit)) AS back, (logit + logit) / 2 AS evidence, 1 / (1 + exp(-1.5::DOUBLE * logit)) AS scaled FROM l", ["logit", "back", "evidence", "scaled"]))
def probability_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit, sigmoid, evidence of a complementary pair, temperature."""
    p = F.col("p")
    return rounded(scored(spark, sf_dir).select("doc_id", logit(p).alias("logit"), sigmoid(logit(p)).alias("back"), antisymmetric_evidence(p, 1 - p).alias("evidence"), temperature_scaled(p, F.lit(1.5)).alias("scaled")))


@query(with_tables("SELECT match_id, player_id, CASE WHEN match_date <= lo + floor((hi - lo) * 0.96::DOUBLE)::INT THEN 'train' WHEN match_date <= lo + floor((hi - lo) * 0.98::DOUBLE)::INT THEN 'val' ELSE 'test' END AS split FROM pm, (SELECT min(match_date) AS lo, max(match_date) AS hi FROM pm)", "pm"))
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    return ev.chronological_split(Tables(spark, sf_dir).matches, "match_date").select("match_id", "player_id", "split")


@query(with_tables("SELECT CASE WHEN match_date <= lo + floor((hi - lo) * 0.96::DOUBLE)::INT THEN 'train' WHEN match_date <= lo + floor((hi - lo) * 0.98::DOUBLE)::INT THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT match_id) AS n_events, min(match_date) AS first_date, max(match_date) AS last_date FROM pm, (SELECT min(match_date) AS lo, max(match_date) AS hi FROM pm) GROUP BY 1", "pm"))
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return ev.split_summary(ev.chronological_split(Tables(spark, sf_dir).matches, "match_date"), "match_id", "match_date")


_FOLDS = "SELECT match_id, match_date, (ntile - 1)::INT AS fold FROM match_events JOIN (SELECT d, ntile(6) OVER (ORDER BY d) AS ntile FROM (SELECT DISTINCT match_date AS d FROM match_events)) ON d = match_date"


@query(with_tables(_FOLDS, "match_events"))
def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: five time-forward folds and the grow-in band."""
    return ev.assign_folds(Tables(spark, sf_dir).matches, "match_id", "match_date", 5)


#: Two directional predictions of each event from its rows' own numbers.
_PREDS = "SELECT match_id, player_id, opponent_id, match_won, ((match_id::BIGINT * 31 + substr(player_id, 2)::BIGINT * 17) % 97 + 1) / 99.0::DOUBLE AS base FROM pm"


def directional_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("match_id").cast("long") * 31 + F.substring("player_id", 2, 10).cast("long") * 17
    return Tables(spark, sf_dir).matches.select("match_id", "player_id", "opponent_id", "match_won", ((number % 97 + 1) / F.lit(99.0)).alias("base"))


@query(with_tables("SELECT surface, round(avg(((base >= 0.5)::INT = d.match_won)::INT), 6) AS accuracy, count(*) AS n FROM d JOIN pm USING (match_id, player_id) GROUP BY 1", "pm", more={"d": _PREDS}))
def accuracy_by_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the predicted side wins, by surface."""
    rows = directional_predictions(spark, sf_dir).join(Tables(spark, sf_dir).matches.select("match_id", "player_id", "surface"), ["match_id", "player_id"])
    right = ((F.col("base") >= 0.5).cast("int") == F.col("match_won")).cast("int")
    return rows.groupBy("surface").agg(F.round(F.avg(right), 6).alias("accuracy"), F.count("*").alias("n"))


@query(with_tables(sql_rounded(f"WITH d AS ({_PREDS}) SELECT a.match_id, a.player_id, a.opponent_id, a.match_won, a.base AS base_ab, b.base AS base_ba, (ln(a.base / (1 - a.base)) - ln(b.base / (1 - b.base))) / 2 AS base_evidence FROM d a JOIN d b ON a.match_id = b.match_id AND a.player_id = b.opponent_id WHERE a.player_id < a.opponent_id", ["base_ab", "base_ba", "base_evidence"]), "pm"))
def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20, K12."""
    return rounded(ev.evidence_pairs(directional_predictions(spark, sf_dir), ["base"]))


_CUT = "DATE '2000-01-01'"
_WINDOWS = f"SELECT *, 'current' AS win FROM match_events WHERE match_date > {_CUT} UNION ALL SELECT *, 'reference' FROM (SELECT * FROM match_events WHERE match_date < {_CUT} ORDER BY match_date DESC, match_id DESC LIMIT (SELECT least(greatest(count(*), 30), 10000) FROM match_events WHERE match_date > {_CUT}))"


def _rate_sql(i: int) -> str:
    return f"player{i}_first_serves_made / nullif(player{i}_total_serve_points, 0) AS player{i}_first_serve_pct, (player{i}_first_serve_points_won + player{i}_second_serve_points_won) / nullif(player{i}_total_serve_points, 0) AS player{i}_serve_win_pct, player{i}_aces / nullif(player{i}_first_serves_made, 0) AS player{i}_ace_rate, player{i}_double_faults / nullif(player{i}_total_serve_points, 0) AS player{i}_df_rate"


RATE_COLS = [f"player{i}_{n}" for i in (1, 2) for n in ("first_serve_pct", "serve_win_pct", "ace_rate", "df_rate")]


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.drift_windows(ev.drift_rates(Tables(spark, sf_dir).events), F.lit("2000-01-01").cast("date"))


@query(with_tables(sql_rounded(f"SELECT match_id, match_date, win AS \"window\", {_rate_sql(1)}, {_rate_sql(2)} FROM ({_WINDOWS})", RATE_COLS), "match_events"))
def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and size-matched reference events with unsmoothed rates."""
    return rounded(windows(spark, sf_dir))


_PSI = f"""WITH w AS (SELECT win, {_rate_sql(1)}, {_rate_sql(2)} FROM ({_WINDOWS})), l AS (UNPIVOT w ON {', '.join(RATE_COLS)} INTO NAME col VALUE v),
e AS (SELECT col, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM l WHERE win = 'reference' GROUP BY 1),
b AS (SELECT l.col, win, len(list_filter(edges, lambda x: x < v)) AS bin FROM l JOIN e ON l.col = e.col),
n AS (SELECT e.col, g.bin, (SELECT count(*) FROM b WHERE b.col = e.col AND b.bin = g.bin AND win = 'current') AS c, (SELECT count(*) FROM b WHERE b.col = e.col AND b.bin = g.bin AND win = 'reference') AS r FROM e, (SELECT unnest(range(10)) AS bin) g),
s AS (SELECT col, greatest(c / sum(c) OVER (PARTITION BY col), 0.0001) AS p, greatest(r / sum(r) OVER (PARTITION BY col), 0.0001) AS q FROM n)
SELECT col AS "column", sum((p - q) * ln(p / q)) AS psi FROM s GROUP BY 1"""


@query(with_tables(sql_rounded(_PSI, ["psi"]), "match_events"))
def population_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten reference deciles, empty shares as 1e-4."""
    return rounded(ev.stability_index(windows(spark, sf_dir), RATE_COLS))


@query(with_tables(f"SELECT round(drift_share, 6) AS drift_share, round(largest_psi, 6) AS largest_psi, 0.0::DOUBLE AS prediction_psi, CASE WHEN drift_share >= 0.75 THEN 'retrain' WHEN largest_psi >= 0.1 THEN 'investigate' ELSE 'healthy' END AS verdict FROM (SELECT avg((psi >= 0.3)::INT) AS drift_share, max(psi) AS largest_psi FROM ({_PSI}))", "match_events"))
def drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K27."""
    return rounded(ev.drift_verdict(ev.stability_index(windows(spark, sf_dir), RATE_COLS), None, F.lit(0.0), F.lit(None).cast("double"), F.lit(100)))


#: What happens to the current window: nothing, or one change for each trigger.
SCENARIOS = ("nothing", "one feature", "all features", "prediction", "calibration", "ranking")
#: Scores of the window's events, alike in Spark and DuckDB: labels by the id's parity, and probabilities that follow them.
_SCORED = ("*", "CAST(match_id AS BIGINT) AS k")
_LABELLED = ("*", "CAST(k % 2 AS INT) AS y", "(20 + 20 * (k % 2) + (k * 37 % 41)) / 100.0E0 AS p")


def _changed(scenario: str) -> tuple[list[str], str]:
    """Select list and filter of a scenario."""
    now = "is_current"
    shift = {"one feature": {"player1_ace_rate": 0.035}, "all features": dict.fromkeys(RATE_COLS, 0.2)}.get(scenario, {})
    rates = [f"CASE WHEN {now} THEN {c} + {shift[c]}E0 ELSE {c} END AS {c}" if c in shift else c for c in RATE_COLS]
    p = {"prediction": f"CASE WHEN {now} THEN 0.5E0 + p / 2 ELSE p END", "ranking": f"CASE WHEN {now} THEN (20 + 20 * (1 - y) + (k * 37 % 41)) / 100.0E0 ELSE p END"}.get(scenario, "p")
    return [*rates, "y", f"{p} AS p", "win"], f"NOT ({now} AND y = 0 AND k % 5 IN (1, 2, 4))" if scenario == "calibration" else "true"


def _signals_sql() -> str:
    parts = []
    for scenario in SCENARIOS:
        columns, kept = _changed(scenario)
        parts.append(f"SELECT '{scenario}' AS scenario, {', '.join(columns)} FROM d WHERE {kept}")
    return f"""WITH d AS (SELECT *, win = 'current' AS is_current FROM (SELECT {', '.join(_LABELLED)} FROM (SELECT {', '.join(_SCORED)} FROM (SELECT match_id, win, {_rate_sql(1)}, {_rate_sql(2)} FROM ({_WINDOWS}))))),
w AS ({' UNION ALL '.join(parts)}),
l AS (SELECT scenario, win, unnest([{', '.join(repr(c) for c in [*RATE_COLS, 'p'])}]) AS col, unnest([{', '.join([*RATE_COLS, 'p'])}]) AS v FROM w),
e AS (SELECT scenario, col, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM l WHERE win = 'reference' AND v IS NOT NULL GROUP BY ALL),
b AS (SELECT scenario, col, win, len(list_filter(edges, lambda x: x < v)) AS bin FROM l JOIN e USING (scenario, col) WHERE v IS NOT NULL),
n AS (SELECT e.scenario, e.col, g.bin, count(*) FILTER (b.win = 'current') AS c, count(*) FILTER (b.win = 'reference') AS r FROM e CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.scenario = e.scenario AND b.col = e.col AND b.bin = g.bin GROUP BY ALL),
s AS (SELECT scenario, col, greatest(c / sum(c) OVER (PARTITION BY scenario, col), 0.0001) AS p, greatest(r / sum(r) OVER (PARTITION BY scenario, col), 0.0001) AS q FROM n),
x AS (SELECT scenario, col, sum((p - q) * ln(p / q)) AS psi FROM s GROUP BY ALL),
o AS (SELECT scenario, avg((psi >= 0.3)::INT) FILTER (col <> 'p') AS drift_share, max(psi) FILTER (col <> 'p') AS largest_psi, max(psi) FILTER (col = 'p') AS prediction_psi FROM x GROUP BY 1),
a AS (SELECT scenario, win, (sum(m) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc, avg(y) AS rate, count(*) AS n
  FROM (SELECT *, rank() OVER (PARTITION BY scenario, win ORDER BY p) + (count(*) OVER (PARTITION BY scenario, win, p) - 1) / 2 AS m FROM w) GROUP BY ALL),
t AS (SELECT o.*, abs(c.rate - r.rate) AS calibration_delta, z.auc - c.auc AS auc_drop, c.n AS n_current FROM o JOIN a c ON c.scenario = o.scenario AND c.win = 'current' JOIN a r ON r.scenario = o.scenario AND r.win = 'reference' JOIN a z ON z.scenario = 'nothing' AND z.win = 'reference')
SELECT *, CASE WHEN drift_share >= 0.75 OR prediction_psi >= 0.3 OR calibration_delta > 0.1 OR (n_current >= 30 AND auc_drop > 0.1) THEN 'retrain' WHEN largest_psi >= 0.1 THEN 'investigate' ELSE 'healthy' END AS verdict FROM t"""


@query(with_tables(sql_rounded(_signals_sql(), ["drift_share", "largest_psi", "prediction_psi", "calibration_delta", "auc_drop"]), "match_events"))
def drift_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of features and predictions, calibration delta and AUC drop as measured, where nothing
    changes, one feature moves, or one of the four triggers fires."""
    t = Tables(spark, sf_dir)
    base = t.stored(windows(spark, sf_dir).withColumnRenamed("window", "win").selectExpr(*_SCORED).selectExpr(*_LABELLED).withColumn("is_current", F.col("win") == "current"))
    pinned = ev.auc_table(base.where("NOT is_current"), "y", "p").first()[0]
    out = None
    for scenario in SCENARIOS:
        columns, kept = _changed(scenario)
        rows = base.where(kept).selectExpr(*columns).withColumnRenamed("win", "window")
        one = ev.drift_signals(rows, RATE_COLS, "y", "p", F.lit(pinned)).select(F.lit(scenario).alias("scenario"), "*")
        out = one if out is None else out.union(one)
    return rounded(out)


@query(with_tables("SELECT match_id, 'not complementary' AS issue FROM d GROUP BY 1 HAVING abs(sum(base) - 1) > 1e-6", "pm", more={"d": _PREDS}))
def scored_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of predictions that aren't complementary."""
    return ev.scored_violations(directional_predictions(spark, sf_dir).withColumnRenamed("base", "p_win"))


@query(with_tables("SELECT match_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT match_id, pow(0.5::DOUBLE, (DATE '2001-08-01' - match_date) / 1461) AS w FROM match_events)", "match_events"))
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K29 (extension)."""
    return rounded(ev.recency_weights(Tables(spark, sf_dir).events, "match_date", F.lit("2001-08-01").cast("date")).select("match_id", "weight"))


@query(
    "WITH h AS (SELECT event_type, value, ts < (SELECT quantile_disc(ts, 0.5) FROM events) AS early FROM events) SELECT event_type, count(*) FILTER (WHERE early) AS n_early, count(*) FILTER (WHERE NOT early) AS n_late FROM h GROUP BY 1"
)
def event_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K24 on the event stream: counts of both time halves by type."""
    e = Tables(spark, sf_dir).raw("events")
    e = e.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    half = F.broadcast(exact_quantile(e, "__t", 0.5).withColumnRenamed("quantile", "__half"))  # one row
    rows = e.crossJoin(half)
    return rows.groupBy("event_type").agg(F.count_if(F.col("__t") < F.col("__half")).alias("n_early"), F.count_if(F.col("__t") >= F.col("__half")).alias("n_late"))


