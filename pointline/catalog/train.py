"""Queries of fits, selection, alignment and promotion, and of small filters, windows and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import identity, incremental, intervals
from ..operators.ordered import read_ordered, write_ordered
from ..plans import boosting, models
from ..plans import evaluation as ev
from ..schemas import FEATURE_COLS
from ..sources import files
from .base import Tables, rounded
from .evaluate import _FOLDS
from .ingest import shared_path
from .serve import player_names, source_names
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


#: Two stand-in models' probabilities of each directional row: right for four rows of five, and too
#: timid. Spark and DuckDB read the same text.
_N = "(CAST(match_id AS BIGINT) * 31 + CAST(substr(player_id, 2, 9) AS BIGINT) * 17)"
_MODELS = (
    "match_id", "match_date", "surface", "player_id", "opponent_id", "match_won",
    f"CAST(0.5 AS DOUBLE) + (match_won - CAST(0.5 AS DOUBLE)) * (CASE WHEN {_N} % 5 < 4 THEN 1 ELSE -1 END) * CAST(0.2 AS DOUBLE) + ({_N} % 97 - 48) / CAST(480 AS DOUBLE) AS a",
    f"CAST(0.5 AS DOUBLE) + (match_won - CAST(0.5 AS DOUBLE)) * (CASE WHEN {_N} % 7 < 5 THEN 1 ELSE -1 END) * CAST(0.4 AS DOUBLE) + ({_N} % 89 - 44) / CAST(480 AS DOUBLE) AS b",
)
_PREDICTED = f"SELECT {', '.join(_MODELS)} FROM pm"
_LOWER = f"SELECT p.*, match_won AS y, fold FROM ({_PREDICTED}) p JOIN ({_FOLDS}) f USING (match_id) WHERE player_id < opponent_id AND fold > 0"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).matches.selectExpr(*_MODELS)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.assign_folds(Tables(spark, sf_dir).matches, "match_id", "match_date", 5)


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the events of folds 1 to 5 at their smaller id, with label and fold."""
    rows = predicted(spark, sf_dir).where("player_id < opponent_id").withColumn("y", F.col("match_won"))
    return rows.join(folds(spark, sf_dir).select("match_id", "fold"), "match_id").where("fold > 0")


def _log_loss(p: str, y: str = "y") -> str:
    return f"-({y} * ln({p}) + (1 - {y}) * ln(1 - {p}))"


#: Faults planted in the predictions that are aligned with labels: rows lost, given twice, of no event, with the other label.
_FAULTS = "SELECT match_id, player_id, match_won FROM l WHERE k % 41 <> 0 AND k % 53 <> 0 UNION ALL SELECT match_id, player_id, match_won FROM l WHERE k % 43 = 0 UNION ALL SELECT concat('X', match_id), player_id, match_won FROM l WHERE k % 47 = 0 UNION ALL SELECT match_id, player_id, 1 - match_won FROM l WHERE k % 53 = 0 AND k % 41 <> 0"
_LABELS = "SELECT match_id, player_id, match_won, CAST(match_id AS BIGINT) AS k FROM pm"


@query(
    with_tables(
        "SELECT match_id, player_id, CASE WHEN coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 THEN 'repeated' WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'unexpected' ELSE 'differs' END AS issue FROM (SELECT match_id, player_id, count(*) AS n, max(match_won) AS w FROM p GROUP BY 1, 2) a FULL JOIN (SELECT match_id, player_id, count(*) AS n, max(match_won) AS w FROM l GROUP BY 1, 2) b USING (match_id, player_id) WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1 OR a.w <> b.w",
        "pm",
        more={"l": _LABELS, "p": _FAULTS},
    )
)
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that don't meet their labels one to one, with faults planted."""
    labels = Tables(spark, sf_dir).matches.selectExpr("match_id", "player_id", "match_won", "CAST(match_id AS BIGINT) AS k")
    k = F.col("k")
    given = labels.where((k % 41 != 0) & (k % 53 != 0)).unionByName(labels.where(k % 43 == 0)).unionByName(labels.where(k % 47 == 0).withColumn("match_id", F.concat(F.lit("X"), "match_id")))
    given = given.unionByName(labels.where((k % 53 == 0) & (k % 41 != 0)).withColumn("match_won", 1 - F.col("match_won")))
    return ev.alignment_issues(given.drop("k"), labels.drop("k"), ["match_id", "player_id"], ["match_won"])


@query(with_tables("SELECT match_id, player_id, match_won, fold FROM pm JOIN f USING (match_id)", "pm", "match_events", more={"f": _FOLDS}))
def aligned_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and fold numbers joined one to one, which raises where they don't match so."""
    rows = Tables(spark, sf_dir).matches.select("match_id", "player_id", "match_won")
    each = rows.select("match_id", "player_id").join(folds(spark, sf_dir).select("match_id", "fold"), "match_id")
    return ev.aligned(rows, each, ["match_id", "player_id"]).select("match_id", "player_id", "match_won", "fold")


@query(with_tables("SELECT match_id, CASE WHEN k % 43 = 0 AND k % 37 <> 0 THEN 'repeated' WHEN k % 37 = 0 THEN 'missing' ELSE 'differs' END AS issue FROM (SELECT *, CAST(match_id AS BIGINT) AS k FROM f) WHERE k % 43 = 0 OR k % 37 = 0 OR k % 41 = 0", "match_events", more={"f": _FOLDS}))
def stale_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored folds, read back and held against fresh ones; events lost, repeated and moved are planted."""
    fresh, k, path = folds(spark, sf_dir), F.col("match_id").cast("long"), shared_path(spark, "folds")
    moved = fresh.where(k % 37 != 0).withColumn("fold", F.when(k % 41 == 0, (F.col("fold") + 1) % 6).otherwise(F.col("fold")))
    moved.unionByName(moved.where(k % 43 == 0)).write.parquet(path)
    return ev.alignment_issues(spark.read.parquet(path), fresh, ["match_id"], ["match_date", "fold"])


@query(with_tables("SELECT match_id, CASE WHEN k % 31 = 0 THEN 'missing side' WHEN k % 37 = 0 THEN 'missing winner' WHEN k % 41 = 0 THEN 'won by neither' ELSE 'won by both' END AS issue FROM (SELECT match_id, CAST(match_id AS BIGINT) AS k FROM match_events) WHERE k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0", "match_events"))
def winner_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without exactly one winner, with faults of each kind planted."""
    k = F.col("match_id").cast("long")
    e = Tables(spark, sf_dir).events.select("match_id", "player1_id", "player2_id", "winner_id")
    e = e.withColumn("winner_id", F.when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, F.lit("nobody")).otherwise(F.col("winner_id")))
    e = e.withColumn("player2_id", F.when(k % 31 == 0, F.lit(None)).when((k % 43 == 0) & (k % 37 != 0) & (k % 41 != 0), F.col("player1_id")).otherwise(F.col("player2_id")))
    return ev.label_issues(e)


_GRID = "SELECT 0.05::DOUBLE * pow(400::DOUBLE, i / 23::DOUBLE) AS t FROM range(24) r(i) UNION ALL SELECT 1.0"
_SCALED = "1 / (1 + exp(-t * ln(a / (1 - a))))"


@query(
    with_tables(
        sql_rounded(f"SELECT fold, n, t AS temperature, raw_log_loss, scaled_log_loss FROM (SELECT r.fold, t, count(*) AS n, avg({_log_loss('a')}) AS raw_log_loss, avg({_log_loss('q')}) AS scaled_log_loss FROM (SELECT r.*, t, {_SCALED} AS q FROM r JOIN best USING (fold)) r GROUP BY 1, 2)", ["temperature", "raw_log_loss", "scaled_log_loss"]),
        "pm", "match_events",
        more={"r": _LOWER, "g": _GRID, "best": f"SELECT fold, arg_min(t, loss) AS t FROM (SELECT f.fold, t, avg({_log_loss('q')}) AS loss FROM (SELECT DISTINCT fold FROM r WHERE fold > 1) f JOIN (SELECT fold AS earlier, y, t, {_SCALED} AS q FROM r, g) x ON earlier < f.fold GROUP BY 1, 2) GROUP BY 1"},
    )
)
def walk_forward_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's temperature, fitted on the folds before it over one grid of 24 points and 1."""
    t = Tables(spark, sf_dir)
    pooled = ev.walk_forward(t.stored(validated(spark, sf_dir)), "y", "a", "fold", rounds=1)
    loss = lambda c: F.avg(ev.loss(F.col("y"), F.col(c)))
    return rounded(pooled.groupBy("fold", "temperature").agg(F.count("*").alias("n"), loss("raw").alias("raw_log_loss"), loss("scaled").alias("scaled_log_loss")))


#: A third stand-in model, as sure as it is right: no temperature betters it.
_MODELS_3 = (*_MODELS, f"CAST(0.5 AS DOUBLE) + (match_won - CAST(0.5 AS DOUBLE)) * (CASE WHEN {_N} % 5 < 4 THEN 1 ELSE -1 END) * CAST(0.6 AS DOUBLE) AS c")
_LONG = f"SELECT model, q AS a, match_won AS y, fold FROM (SELECT match_id, player_id, opponent_id, match_won, unnest(['a', 'b', 'c']) AS model, unnest([a, b, c]) AS q FROM (SELECT {', '.join(_MODELS_3)} FROM pm)) JOIN ({_FOLDS}) f USING (match_id) WHERE player_id < opponent_id AND fold > 0"
_ACCEPTED = "scaled_log_loss < raw_log_loss AND scaled_brier < raw_brier + 0.001::DOUBLE"


@query(
    with_tables(
        sql_rounded(
            f"""SELECT model, t AS fitted_temperature, CASE WHEN {_ACCEPTED} THEN t ELSE 1 END AS temperature, {_ACCEPTED} AS accepted, raw_log_loss, scaled_log_loss, raw_brier, scaled_brier
FROM (SELECT model, avg({_log_loss('a')}) AS raw_log_loss, avg({_log_loss('q')}) AS scaled_log_loss, avg((y - a) * (y - a)) AS raw_brier, avg((y - q) * (y - q)) AS scaled_brier
  FROM (SELECT r.*, {_SCALED} AS q FROM r JOIN best USING (model, fold)) GROUP BY 1) JOIN whole USING (model)""",
            ["fitted_temperature", "temperature", "raw_log_loss", "scaled_log_loss", "raw_brier", "scaled_brier"],
        ),
        "pm", "match_events",
        more={
            "r": _LONG, "g": _GRID, "losses": f"SELECT model, fold, t, sum({_log_loss('q')}) AS loss, count(*) AS n FROM (SELECT model, fold, y, t, {_SCALED} AS q FROM r, g) GROUP BY 1, 2, 3",
            "best": "SELECT model, fold, arg_min(t, loss) AS t FROM (SELECT model, f.fold, t, sum(loss) / sum(n) AS loss FROM (SELECT DISTINCT fold FROM r WHERE fold > 1) f JOIN losses l ON l.fold < f.fold GROUP BY 1, 2, 3) GROUP BY 1, 2",
            "whole": "SELECT model, arg_min(t, loss) AS t FROM (SELECT model, t, sum(loss) / sum(n) AS loss FROM losses GROUP BY 1, 2) GROUP BY 1",
        },
    )
)
def temperature_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of three models takes its fitted temperature, by pooled log loss and the Brier guard."""
    t = Tables(spark, sf_dir)
    rows = t.matches.selectExpr(*_MODELS_3).where("player_id < opponent_id").withColumn("y", F.col("match_won"))
    rows = t.stored(rows.join(folds(spark, sf_dir).select("match_id", "fold"), "match_id").where("fold > 0"))
    names = ("fitted_temperature", "temperature", "accepted", "raw_log_loss", "scaled_log_loss", "raw_brier", "scaled_brier")
    picked = [(m, ev.select_temperature(rows, "y", m, "fold", rounds=1)) for m in ("a", "b", "c")]
    out = spark.createDataFrame([(m, *[got[n] for n in names]) for m, got in picked], "model string, " + ", ".join(f"{n} {'boolean' if n == 'accepted' else 'double'}" for n in names))
    return rounded(out)


_AUC = "(sum(rk) FILTER (WHERE y = 1) - (count(*) FILTER (WHERE y = 1)) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0)"


def _group_sql(p: str) -> str:
    return f"SELECT fold, surface, avg({_log_loss('p')}) AS loss, {_AUC} AS auc FROM (SELECT *, rank() OVER (PARTITION BY fold, surface ORDER BY p) + (count(*) OVER (PARTITION BY fold, surface, p) - 1) / 2.0::DOUBLE AS rk FROM (SELECT *, {p} AS p FROM r)) GROUP BY 1, 2"


@query(
    with_tables(
        sql_rounded("SELECT fold, surface, c.loss AS candidate_log_loss, c.auc AS candidate_auc, o.loss AS production_log_loss, o.auc AS production_auc, coalesce((c.loss < o.loss AND c.auc >= o.auc - 0.01::DOUBLE) OR (c.auc > o.auc AND c.loss <= o.loss + 0.01::DOUBLE), false) AS promote FROM c JOIN o USING (fold, surface)", ["candidate_log_loss", "candidate_auc", "production_log_loss", "production_auc"]),
        "pm", "match_events",
        more={"r": _LOWER, "c": _group_sql("a"), "o": _group_sql("b")},
    )
)
def promotion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether model a would replace model b, for each fold and surface."""
    rows, by = Tables(spark, sf_dir).stored(validated(spark, sf_dir)), ["fold", "surface"]
    sides = [
        rows.groupBy(*by).agg(F.avg(ev.loss(F.col("y"), F.col(m))).alias(f"{n}_log_loss")).join(ev.auc_table(rows, "y", m, by).withColumnRenamed("roc_auc", f"{n}_auc"), by)
        for m, n in (("a", "candidate"), ("b", "production"))
    ]
    both = sides[0].join(sides[1], by)
    promote = ev.improves(*[F.col(c) for c in ("candidate_log_loss", "candidate_auc", "production_log_loss", "production_auc")])
    return rounded(both.withColumn("promote", F.coalesce(promote, F.lit(False))))


def _newton(steps: int) -> dict[str, str]:
    """Newton steps of each fold's two weights on the other folds' evidence, as one table each."""
    out = {"w0": "SELECT DISTINCT fold, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM e"}
    for i in range(steps):
        sums = "sum((p - y) * a) + any_value(u) AS g, sum((p - y) * b) + any_value(v) AS h, sum(p * (1 - p) * a * a) + 1 AS aa, sum(p * (1 - p) * a * b) AS ab, sum(p * (1 - p) * b * b) + 1 AS bb, any_value(u) AS u, any_value(v) AS v"
        out[f"w{i + 1}"] = f"SELECT fold, u - (bb * g - ab * h) / (aa * bb - ab * ab) AS u, v - (aa * h - ab * g) / (aa * bb - ab * ab) AS v FROM (SELECT fold, {sums} FROM (SELECT w.fold, y, a, b, u, v, 1 / (1 + exp(-(u * a + v * b))) AS p FROM e JOIN w{i} w ON e.fold <> w.fold) GROUP BY 1)"
    return out


def _evidence(m: str) -> str:
    return f"(ln(x.{m} / (1 - x.{m})) - ln(z.{m} / (1 - z.{m}))) / 2 AS {m}"


@query(
    with_tables(
        sql_rounded(f"SELECT fold, count(*) AS n, avg(p) AS mean_p, avg({_log_loss('p')}) AS log_loss FROM (SELECT e.fold, y, 1 / (1 + exp(-(u * a + v * b))) AS p FROM e JOIN w8 USING (fold)) GROUP BY 1", ["mean_p", "log_loss"], 5),
        "pm", "match_events",
        more={"d": _PREDICTED, "e": f"SELECT f.fold, x.match_won AS y, {_evidence('a')}, {_evidence('b')} FROM d x JOIN d z ON x.match_id = z.match_id AND x.player_id = z.opponent_id JOIN ({_FOLDS}) f ON f.match_id = x.match_id WHERE x.player_id < x.opponent_id AND fold > 0"} | _newton(8),
    )
)
def stacked_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's stacked probabilities by weights that the other folds give."""
    t = Tables(spark, sf_dir)
    pairs = ev.evidence_pairs(predicted(spark, sf_dir), ["a", "b"]).join(folds(spark, sf_dir).select("match_id", "fold"), "match_id").where("fold > 0")
    scored = models.cross_fitted(t.stored(pairs), ["a", "b"])
    return rounded(scored.groupBy("fold").agg(F.count("*").alias("n"), F.avg("p_win").alias("mean_p"), F.avg(ev.loss(F.col("match_won"), F.col("p_win"))).alias("log_loss")), 5)


_SPLIT = "SELECT match_id, player_id, CASE WHEN match_date <= lo + floor((hi - lo) * 0.96::DOUBLE)::INT THEN 'train' WHEN match_date <= lo + floor((hi - lo) * 0.98::DOUBLE)::INT THEN 'val' ELSE 'test' END AS split FROM pm, (SELECT min(match_date) AS lo, max(match_date) AS hi FROM pm)"


@query(with_tables("SELECT family, match_id, player_id, true AS in_range, true AS learned FROM s, (SELECT unnest(['linear', 'gbdt', 'nn']) AS family) WHERE split = 'test'", "pm", more={"s": _SPLIT}))
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7-K9: linear, boosted (stopped early on the validation part) and network fits score the test
    part. ``learned``: the fit's training loss is below a coin's."""
    t = Tables(spark, sf_dir)
    rows = t.stored(ev.chronological_split(t.features, "match_date").withColumn("is_val", F.col("split") == "val"))
    settings = {"linear": {"maxIter": 10}, "gbdt": {"maxIter": 5, "maxDepth": 3, "early": True}, "nn": {"hidden": (8,), "maxIter": 30}}
    out = None
    for family, params in settings.items():
        learn = rows.where("split <> 'test'") if params.get("early") else rows.where("split = 'train'")
        fit = models.FAMILIES[family](params).fit(learn)
        train = models.predict(fit, rows.where("split = 'train'"), "p")
        learned = F.broadcast(train.agg((F.avg(ev.loss(F.col("match_won"), F.col("p"))) < F.ln(F.lit(2.0))).alias("learned")))  # one row
        part = models.predict(fit, rows.where("split = 'test'"), "p").crossJoin(learned).select(F.lit(family).alias("family"), "match_id", "player_id", F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("in_range"), "learned")
        out = part if out is None else out.union(part)
    return out


@query()
def boosted_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: first-order boosted trees and second-order ones on histograms, both stopped early by the
    validation part and compared by its log loss. Fits aren't SQL's; tests hold the second family against numpy."""
    t = Tables(spark, sf_dir)
    rows = t.stored(ev.chronological_split(t.features, "match_date").withColumn("is_val", F.col("split") == "val").where("split <> 'test'"))
    first = models.trees({"maxIter": 5, "maxDepth": 3, "early": True}).fit(rows)
    second = boosting.fit_boosted(rows, FEATURE_COLS, trees=8, depth=3, step=0.3, patience=3)
    held = rows.where("is_val")
    scored = {"first order": (first.stages[-1].getNumTrees, models.predict(first, held, "p")), "second order": (len(second.trees), held.withColumn("p", boosting.boosted_probability(second)))}
    out = None
    for family, (trees, part) in scored.items():
        row = part.agg(F.count("*").alias("n"), F.avg(ev.loss(F.col("match_won"), F.col("p"))).alias("log_loss")).select(F.lit(family).alias("family"), F.lit(trees).alias("trees"), "n", "log_loss")
        out = row if out is None else out.union(row)
    out = t.stored(out)
    least = F.broadcast(out.agg(F.min("log_loss").alias("least")))  # one row
    return out.crossJoin(least).select("family", "trees", "n", "log_loss", (F.col("log_loss") == F.col("least")).alias("chosen"))


_BAYES = f"""SELECT match_id, player_id, round(1 / (1 + exp(max(score) FILTER (c = 0) - max(score) FILTER (c = 1))), 4) + 0.0::DOUBLE AS p FROM (
  SELECT z.match_id, z.player_id, g.c, any_value(prior) + sum(-0.5::DOUBLE * (ln(2 * pi() * sg) + (z.v - mu) * (z.v - mu) / sg)) AS score
  FROM scaled z JOIN g USING (i) JOIN priors ON priors.c = g.c WHERE z.match_date > DATE '2001-01-01' GROUP BY z.match_id, z.player_id, g.c) GROUP BY match_id, player_id"""


@query(
    with_tables(
        _BAYES,
        "mf",
        more={
            "cells": f"SELECT match_id, player_id, match_date, match_won, unnest(range({len(FEATURE_COLS)})) AS i, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLS)}]) AS v FROM mf",
            "scaled": "SELECT match_id, player_id, match_date, match_won, i, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS v FROM cells JOIN (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM cells WHERE match_date <= DATE '2001-01-01' GROUP BY i) USING (i)",
            "g": "SELECT match_won AS c, i, avg(v) AS mu, var_pop(v) + (SELECT 1e-9 * max(q) FROM (SELECT var_pop(v) AS q FROM scaled WHERE match_date <= DATE '2001-01-01' GROUP BY i)) AS sg FROM scaled WHERE match_date <= DATE '2001-01-01' GROUP BY ALL",
            "priors": "SELECT match_won AS c, ln(count(*)) AS prior FROM mf WHERE match_date <= DATE '2001-01-01' GROUP BY 1",
        },
    )
)
def bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on scaled features of early events scores each later row; SQL fits the same model."""
    t = Tables(spark, sf_dir)
    rows = t.stored(t.features.select("match_id", "player_id", "opponent_id", "match_date", "match_won", *FEATURE_COLS))
    fit = models.linear({"family": "bayes"}).fit(rows.where("match_date <= '2001-01-01'"))
    scored = models.predict(fit, rows.where("match_date > '2001-01-01'"), "p")
    return rounded(scored.select("match_id", "player_id", "p"), 4)


@query(with_tables("SELECT trial, n, true AS finite, trial = 1 AS is_first FROM (SELECT unnest([1, 2, 3, 4]) AS trial), (SELECT count(*) AS n FROM s WHERE split = 'val')", "pm", more={"s": _SPLIT}))
def search_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of settings without repeats, each scored on every validation row, best first."""
    t = Tables(spark, sf_dir)
    rows = t.stored(ev.chronological_split(t.features, "match_date"))
    space = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5], "maxIter": [5]}
    got = models.trials("linear", space, 12, rows.where("split = 'train'"), rows.where("split = 'val'"))
    best = sorted(got, key=lambda r: r[1]["log_loss"])[:4]
    table = spark.createDataFrame([(i, m["n"], m["log_loss"]) for i, (_, m) in enumerate(best, 1)], "trial int, n long, log_loss double")
    least = F.broadcast(table.agg(F.min("log_loss").alias("least")))
    return table.crossJoin(least).select("trial", "n", fn.is_finite(F.col("log_loss")).alias("finite"), (F.col("log_loss") == F.col("least")).alias("is_first"))


#: Settings of a search that SQL can repeat: naive Bayes on parts of the features.
_PARTS = {"first five": FEATURE_COLS[:5], "next ten": FEATURE_COLS[5:15], "last twenty": FEATURE_COLS[-20:], "every third": FEATURE_COLS[::3]}


@query(
    with_tables(
        sql_rounded(
            f"""SELECT setting, count(*) AS n, avg({_log_loss('p', 'match_won')}) AS log_loss, row_number() OVER (ORDER BY avg({_log_loss('p', 'match_won')})) = 1 AS chosen FROM (
  SELECT setting, match_id, player_id, any_value(match_won) AS match_won, greatest(least(1 / (1 + exp(max(score) FILTER (c = 0) - max(score) FILTER (c = 1))), 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS p FROM (
    SELECT o.setting, z.match_id, z.player_id, any_value(z.match_won) AS match_won, g.c, any_value(prior) + sum(-0.5::DOUBLE * (ln(2 * pi() * sg) + (z.v - mu) * (z.v - mu) / sg)) AS score
    FROM scaled z JOIN g USING (i) JOIN o USING (i) JOIN priors ON priors.c = g.c WHERE z.split = 'val' GROUP BY o.setting, z.match_id, z.player_id, g.c) GROUP BY 1, 2, 3) GROUP BY 1""",
            ["log_loss"], 4,
        ),
        "pm", "mf",
        more={
            "s": _SPLIT,
            "o": "SELECT unnest(" + repr([name for name, part in _PARTS.items() for _ in part]) + ") AS setting, unnest(" + repr([FEATURE_COLS.index(c) for part in _PARTS.values() for c in part]) + ") AS i",
            "cells": f"SELECT match_id, player_id, split, match_won, unnest(range({len(FEATURE_COLS)})) AS i, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLS)}]) AS v FROM mf JOIN s USING (match_id, player_id)",
            "scaled": "SELECT match_id, player_id, split, match_won, i, CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END AS v FROM cells JOIN (SELECT i, avg(v) AS m, stddev_samp(v) AS sd FROM cells WHERE split = 'train' GROUP BY i) USING (i)",
            "g": "SELECT match_won AS c, i, avg(v) AS mu, var_pop(v) + (SELECT 1e-9 * max(q) FROM (SELECT var_pop(v) AS q FROM scaled WHERE split = 'train' GROUP BY i)) AS sg FROM scaled WHERE split = 'train' GROUP BY ALL",
            "priors": "SELECT match_won AS c, ln(count(*)) AS prior FROM cells WHERE split = 'train' AND i = 0 GROUP BY 1",
        },
    )
)
def search_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting that a seeded search tries, with its validation loss and whether it is chosen; SQL fits them all."""
    t = Tables(spark, sf_dir)
    rows = t.stored(ev.chronological_split(t.features, "match_date"))
    got = models.trials("linear", {"family": ["bayes"], "columns": list(_PARTS.values())}, 40, rows.where("split = 'train'"), rows.where("split = 'val'"))
    least = min(m["log_loss"] for _, m in got)
    names = {tuple(part): name for name, part in _PARTS.items()}
    table = [(names[tuple(params["columns"])], m["n"], m["log_loss"], m["log_loss"] == least) for params, m in got]
    return rounded(spark.createDataFrame(table, "setting string, n long, log_loss double, chosen boolean"), 4)


@query(with_tables("SELECT match_id, player_id, fold, true AS in_range FROM pm JOIN f USING (match_id) WHERE fold > 0", "pm", "match_events", more={"f": _FOLDS}))
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of folds 1 to 5, scored by a fit on the bands before its own."""
    t = Tables(spark, sf_dir)
    scored = models.out_of_fold(t.features, folds(spark, sf_dir), "linear", {"maxIter": 5}, "p")
    return scored.select("match_id", "player_id", "fold", F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("in_range"))


@query(
    with_tables(
        """SELECT match_id, player_id, any_value(fold) AS fold, round(1 / (1 + exp(max(score) FILTER (c = 0) - max(score) FILTER (c = 1))), 4) + 0.0::DOUBLE AS p FROM (
  SELECT z.match_id, z.player_id, z.fold, g.c, any_value(prior) + sum(-0.5::DOUBLE * (ln(2 * pi() * sg) + (z.v - mu) * (z.v - mu) / sg)) AS score
  FROM scaled z JOIN g ON g.k = z.k AND g.i = z.i JOIN priors q ON q.c = g.c AND q.k = g.k WHERE z.fold = z.k GROUP BY z.match_id, z.player_id, z.fold, g.c) GROUP BY match_id, player_id""",
        "mf", "match_events",
        more={
            "f": _FOLDS,
            "cells": f"SELECT match_id, player_id, fold, match_won, unnest(range({len(FEATURE_COLS)})) AS i, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURE_COLS)}]) AS v FROM mf JOIN f USING (match_id)",
            "seen": "SELECT k, cells.* FROM cells JOIN (SELECT DISTINCT fold AS k FROM f WHERE fold > 0) ON fold <= k",
            "scaled": "SELECT match_id, player_id, fold, match_won, k, i, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS v FROM seen JOIN (SELECT k, i, avg(v) AS m, stddev_samp(v) AS s FROM seen WHERE fold < k GROUP BY 1, 2) USING (k, i)",
            "g": "SELECT match_won AS c, x.k, i, avg(v) AS mu, var_pop(v) + any_value(e) AS sg FROM scaled x JOIN (SELECT k, 1e-9 * max(q) AS e FROM (SELECT k, i, var_pop(v) AS q FROM scaled WHERE fold < k GROUP BY 1, 2) GROUP BY 1) y ON y.k = x.k WHERE fold < x.k GROUP BY 1, 2, 3",
            "priors": "SELECT match_won AS c, k, ln(count(*)) AS prior FROM scaled WHERE fold < k AND i = 0 GROUP BY 1, 2",
        },
    )
)
def out_of_fold_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold scored by naive Bayes on features scaled and fitted on the earlier bands alone; SQL fits the same models."""
    t = Tables(spark, sf_dir)
    rows = t.features.select("match_id", "player_id", "opponent_id", "match_won", *FEATURE_COLS)
    scored = models.out_of_fold(rows, folds(spark, sf_dir), "linear", {"family": "bayes"}, "p")
    return rounded(scored.select("match_id", "player_id", "fold", "p"), 4)


@query()
def fuzzy_identity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sources write the players' names, by difflib's ratio of 0.8, which SQL hasn't; tested against brute force."""
    return rounded(identity.match_names(source_names(spark, sf_dir), player_names(spark, sf_dir), identity.activity(Tables(spark, sf_dir).events)))


@query(with_tables(sql_rounded(f"SELECT least(floor(a * 10), 9)::BIGINT AS bin, avg(a) AS mean_p, avg(y) AS rate, count(*) AS n FROM r GROUP BY 1", ["mean_p", "rate"]), "pm", "match_events", more={"r": _LOWER}))
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration curve over ten equal bins."""
    return rounded(ev.calibration_points(validated(spark, sf_dir), "y", "a"))


@query(with_tables("SELECT match_id, player_id, opponent_id, match_won, round(p_win, 6) AS p_win, (p_win >= 0.5)::INT AS pred FROM (SELECT *, a AS p_win FROM d)", "pm", more={"d": _PREDICTED}))
def scored_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K28."""
    return rounded(ev.scored_rows(predicted(spark, sf_dir).withColumnRenamed("a", "p_win")))


@query(with_tables("SELECT match_id, tournament FROM match_events WHERE tournament IN ('grand_slam', 'masters', 'atp_500', 'atp_250')", "match_events"))
def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the tiers that are taken in."""
    return files.eligible(Tables(spark, sf_dir).events).select("match_id", "tournament")


@query(with_tables("SELECT match_id, match_date, winner_id FROM match_events WHERE CAST(match_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)", "match_events"))
def selected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a list of ids, some given more than once and some null: those of orders with large returned items."""
    t = Tables(spark, sf_dir)
    ids = t.raw("lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("match_id"))
    return files.selected(t.events, ids.union(spark.range(1).select(F.lit(None).cast("string")))).select("match_id", "match_date", "winner_id")


@query(with_tables("SELECT match_id, player_id, match_won, row_number() OVER (ORDER BY match_date, match_id, player_id) AS position FROM pm", "pm"))
def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """directional rows written in their model's order; positions are those of the stored files."""
    path = shared_path(spark, "ordered")
    write_ordered(Tables(spark, sf_dir).matches.select("match_date", "match_id", "player_id", "match_won"), path, [F.col("match_date"), F.col("match_id"), F.col("player_id")])
    return read_ordered(spark, path).drop("match_date")


_RUN = ("o_orderkey AS k", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS s", "CASE WHEN o_orderkey % 5 < 2 THEN DATE '1997-06-01' END AS e", "CASE WHEN o_orderkey % 7 > 0 THEN DATE '1996-01-01' END AS w")


@query(f"SELECT k, a AS first, b AS last FROM (SELECT k, coalesce(s, w) AS a, coalesce(e, DATE '1998-01-01') AS b FROM (SELECT {', '.join(_RUN)} FROM orders)) WHERE a <= b")
def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a run for each mix of given start, end and watermark."""
    rows = Tables(spark, sf_dir).raw("orders").selectExpr(*_RUN)
    window = incremental.run_window(F.col("s"), F.col("e"), F.col("w"), F.lit("1998-01-01").cast("date"))
    return rows.select("k", window.alias("run")).where("run IS NOT NULL").select("k", "run.first", "run.last")


_RANGES = ("o_orderkey", "CAST(o_orderdate AS DATE) AS first_day", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS last_day")


@query(f"SELECT * FROM (SELECT {', '.join(_RANGES)} FROM orders) WHERE first_day <= DATE '1997-03-31' AND last_day >= DATE '1997-01-01'")
def ranges_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: orders of some days' length that were open in a quarter."""
    day = lambda d: F.lit(d).cast("date")
    rows = Tables(spark, sf_dir).raw("orders").selectExpr(*_RANGES)
    return identity.overlapping(rows, "first_day", "last_day", day("1997-01-01"), day("1997-03-31"))


#: Windows of each supplier: up to four months; some without a date, some that end before they begin.
_WINDOWS = (
    "s_suppkey",
    "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey * 631 % 2400 AS INT) END AS opens",
    "CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey * 631 % 2400 + s_suppkey * 7 % 125 - 3 AS INT) END AS closes",
)
_OPEN = ("o_orderkey", "CAST(o_orderdate AS DATE) AS first_day", "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS last_day")


@query(f"SELECT * FROM (SELECT {', '.join(_OPEN)} FROM orders) JOIN (SELECT {', '.join(_WINDOWS)} FROM supplier) ON first_day <= closes AND last_day >= opens")
def ranges_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: orders that were open in each supplier's window; ranges without a date are in none."""
    t = Tables(spark, sf_dir)
    return intervals.overlap_join(t.raw("orders").selectExpr(*_OPEN), t.raw("supplier").selectExpr(*_WINDOWS), ("first_day", "last_day"), ("opens", "closes"))


@query(with_tables("SELECT year(match_date) AS part, match_id, match_date, winner_id FROM match_events", "match_events"))
def appended_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping, repeating batches appended to an archive by year hold each event once."""
    e, path = Tables(spark, sf_dir).events.select("match_id", "match_date", "winner_id"), shared_path(spark, "archive")
    k, order = F.col("match_id").cast("long"), ["match_date", "match_id"]
    first = e.where(k % 3 != 0)
    files.append_new(path, first.union(first.where(k % 5 == 0)), None, ["match_id"], F.year("match_date"), order)
    files.append_new(path, e.where(k % 3 != 1), spark.read.parquet(path), ["match_id"], F.year("match_date"), order)
    return spark.read.parquet(path).select("part", "match_id", "match_date", "winner_id")


@query(
    "SELECT o_orderkey, printf('%.1f%%', (o_orderkey % 1000) / 10) AS share, CASE WHEN o_orderkey % 1000 > 0 THEN round(1000.0::DOUBLE / (o_orderkey % 1000), 2) END AS odds, CASE WHEN o_orderkey % 41 > 20 THEN '+' ELSE '' END || printf('%.1f', (o_orderkey % 41 - 20)::DOUBLE) AS delta, sha256(o_orderkey::VARCHAR || chr(31) || o_orderstatus || chr(31) || o_custkey::VARCHAR) AS record FROM orders"
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent, odds and signed texts, and a hash of each record."""
    k = F.col("o_orderkey")
    p = (k % 1000) / 1000
    return Tables(spark, sf_dir).raw("orders").select("o_orderkey", fn.percent(p).alias("share"), fn.decimal_odds(p).alias("odds"), fn.signed_text((k % 41 - 20).cast("double")).alias("delta"), fn.record_hash(k, F.col("o_orderstatus"), F.col("o_custkey")).alias("record"))


@query(with_tables("SELECT name, n FROM (SELECT 'matches' AS name, count(*) AS n FROM pm UNION ALL SELECT 'profiles', count(*) FROM player_profiles UNION ALL SELECT 'rankings', count(*) FROM rankings)", "pm", "player_profiles", "rankings"))
def published_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables published together; a second version that fails its check changes nothing."""
    t, root = Tables(spark, sf_dir), shared_path(spark, "published")
    tables = {"matches": t.kept_matches, "profiles": t.profiles, "rankings": t.rankings}
    pairs = ("pairs", lambda s: s["matches"].groupBy("match_id").count().where("count <> 2"))
    incremental.publish_set(tables, root, "1", [pairs])
    try:
        incremental.publish_set(tables | {"matches": t.kept_matches.where("player_id < opponent_id")}, root, "2", [pairs])
    except ValueError:
        pass  # as it must: the pointer still names version 1
    out = None
    for name, df in incremental.read_set(spark, root, list(tables)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query(with_tables("SELECT DISTINCT b.match_id FROM match_events a JOIN match_events b ON least(a.player1_id, a.player2_id) = least(b.player1_id, b.player2_id) AND greatest(a.player1_id, a.player2_id) = greatest(b.player1_id, b.player2_id) AND b.match_date > a.match_date WHERE a.batch = 3", "match_events"))
def later_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings of a pair after an event of the batch that came in."""
    e = Tables(spark, sf_dir).events
    return incremental.later_meetings(e, e.where("batch = 3")).select("match_id")
