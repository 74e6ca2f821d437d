"""Splits, folds, probability metrics, calibration, promotion and drift, as jobs over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import antisymmetric_evidence, clip_probability, temperature_scaled
from ..operators.events import date_bands
from ..operators.ordered import running_totals

#: Split fractions, tolerance of promotion, drift thresholds and window bounds.
TRAIN_SHARE, VAL_SHARE = 0.96, 0.02
PROMOTION_TOLERANCE = 0.01
PSI_MODERATE, PSI_SIGNIFICANT, SHARE_LIMIT, PRED_PSI_LIMIT, CALIBRATION_LIMIT, AUC_DROP, MIN_N_AUC = 0.1, 0.3, 0.75, 0.3, 0.1, 0.1, 30
REF_MIN, REF_MAX = 30, 10_000


def chronological_split(rows: DataFrame, date: str, train: float = TRAIN_SHARE, val: float = VAL_SHARE) -> DataFrame:
    """Add split: train, val or test by fractions of the span of dates; one date is never split."""
    span = F.broadcast(rows.agg(F.min(date).alias("__lo"), F.max(date).alias("__hi")))
    days = F.datediff("__hi", "__lo")
    cut = lambda share: F.date_add("__lo", F.floor(days * F.lit(share)).cast("int"))
    split = F.when(F.col(date) <= cut(train), "train").when(F.col(date) <= cut(train + val), "val").otherwise("test")
    return rows.crossJoin(span).withColumn("split", split).drop("__lo", "__hi")


def split_summary(rows: DataFrame, event: str, date: str) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct(event).alias("n_events"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def assign_folds(rows: DataFrame, event: str, date: str, folds: int) -> DataFrame:
    """One row per event with its band: 0 is never validated, 1 to ``folds`` are the folds."""
    bands = F.broadcast(date_bands(rows, date, folds + 1))  # folds + 1 rows
    events = rows.select(event, date).dropDuplicates([event])
    return events.join(bands, (F.col(date) >= F.col("first")) & (F.col(date) <= F.col("last"))).select(event, date, F.col("band").cast("int").alias("fold"))


def fold_differences(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that only one of two fold tables has."""
    return stored.exceptAll(fresh).withColumn("side", F.lit("stored")).union(fresh.exceptAll(stored).withColumn("side", F.lit("fresh")))


def alignment_issues(left: DataFrame, right: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """(keys, issue) of each key that breaks a one-to-one match of two tables: repeated on either side,
    missing from ``left``, unexpected there, or with another value in a column of ``same``.

    Both sides meet in one grouping; null keys are keys like others.
    """
    side = lambda df, i: df.select(*keys, *same, F.lit(i).alias("__side"))
    both = side(left, 0).unionByName(side(right, 1))
    of = lambda c, i: F.max(F.when(F.col("__side") == i, F.col(c)))
    g = both.groupBy(*keys).agg(F.count_if(F.col("__side") == 0).alias("__l"), F.count_if(F.col("__side") == 1).alias("__r"), *[of(c, i).alias(f"__{i}{c}") for c in same for i in (0, 1)])
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"__0{c}").eqNullSafe(F.col(f"__1{c}"))
    issue = F.when((F.col("__l") > 1) | (F.col("__r") > 1), "repeated").when(F.col("__l") == 0, "missing").when(F.col("__r") == 0, "unexpected").when(differs, "differs")
    return g.withColumn("issue", issue).where("issue IS NOT NULL").select(*keys, "issue")


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables joined one to one; raises where they don't match so."""
    found = [f"{r['count']} {r['issue']}" for r in alignment_issues(left, right, keys, same).groupBy("issue").count().orderBy("issue").collect()]  # at most 4 rows
    if found:
        raise ValueError(f"not aligned one to one: {', '.join(found)}")
    return left.join(right.drop(*same), list(keys))


def label_issues(events: DataFrame) -> DataFrame:
    """(match_id, issue): events whose sides are incomplete or whose winner isn't exactly one of them."""
    a, b, w = F.col("player1_id"), F.col("player2_id"), F.col("winner_id")
    issue = F.when(a.isNull() | b.isNull(), "missing side").when(w.isNull(), "missing winner").when((w == a) & (w == b), "won by both").when((w != a) & (w != b), "won by neither")
    return events.select("match_id", issue.alias("issue")).where("issue IS NOT NULL")


def evidence_pairs(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per event at the smaller id: each model's probability both ways and their evidence."""
    lower = F.col("player_id") <= F.col("opponent_id")
    aggs = [F.max(F.when(lower, F.col("player_id"))).alias("player_id"), F.max(F.when(lower, F.col("opponent_id"))).alias("opponent_id"), F.max(F.when(lower, F.col("match_won"))).alias("match_won"), F.count("*").alias("n")]
    for m in models:
        aggs += [F.max(F.when(lower, F.col(m))).alias(f"{m}_ab"), F.max(F.when(~lower, F.col(m))).alias(f"{m}_ba")]
    rows = preds.groupBy("match_id").agg(*aggs).where("n = 2").drop("n")
    return rows.withColumns({f"{m}_evidence": antisymmetric_evidence(F.col(f"{m}_ab"), F.col(f"{m}_ba")) for m in models})


def loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    q = clip_probability(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def auc_table(rows: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: mid-ranks over distinct scores, which a range sort puts in order."""
    scores = rows.groupBy(*by, F.col(p).alias("__p")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    ranked = running_totals(scores.withColumn("neg", F.col("n") - F.col("pos")), [*map(F.col, by), F.col("__p")], {"neg_below": F.col("neg")})
    # totals run over all groups: what lies before a group's first score is taken off again
    total = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.min("neg_below").alias("others"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return total.select(*by, F.try_divide(F.col("u") - F.col("others") * F.col("P"), F.col("P") * F.col("N")).alias("roc_auc"))


def gate_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    """One row: log loss, AUC, accuracy at one half and Brier score."""
    base = rows.agg(F.avg(loss(F.col(y), F.col(p))).alias("log_loss"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("brier"), F.count("*").alias("n"))
    return base.crossJoin(F.broadcast(auc_table(rows, y, p)))


def confusion(rows: DataFrame, y: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(y).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")).count()


def class_report(rows: DataFrame, y: str, pred: str) -> DataFrame:
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    c = rows.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    return c.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def calibration_error(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; the last holds 1."""
    b = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def reliability(rows: DataFrame, y: str, p: str, edges: Sequence[float] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Mean probability, outcome rate and count of right-closed bins; the first holds its lower edge."""
    bin_ = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        lower = F.col(p) >= edges[i] if i == 0 else F.col(p) > edges[i]
        bin_ = F.when(lower & (F.col(p) <= edges[i + 1]), i).otherwise(bin_)
    return rows.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(F.avg(p).alias("mean_p"), F.avg(y).alias("rate"), F.count("*").alias("n"))


def calibration_points(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean probability and outcome rate of the equal bins that hold rows; the last bin holds 1."""
    return rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("rate"), F.count("*").alias("n"))


def curve_steps(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score, from the highest: the rates at that threshold, and the recall that it adds."""
    scores = rows.groupBy(F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running_totals(scores, [F.desc("threshold")], {"tp": F.col("pos"), "seen": F.col("n")})
    whole = F.broadcast(scores.agg(F.sum("pos").alias("P"), F.sum("n").alias("all")))  # one row
    c = run.withColumn("tp", F.col("tp") + F.col("pos")).withColumn("seen", F.col("seen") + F.col("n")).crossJoin(whole)
    return c.select("threshold", F.try_divide(F.col("seen") - F.col("tp"), F.col("all") - F.col("P")).alias("fpr"), F.try_divide(F.col("tp"), F.col("P")).alias("tpr"), F.try_divide(F.col("tp"), F.col("seen")).alias("precision"), F.try_divide(F.col("pos"), F.col("P")).alias("step"))


def curve_points(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Per distinct score, from the highest: false and true positive rate, precision and recall."""
    return curve_steps(rows, y, p).drop("step")


def average_precision(rows: DataFrame, y: str, p: str) -> DataFrame:
    return curve_steps(rows, y, p).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def temperature_losses(rows: DataFrame, y: str, p: str, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Mean log loss of each temperature of a grid, in one scan."""
    each = rows.select(*by, F.col(y).alias("__y"), F.col(p).alias("__p"), F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    return each.groupBy(*by, "temperature").agg(F.avg(loss(F.col("__y"), temperature_scaled(F.col("__p"), F.col("temperature")))).alias("log_loss"))


def fit_temperature(rows: DataFrame, y: str, p: str, bounds: tuple[float, float] = (0.05, 20.0), rounds: int = 4, points: int = 24) -> float:
    """The temperature with the least log loss, by a grid refined around its best; 1 unless that is better.

    Each round is one aggregation; a one-row result comes to the driver.
    """
    lo, hi = bounds
    best, least = 1.0, None
    for _ in range(rounds):
        grid = [lo * (hi / lo) ** (i / (points - 1)) for i in range(points)]
        got = [r for r in temperature_losses(rows, y, p, [*grid, 1.0]).collect() if r.log_loss is not None]  # points + 1 rows
        if not got:
            return 1.0
        top = min(got, key=lambda r: r.log_loss)
        if least is None or top.log_loss < least:
            best, least = top.temperature, top.log_loss
        at = grid.index(min(grid, key=lambda t: abs(t - best)))
        lo, hi = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return best


def walk_forward(rows: DataFrame, y: str, p: str, fold: str, **fit) -> DataFrame:
    """(fold, temperature, y, raw, scaled): each fold but the first scaled by the fit on earlier ones.

    Band 0 has no predictions and is left out. Raises on fold numbers that aren't whole, on fewer
    than two folds, and where a fold that is scored, so any but the first, has one class only.
    ``fit`` goes to fit_temperature.
    """
    rows = rows.where(F.col(fold).isNull() | (F.col(fold) > 0))
    seen = rows.groupBy(fold).agg(F.countDistinct(y).alias("classes")).collect()  # one row per fold
    if any(r[0] is None or r[0] != int(r[0]) for r in seen):
        raise ValueError("folds must be whole numbers")
    if len(seen) < 2:
        raise ValueError("one fold leaves nothing to walk forward to")
    if any(r.classes < 2 for r in sorted(seen)[1:]):
        raise ValueError("a fold to be scored holds one class only")
    folds, pooled = sorted(r[0] for r in seen), None
    for f in folds[1:]:
        t = fit_temperature(rows.where(F.col(fold) < f), y, p, **fit)
        part = rows.where(F.col(fold) == f).select(F.col(fold).alias("fold"), F.lit(float(t)).alias("temperature"), F.col(y).alias("y"), F.col(p).alias("raw"), temperature_scaled(F.col(p), F.lit(float(t))).alias("scaled"))
        pooled = part if pooled is None else pooled.union(part)
    return pooled


def select_temperature(rows: DataFrame, y: str, p: str, fold: str, guard: float = 1e-3, **fit) -> Mapping[str, float | bool]:
    """The temperature of a fit on all folds, if walking forward the pooled log loss improves and the
    Brier score holds within ``guard``; else 1."""
    pooled = walk_forward(rows, y, p, fold, **fit)
    m = pooled.agg(*[F.avg(loss(F.col("y"), F.col(c))).alias(f"{c}_log_loss") for c in ("raw", "scaled")], *[F.avg(F.pow(F.col("y") - F.col(c), 2)).alias(f"{c}_brier") for c in ("raw", "scaled")]).first()
    accepted = m.scaled_log_loss < m.raw_log_loss and m.scaled_brier < m.raw_brier + guard
    fitted = fit_temperature(rows.where(F.col(fold) > 0), y, p, **fit)
    return {"temperature": fitted if accepted else 1.0, "fitted_temperature": fitted, "accepted": accepted, **m.asDict()}


def improves(candidate_loss, candidate_auc, production_loss, production_auc):
    """One metric better and the other within the tolerance; of numbers or of columns."""
    loss_holds = candidate_loss <= production_loss + PROMOTION_TOLERANCE
    auc_holds = candidate_auc >= production_auc - PROMOTION_TOLERANCE
    return ((candidate_loss < production_loss) & auc_holds) | ((candidate_auc > production_auc) & loss_holds)


def decide_promotion(candidate: Mapping[str, float], production: Mapping[str, float] | None, *, champion_run: str | None, candidate_run: str, champion_hash: str | None, candidate_hash: str, force: bool = False) -> bool:
    """Whether a candidate replaces the champion."""
    if force or champion_hash is None or champion_hash != candidate_hash:
        return True
    if champion_run is not None and champion_run == candidate_run:
        return False
    if production is None:
        return True
    return improves(candidate["log_loss"], candidate["roc_auc"], production["log_loss"], production["roc_auc"])


def drift_rates(events: DataFrame) -> DataFrame:
    """Unsmoothed rates of each side of an event; null without opportunities."""
    rate = lambda i, a, b: F.try_divide(F.expr(a.format(i=i)).cast("double"), F.col(b.format(i=i)))
    made = {
        "first_serve_pct": ("player{i}_first_serves_made", "player{i}_total_serve_points"),
        "serve_win_pct": ("player{i}_first_serve_points_won + player{i}_second_serve_points_won", "player{i}_total_serve_points"),
        "ace_rate": ("player{i}_aces", "player{i}_first_serves_made"),
        "df_rate": ("player{i}_double_faults", "player{i}_total_serve_points"),
    }
    return events.select("match_id", "match_date", *[rate(i, *ab).alias(f"player{i}_{n}") for i in (1, 2) for n, ab in made.items()])


def drift_windows(rows: DataFrame, cutoff: Column, event: str = "match_id", date: str = "match_date") -> DataFrame:
    """Add window: current after the cutoff day, reference the newest events before it, as many as
    the current ones but at least REF_MIN and at most REF_MAX. The cutoff day is in neither."""
    current = rows.where(F.col(date) > cutoff)
    n = min(max(current.count(), REF_MIN), REF_MAX)
    reference = rows.where(F.col(date) < cutoff).orderBy(F.desc(date), F.desc(event)).limit(n)
    return current.withColumn("window", F.lit("current")).unionByName(reference.withColumn("window", F.lit("reference")))


def stability_index(windows: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """PSI of each column between the two windows, over the reference's quantile bins.

    Bin edges are exact deciles of the reference; empty shares count as ``floor``. All columns are
    handled in one scan of long rows.
    """
    cells = windows.select("window", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("window", "x.*").where("value IS NOT NULL")
    shares = [i / bins for i in range(1, bins)]
    edges = cells.where(F.col("window") == "reference").groupBy("column").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("edges"))
    placed = cells.join(F.broadcast(edges), "column").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    counts = placed.groupBy("column", "bin").agg(F.count_if(F.col("window") == "current").alias("c"), F.count_if(F.col("window") == "reference").alias("r"))
    every = edges.select("column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["column", "bin"], "left").na.fill(0, ["c", "r"])
    total = Window.partitionBy("column")
    share = lambda c: F.greatest(F.try_divide(F.col(c).cast("double"), F.sum(c).over(total)), F.lit(floor))
    rows = every.withColumn("p", share("c")).withColumn("q", share("r"))
    return rows.groupBy("column").agg(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"))


def verdict(drift_share: Column, largest_psi: Column, prediction_psi: Column, calibration_delta: Column, auc_drop: Column, n: Column) -> Column:
    """healthy, investigate or retrain; a null AUC drop, or one of few rows, triggers nothing."""
    retrain = (drift_share >= SHARE_LIMIT) | (prediction_psi >= PRED_PSI_LIMIT) | (calibration_delta > CALIBRATION_LIMIT) | ((n >= MIN_N_AUC) & F.coalesce(auc_drop > AUC_DROP, F.lit(False)))
    return F.when(retrain, "retrain").when(largest_psi >= PSI_MODERATE, "investigate").otherwise("healthy")


def drift_verdict(psi: DataFrame, prediction: str | None, calibration_delta: Column, auc_drop: Column, n: Column) -> DataFrame:
    """One row: drift share, prediction PSI and healthy, investigate or retrain.

    A feature above the significant bound while the share holds is investigated too.
    """
    feature = F.lit(True) if prediction is None else F.col("column") != prediction
    one = psi.agg(F.avg(F.when(feature, (F.col("psi") >= PSI_SIGNIFICANT).cast("double"))).alias("drift_share"), F.max(F.when(feature, F.col("psi"))).alias("largest_psi"), F.coalesce(F.max(F.when(~feature, F.col("psi"))), F.lit(0.0)).alias("prediction_psi"))
    return one.withColumn("verdict", verdict(F.col("drift_share"), F.col("largest_psi"), F.col("prediction_psi"), calibration_delta, auc_drop, n))


def drift_signals(scored: DataFrame, features: Sequence[str], y: str, p: str, pinned_auc: Column) -> DataFrame:
    """One row of measured signals of both windows of scored events, and the verdict that they give.

    The calibration delta is the difference of the label's rate between the windows, the AUC drop
    that of the current window from ``pinned_auc``. Quantile bins are those of the reference window,
    which drift_windows bounds.
    """
    current = F.col("window") == "current"
    rates = scored.agg(F.count_if(current).alias("n_current"), F.abs(F.avg(F.when(current, F.col(y))) - F.avg(F.when(~current, F.col(y)))).alias("calibration_delta"))
    drop = auc_table(scored.where(current), y, p).select((pinned_auc - F.col("roc_auc")).alias("auc_drop"))
    none = F.lit(None).cast("double")
    psi = drift_verdict(stability_index(scored, [*features, p]), p, none, none, F.lit(0)).drop("verdict")
    one = psi.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(drop))  # one row each
    columns = ("drift_share", "largest_psi", "prediction_psi", "calibration_delta", "auc_drop", "n_current")
    return one.select(*columns, verdict(*map(F.col, columns)).alias("verdict"))


def scored_violations(scored: DataFrame) -> DataFrame:
    """(match_id, issue): pairs that aren't complementary, probabilities out of range or all one half."""
    pair = scored.groupBy("match_id").agg(F.count("*").alias("n"), F.sum("match_won").alias("won"), F.sum("p_win").alias("p"), F.count_if(~F.coalesce(F.col("p_win").between(0, 1), F.lit(False))).alias("out"))
    issue = F.when(F.col("n") != 2, "not two rows").when(F.col("won") != 1, "not one winner").when(F.col("out") > 0, "out of range").when(F.abs(F.col("p") - 1) > 1e-6, "not complementary")
    flat = scored.agg(F.count_if(F.col("p_win") != 0.5).alias("x"), F.count("*").alias("n")).where("x = 0 AND n > 0").select(F.lit(None).cast("string").alias("match_id"), F.lit("all one half").alias("issue"))
    return pair.withColumn("issue", issue).where("issue IS NOT NULL").select("match_id", "issue").union(flat)


def scored_rows(scored: DataFrame) -> DataFrame:
    """Each scored row with the prediction that its probability implies, for a log."""
    return scored.select("match_id", "player_id", "opponent_id", "match_won", "p_win", (F.col("p_win") >= 0.5).cast("int").alias("pred"))


def recency_weights(rows: DataFrame, date: str, cutoff: Column, half_life_days: int = 1461) -> DataFrame:
    """Extension: weights that halve every ``half_life_days``, with mean 1."""
    raw = F.pow(F.lit(0.5), F.datediff(cutoff, F.col(date)) / half_life_days)
    mean = F.broadcast(rows.agg(F.avg(raw).alias("__mean")))
    return rows.crossJoin(mean).withColumn("weight", raw / F.col("__mean")).drop("__mean")
