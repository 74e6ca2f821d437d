"""Data quality: each check is a query that returns the violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, md5_bucket
from ..schemas import COUNT_STATS, FEATURE_COLS, FORM_SURFACES, SNAPSHOT_VALUES, SURFACES


def issue_list(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that fail (are not true) on a row; all of them, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def first_issue(rules: Mapping[str, Column]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


def filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def match_rules() -> dict[str, Column]:
    """What a stored event must satisfy."""
    rules: dict[str, Column] = {f"{c} missing": filled(c) for c in ("match_id", "player1_id", "player2_id", "winner_id", "tournament", "surface")}
    rules["match_date missing"] = F.col("match_date").isNotNull()
    rules["self play"] = F.col("player1_id") != F.col("player2_id")
    rules["winner not first"] = F.col("winner_id") == F.col("player1_id")
    rules["surface unknown"] = F.col("surface").isin(*SURFACES)
    rules["best_of out of domain"] = F.col("best_of").isNull() | F.col("best_of").isin(1, 3, 5)
    rules["is_indoor out of domain"] = F.col("is_indoor").isNull() | F.col("is_indoor").isin(0, 1)
    for i in (1, 2):
        rules[f"player{i}_ranking not positive"] = F.col(f"player{i}_ranking").isNull() | (F.col(f"player{i}_ranking") >= 1)
        rules[f"player{i}_age out of range"] = F.col(f"player{i}_age").between(0, 100)
        for s in COUNT_STATS:
            top = F.lit(True) if s == "total_serve_points" else F.col(f"player{i}_{s}") <= 20000
            rules[f"player{i}_{s} out of range"] = (F.col(f"player{i}_{s}") >= 0) & top
    return rules


def validated(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with all their issues; an empty list passes."""
    return rows.withColumn("issues", issue_list(rules))


def drop_report(rows: DataFrame) -> DataFrame:
    """Input, valid and dropped counts of validated rows."""
    return rows.agg(F.count("*").alias("n_input"), F.count_if(F.size("issues") == 0).alias("n_valid"), F.count_if(F.size("issues") > 0).alias("n_dropped"))


def not_exactly(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") != n)


def lost_events(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events without exactly two directional rows."""
    counts = rows.groupBy("match_id").agg(F.count("*").alias("n"))
    return events.select("match_id").join(counts, "match_id", "left").select("match_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 2")


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def null_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in key]))
    return rows.select(F.explode(missing).alias("column")).groupBy("column").count()


def orphans(rows: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.select(*key).join(parents.select(*key), list(key), "left_anti")


def non_finite_cells(rows: DataFrame, key: Sequence[str], columns: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(key, column) of every null, NaN or infinite cell, in one scan."""
    bad = F.array_compact(F.array(*[F.when(~is_finite(F.col(c)), F.lit(c)) for c in columns]))
    return rows.select(*key, F.explode(bad).alias("column"))


def out_of_bounds(row: DataFrame, bounds: Mapping[str, tuple[float, float | None]]) -> DataFrame:
    """(column, value) of cells outside of their bounds; null cells pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(hi if hi is None else float(hi)).cast("double").alias("hi")) for c, (lo, hi) in bounds.items()])
    return row.select(F.explode(cells).alias("x")).select("x.column", "x.value", "x.lo", "x.hi").where("value < lo OR value > hi").select("column", "value")


def pair_invariants(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Events without exactly two rows of which exactly one is positive."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(label).alias("positives")).where("n <> 2 OR positives <> 1")


def reciprocity_violations(rows: DataFrame) -> DataFrame:
    other = rows.select("match_id", F.col("opponent_id").alias("player_id"), F.col("player_id").alias("__back"))
    return rows.select("match_id", "player_id", "opponent_id").join(other, ["match_id", "player_id"], "left").where(~F.col("opponent_id").eqNullSafe(F.col("__back"))).select("match_id", "player_id")


def positions_before(asks: DataFrame, rows: DataFrame, key: Sequence[str], ask_day: str, row_day: str) -> DataFrame:
    """``asks`` with ``before``: how many of the key's rows lie on strictly earlier days. One sort merges both tables."""
    both = asks.withColumn("__day", F.col(ask_day)).withColumn("__row", F.lit(0)).unionByName(rows.select(*key, F.col(row_day).alias("__day"), F.lit(1).alias("__row")), allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy("__day", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("before", F.sum("__row").over(upto)).where("__row = 0").drop("__day", "__row")


def head_to_head_violations(features: DataFrame, events: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose head-to-head features differ from a second derivation.

    It numbers a pair's meetings, finds how many come before each row, and joins the last five of
    them by number: work in proportion to a pair's meetings, not to their square.
    """
    pair = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    asks = features.select("match_id", "player_id", "opponent_id", "match_date", "surface", *pair("player_id", "opponent_id"))
    meets = events.select(*pair("player1_id", "player2_id"), F.col("match_date").alias("d"), F.col("match_id").alias("m"), F.col("winner_id").alias("w"), F.col("surface").alias("s"))
    numbered = meets.withColumn("number", F.row_number().over(Window.partitionBy("lo", "hi").orderBy("d", "m")))
    placed = positions_before(asks, meets, ["lo", "hi"], "match_date", "d").where("before > 0")
    wanted = placed.withColumn("number", F.explode(F.sequence(F.greatest(F.lit(1), F.col("before") - 4).cast("int"), F.col("before").cast("int"))))
    met = wanted.join(numbered, ["lo", "hi", "number"])
    again = met.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.col("player_id")).alias("won"), F.count_if(F.col("s") == F.col("surface")).alias("sn"), F.count_if((F.col("s") == F.col("surface")) & (F.col("w") == F.col("player_id"))).alias("sw"))
    both = features.join(again, ["match_id", "player_id"], "left").na.fill(0, ["n", "won", "sn", "sw"])
    edge = lambda w, n: (F.col(w) + 1.0) / (F.col(n) + 2.0) - 0.5
    off = (F.col("h2h_exposure") != F.col("n")) | (F.abs(F.col("h2h_advantage") - edge("won", "n")) > tolerance) | (F.abs(F.col("h2h_surface_advantage") - edge("sw", "sn")) > tolerance)
    return both.where(off).select("match_id", "player_id")


def audit_sample(events: DataFrame, each: int = 20) -> DataFrame:
    """A deterministic stratified sample of event ids: earliest, latest, cold starts, busy days,
    repeated pairs, and one of 256 hash buckets."""
    by_time = ["match_date", "match_id"]
    base = events.select("match_id", "match_date", "player1_id", "player2_id")
    first = base.orderBy(*by_time).limit(each)
    last = base.orderBy(*[F.desc(c) for c in by_time]).limit(each)
    sides = base.select("match_id", "match_date", F.explode(F.array("player1_id", "player2_id")).alias("p"))
    cold = sides.groupBy("p").agg(F.min(F.struct("match_date", "match_id")).alias("x")).select("x.match_date", "x.match_id").orderBy(*by_time).limit(each)
    busy = sides.groupBy("p", "match_date").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id")).where("n > 1").orderBy(*by_time, "p").limit(each)
    pairs = base.groupBy(F.least("player1_id", "player2_id").alias("a"), F.greatest("player1_id", "player2_id").alias("b")).agg(F.count("*").alias("n"), F.max("match_id").alias("match_id")).where("n > 1").orderBy("a", "b").limit(each)
    hashed = base.where(md5_bucket(F.col("match_id")) == 0)
    out = None
    for part in (first, last, cold, busy, pairs, hashed):
        out = part.select("match_id") if out is None else out.union(part.select("match_id"))
    return out.distinct()


def leakage_cells(features: DataFrame, snapshots: DataFrame, defaults: DataFrame, sample: DataFrame, pairs: Mapping[str, str], sides: Sequence[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """(match_id, player_id, column) of sampled cells that strictly earlier snapshots don't give again.

    ``pairs`` maps a difference to the side value it is of, ``sides`` names per-side values (player_ and
    opponent_ go before them). The second derivation shares no code with the first: a sampled side's
    snapshots are numbered, those before the event counted, and the one of that number joined.
    """
    picked = features.join(sample, "match_id", "left_semi")
    asks = picked.select("match_id", "match_date", "surface", F.explode(F.array("player_id", "opponent_id")).alias("who")).distinct()
    snaps = snapshots.withColumnRenamed("player_id", "who").join(asks.select("who").distinct(), "who", "left_semi")
    snaps = snaps.select("who", "snapshot_date", F.struct("snapshot_date", F.col("match_id").alias("mid"), "matches_10", *SNAPSHOT_VALUES).alias("snap"))
    numbered = snaps.select("who", "snap", F.row_number().over(Window.partitionBy("who").orderBy("snapshot_date", "snap.mid")).alias("before"))
    latest = positions_before(asks, snaps, ["who"], "match_date", "snapshot_date").join(numbered, ["who", "before"]).select("match_id", "who", "snap")
    fall = F.broadcast(defaults.select(F.struct(*SNAPSHOT_VALUES).alias("d"), "rate_default"))
    side = asks.join(latest, ["match_id", "who"], "left").crossJoin(fall)
    value = {c: F.coalesce(F.col(f"snap.{c}").cast("double"), F.col(f"d.{c}")) for c in SNAPSHOT_VALUES}
    form = F.col("rate_default")
    for s in FORM_SURFACES:
        form = F.when(F.col("surface") == s, value[f"{s}_win_rate_10"]).otherwise(form)
    value |= {"ranking": value["latest_player_ranking"], "rank_points": value["latest_player_rank_points"], "age": value["latest_player_age"], "surface_form": form}
    value |= {"rank_trend_10": value["avg_player_rank_10"] - value["latest_player_ranking"], "matches_10": F.coalesce("snap.matches_10", F.lit(0)).cast("double")}
    side = side.select("match_id", "who", F.struct(*[value[v].alias(v) for v in dict.fromkeys([*pairs.values(), *sides])]).alias("v"))
    rows = picked.join(side.select("match_id", F.col("who").alias("player_id"), F.col("v").alias("p")), ["match_id", "player_id"]).join(side.select("match_id", F.col("who").alias("opponent_id"), F.col("v").alias("o")), ["match_id", "opponent_id"])
    wanted = {d: F.col(f"p.{s}") - F.col(f"o.{s}") for d, s in pairs.items()} | {f"{n}_{c}": F.col(f"{x}.{c}") for c in sides for n, x in (("player", "p"), ("opponent", "o"))}
    off = F.array_compact(F.array(*[F.when(~(F.abs(F.col(c) - v) <= tolerance), F.lit(c)) for c, v in wanted.items()]))
    return rows.select("match_id", "player_id", F.explode(off).alias("column"))


def singleton_violations(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whatever keeps a table from being one finite row."""
    count = row.agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("rows").alias("column"))
    return count.union(non_finite_cells(row, [], columns))


