"""Two-party events as directional rows, and window statistics over each entity's events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schemas import COUNT_STATS, FORM_SURFACES


def expand_sides(events: DataFrame, shared: Sequence[Column | str], sides: tuple[Sequence[Column], Sequence[Column]]) -> DataFrame:
    """Two rows per event from one scan: ``shared`` columns and each side's own."""
    return events.select(*shared, F.explode(F.array(F.struct(*sides[0]), F.struct(*sides[1]))).alias("__side")).select("*", "__side.*").drop("__side")


def zero_as_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def player_matches(events: DataFrame) -> DataFrame:
    """Directional rows of match events with the entity's ordinal and strictly prior activity.

    Zero rankings, points and ages are missing. Return points are what the other side lost on its
    serve. Rows without an id or a date are left out after the windows have counted them.
    """

    def side(me: int, other: int) -> list[Column]:
        own = lambda s: F.col(f"player{me}_{s}")
        their = lambda s: F.col(f"player{other}_{s}")
        return [
            own("id").alias("player_id"),
            their("id").alias("opponent_id"),
            zero_as_missing(own("ranking")).alias("player_ranking"),
            zero_as_missing(their("ranking")).alias("opponent_ranking"),
            zero_as_missing(own("rank_points")).alias("player_rank_points"),
            zero_as_missing(own("age")).alias("player_age"),
            *[own(s).alias(s) for s in COUNT_STATS],
            (their("total_serve_points") - their("first_serve_points_won") - their("second_serve_points_won")).alias("return_points_won"),
            their("total_serve_points").alias("return_points_available"),
            (F.col("winner_id") == own("id")).cast("int").alias("match_won"),
        ]

    rows = expand_sides(events, ["match_id", "match_date", "surface"], (side(1, 2), side(2, 1)))
    rows = with_ordinal(rows, "player_id", "match_date", "match_id", "player_match_number")
    rows = with_prior_count(rows, "player_id", "match_date", 30, "matches_30d_before")
    return rows.where("match_id IS NOT NULL AND match_date IS NOT NULL")


def entity_window(entity: str | Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*order)


def with_ordinal(rows: DataFrame, entity: str, date: str, tie: str, name: str = "ordinal") -> DataFrame:
    """The entity's events numbered from 1 in the order of date, then ``tie``."""
    return rows.withColumn(name, F.row_number().over(entity_window(entity, date, tie)).cast("long"))


def with_prior_count(rows: DataFrame, entity: str, date: str, days: int, name: str) -> DataFrame:
    """Events of the entity from ``days`` before to the day before each event."""
    frame = entity_window(entity, "__day").rangeBetween(-days, -1)
    return rows.withColumn("__day", F.unix_date(date)).withColumn(name, F.count("*").over(frame)).drop("__day")


def smoothed(successes: Column, trials: Column) -> Column:
    """Beta(1, 1) smoothing: never null over non-null sums."""
    return (successes + F.lit(1.0)) / (trials + F.lit(2.0))


def dominance_ratio(return_won: Column, return_all: Column, serve_won: Column, serve_all: Column) -> Column:
    """Smoothed share of return points won over the smoothed share of serve points lost."""
    return smoothed(return_won, return_all) / (F.lit(1.0) - smoothed(serve_won, serve_all))


def decayed_mean(values: Column, decay: float = 0.9) -> Column:
    """Mean of an array in time order, the last weighing 1 and each before it ``decay`` times the next.

    Weights depend on the place in the window alone, so long histories can't underflow.
    """
    n = F.size(values)
    weights = F.transform(values, lambda x, i: F.pow(F.lit(decay), (n - 1 - i).cast("double")))
    total = F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def carried(value: Column, when: Column, window: WindowSpec) -> Column:
    """The value at the last row up to this one where ``when`` holds."""
    return F.last(F.when(when, value), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def signed_streak(won: Column, ordinal: Column, window: WindowSpec) -> Column:
    """Wins in a row, or losses in a row as a negative number, this event included."""
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda flag: F.max(F.when(won == flag, ordinal).otherwise(F.lit(0))).over(running)
    return F.when(won == 1, ordinal - last(0)).otherwise(last(1) - ordinal)


#: The ten-event smoothed rates: name, successes, trials (None counts events).
ROLLING_RATES: Mapping[str, tuple[str, str | None]] = {
    "win_rate_10": ("match_won", None),
    "ace_rate_10": ("aces", "first_serves_made"),
    "first_serve_pct_10": ("first_serves_made", "total_serve_points"),
    "break_points_saved_pct_10": ("break_points_saved", "break_points_faced"),
    "first_serve_win_pct_10": ("first_serve_points_won", "first_serves_made"),
    "second_serve_win_pct_10": ("second_serve_points_won", "total_serve_points - first_serves_made"),
    "serve_win_pct_10": ("first_serve_points_won + second_serve_points_won", "total_serve_points"),
    "return_points_won_pct_10": ("return_points_won", "return_points_available"),
    "df_rate_10": ("double_faults", "total_serve_points"),
}


def rolling_features(matches: DataFrame, window: int = 10, decay: float = 0.9) -> DataFrame:
    """The state of each player right after each of their matches.

    All statistics but the surface form share one partitioning and one order, so they cost one
    shuffle and one sort; the surface form sorts again within the same partitions.
    """
    by_time = entity_window("player_id", "match_date", "match_id")
    recent, life = by_time.rowsBetween(1 - window, 0), by_time.rowsBetween(Window.unboundedPreceding, 0)
    on_surface = entity_window(["player_id", "surface"], "match_date", "match_id").rowsBetween(1 - window, 0)
    form = matches.withColumn("__surface_rate", smoothed(F.sum("match_won").over(on_surface), F.count("*").over(on_surface)))
    total = lambda e, w: F.sum(F.expr(e)).over(w)
    rates = [smoothed(total(s, recent), total(t, recent) if t else F.count("*").over(recent)).alias(n) for n, (s, t) in ROLLING_RATES.items()]
    serve_won = "first_serve_points_won + second_serve_points_won"
    return form.select(
        "player_id", "match_id", F.col("match_date").alias("snapshot_date"), "player_match_number", "surface",
        F.col("player_ranking").alias("latest_player_ranking"), F.col("player_rank_points").alias("latest_player_rank_points"), F.col("player_age").alias("latest_player_age"),
        decayed_mean(F.collect_list(F.col("match_won").cast("double")).over(recent), decay).alias("weighted_form_10"),
        *rates,
        dominance_ratio(total("return_points_won", life), total("return_points_available", life), total(serve_won, life), total("total_serve_points", life)).alias("dominance"),
        F.count("*").over(recent).alias("matches_10"),
        F.try_divide(total("aces", recent).cast("double"), total("service_games", recent)).alias("aces_per_svc_game_10"),
        F.avg("player_ranking").over(recent).alias("avg_player_rank_10"),
        F.avg("opponent_ranking").over(recent).alias("avg_rank_faced_10"),
        signed_streak(F.col("match_won"), F.col("player_match_number"), by_time).alias("streak"),
        *[carried(F.col("__surface_rate"), F.col("surface") == s, by_time).alias(f"{s}_win_rate_10") for s in FORM_SURFACES],
    )


def recent_form_before(rows: DataFrame, entity: str, date: str, tie: str, won: str, size: int = 10) -> DataFrame:
    """Own wins and events among the ``size`` events before each event."""
    frame = entity_window(entity, date, tie).rowsBetween(-size, -1)
    return rows.withColumn("wins_last", F.coalesce(F.sum(won).over(frame), F.lit(0)).cast("long")).withColumn("events_last", F.count("*").over(frame))


def cumulative_wins(rows: DataFrame, group: Sequence[str], order: Sequence[str], won: str) -> DataFrame:
    """Wins of either side up to each meeting of a pair."""
    running = entity_window(group, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("wins_a", F.sum(won).over(running)).withColumn("wins_b", F.sum(1 - F.col(won)).over(running))


def date_bands(rows: DataFrame, date: str, bands: int) -> DataFrame:
    """(band, first, last): the distinct dates in ``bands`` runs of equal length, longer ones first.

    One row per distinct date reaches the window.
    """
    dates = rows.select(F.col(date).alias("__d")).where("__d IS NOT NULL").distinct()
    return dates.withColumn("band", F.ntile(bands).over(Window.orderBy("__d")) - 1).groupBy("band").agg(F.min("__d").alias("first"), F.max("__d").alias("last"))
