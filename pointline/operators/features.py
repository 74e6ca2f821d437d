"""The gold feature table, and the same features for requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DIFF_COLS, DIFF_SOURCES, FEATURE_COLS, FORM_SURFACES, META_COLS, ROUND_LEVEL, SIDE_COLS, SIMILARITY_COLS, SIMILARITY_SIDE, SNAPSHOT_VALUES, TOURNAMENT_LEVEL
from .asof import as_of_join, last_n_prior, last_n_prior_for
from .profiles import head_to_head

#: Days of rest beyond which more rest says nothing.
REST_CAP = 30


def encoded(c: Column, codes: Mapping[str, int]) -> Column:
    """The code of a category, 0 for others and null."""
    out = F.lit(0)
    for name, code in codes.items():
        out = F.when(c == name, code).otherwise(out)
    return out.cast("short")


def context_features() -> list[Column]:
    flags = [(F.coalesce(F.col("surface") == s, F.lit(False))).cast("short").alias(f"is_{s}") for s in FORM_SURFACES]
    return [*flags, F.coalesce("is_indoor", F.lit(0)).cast("short").alias("is_indoor"), F.coalesce("best_of", F.lit(3)).cast("short").alias("best_of"), encoded(F.col("tournament"), TOURNAMENT_LEVEL).alias("tournament_level"), encoded(F.col("round"), ROUND_LEVEL).alias("round_encoded")]


#: What a side needs of its prior snapshot.
PRIOR = ("snapshot_date", "matches_10", *SNAPSHOT_VALUES)


def side_values(rows: DataFrame, defaults: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill each row's prior snapshot (columns prior_*) from the defaults and add profile values.

    Rows carry player_id, match_date and surface. No snapshot means no exposure and default rest;
    surfaces without a form of their own take the default rate. ``defaults`` has one row.
    """
    fallback = F.broadcast(defaults.select(F.struct(*[F.col(c) for c in defaults.columns]).alias("__d")))
    people = profiles.select(F.col("player_id").alias("__p"), "handedness", "turned_pro")
    rows = rows.crossJoin(fallback).join(people, F.col("player_id") == F.col("__p"), "left").drop("__p")
    filled = lambda c: F.coalesce(F.col(f"prior_{c}").cast("double"), F.col(f"__d.{c}"))
    form = F.col("__d.rate_default")
    for s in FORM_SURFACES:
        form = F.when(F.col("surface") == s, filled(f"{s}_win_rate_10")).otherwise(form)
    rest = F.least(F.lit(float(REST_CAP)), F.coalesce(F.datediff("match_date", "prior_snapshot_date").cast("double"), F.col("__d.days_since_default")))
    hand = F.when(F.col("handedness") == "L", 1.0).when(F.col("handedness") == "R", 0.0)
    names = {"latest_player_ranking": "ranking", "latest_player_rank_points": "rank_points", "latest_player_age": "age"}
    plain = [c for c in SNAPSHOT_VALUES if c != "avg_player_rank_10" and (c == "win_rate_10" or not c.endswith("win_rate_10"))]
    side = F.struct(
        *[filled(c).alias(names.get(c, c)) for c in plain],
        (filled("avg_player_rank_10") - filled("latest_player_ranking")).alias("rank_trend_10"),
        form.alias("surface_form"),
        F.log1p(rest).alias("log_rest"),
        F.coalesce("prior_matches_10", F.lit(0)).cast("int").alias("matches_10"),
        F.coalesce(hand, F.col("__d.left_handed_rate")).alias("is_left_handed"),
        F.coalesce((F.year("match_date") - F.col("turned_pro")).cast("double"), F.col("__d.avg_years_pro")).alias("years_pro"),
    )
    return rows.withColumn("side", side).drop("__d", "handedness", "turned_pro", *[f"prior_{c}" for c in PRIOR])


def feature_columns(p: str = "p", o: str = "o") -> list[Column]:
    """Differences and per-side values of two side structs."""
    diff = [(F.col(f"{p}.{s}") - F.col(f"{o}.{s}")).cast("double").alias(d) for d, s in zip(DIFF_COLS, DIFF_SOURCES, strict=True)]
    both = lambda c: [F.col(f"{p}.{c}").alias(f"player_{c}"), F.col(f"{o}.{c}").alias(f"opponent_{c}")]
    return [*diff, *[x for c in SIDE_COLS for x in both(c)], *[x for c in SIMILARITY_SIDE for x in both(c)]]


def match_features(events: DataFrame, matches: DataFrame, snapshots: DataFrame, defaults: DataFrame, profiles: DataFrame) -> DataFrame:
    """The feature table: 8 meta columns, 37 features and 10 similarity columns per directional row.

    Each directional row gets the latest strictly earlier snapshot of its player, then is paired with
    the other side's row of its event. Head-to-head comes from the events, one list per event that both
    orientations read.
    """
    rows = matches.select("match_id", "match_date", "surface", "player_id", "opponent_id", "match_won")
    prior = as_of_join(rows, snapshots, ["player_id"], "match_date", "snapshot_date", PRIOR, tie=["match_id"], prefix="prior_")
    sides = side_values(prior, defaults, profiles)
    # both rows of an event meet in one grouping, so neither side's state is computed twice
    own = F.struct("match_date", "surface", "player_id", "opponent_id", "match_won", "side")
    events_ = sides.groupBy("match_id").agg(F.collect_list(own).alias("rows"))
    other = lambda me: F.get(F.filter("rows", lambda r: r["player_id"] == me["opponent_id"]), F.lit(0))["side"]
    met = events_.select("match_id", F.explode(F.transform("rows", lambda me: F.struct(me.alias("me"), other(me).alias("o")))).alias("z")).where("z.o IS NOT NULL").select("match_id", "z.me.*", F.col("z.o").alias("o")).withColumnRenamed("side", "p")
    context = last_n_prior(events, "player1_id", "player2_id", "match_date", "match_id", ["winner_id", "surface"]).select("match_id", "tournament", "round", "is_indoor", "best_of", "prior")
    rows = met.join(context, "match_id", "left")
    rows = rows.withColumn("prior", F.coalesce("prior", F.array()))
    return rows.select(*META_COLS, *feature_columns(), *head_to_head(F.col("prior"), F.col("player_id"), F.col("surface")), *context_features()).select(*META_COLS, *FEATURE_COLS, *SIMILARITY_COLS)


def request_features(requests: DataFrame, events: DataFrame, snapshots: DataFrame, defaults: DataFrame, profiles: DataFrame) -> DataFrame:
    """The 37 features of requests (request_id, player_id, opponent_id, match_date, surface,
    tournament, round, is_indoor, best_of), by the same functions as the feature table.

    Any number of requests: both sides of all of them go through one as-of join.
    """
    who = F.explode(F.array(F.struct(F.lit("p").alias("side_name"), F.col("player_id").alias("id")), F.struct(F.lit("o").alias("side_name"), F.col("opponent_id").alias("id"))))
    asked = requests.select("request_id", "match_date", "surface", who.alias("__w")).select("request_id", "match_date", "surface", F.col("__w.side_name").alias("side_name"), F.col("__w.id").alias("player_id"))
    prior = as_of_join(asked, snapshots, ["player_id"], "match_date", "snapshot_date", PRIOR, tie=["match_id"], prefix="prior_")
    sides = side_values(prior, defaults, profiles)
    pairs = sides.groupBy("request_id").agg(F.max(F.when(F.col("side_name") == "p", F.col("side"))).alias("p"), F.max(F.when(F.col("side_name") == "o", F.col("side"))).alias("o"))
    meetings = events.select(F.col("player1_id").alias("player_id"), F.col("player2_id").alias("opponent_id"), "match_date", "match_id", "winner_id", "surface")
    asked = last_n_prior_for(requests, meetings, "player_id", "opponent_id", "match_date", "match_id", ["winner_id", "surface"])
    rows = asked.join(pairs, "request_id")
    return rows.select("request_id", "player_id", "opponent_id", *feature_columns(), *head_to_head(F.col("prior"), F.col("player_id"), F.col("surface")), *context_features()).select("request_id", "player_id", "opponent_id", *FEATURE_COLS)


def mirrored(features: DataFrame) -> DataFrame:
    """The swap law applied to each row: signed features negate, paired ones exchange, the rest stay."""
    swap = {a: b for c in SIDE_COLS for a, b in ((f"player_{c}", f"opponent_{c}"), (f"opponent_{c}", f"player_{c}"))}
    signed = {*DIFF_COLS, "h2h_advantage", "h2h_surface_advantage"}
    made = {c: (-F.col(c)) if c in signed else F.col(swap.get(c, c)) for c in FEATURE_COLS}
    return features.select("match_id", F.col("opponent_id").alias("player_id"), F.col("player_id").alias("opponent_id"), *[made[c].alias(c) for c in FEATURE_COLS])


def swap_violations(features: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(match_id, player_id, column): cells where a row isn't the mirror of its event's other row."""
    flipped = mirrored(features).select("match_id", "player_id", *[F.col(c).alias(f"__{c}") for c in FEATURE_COLS])
    off = F.array_compact(F.array(*[F.when(~(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance), F.lit(c)) for c in FEATURE_COLS]))
    return features.join(flipped, ["match_id", "player_id"]).select("match_id", "player_id", F.explode(off).alias("column"))
