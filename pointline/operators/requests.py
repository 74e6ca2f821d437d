"""Prediction requests: normalising, checking, both orientations, and matching responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ROUNDS, SURFACES, TOURNAMENT_LEVEL
from .checks import issue_list

#: What a request may name.
TOURNAMENTS = (*TOURNAMENT_LEVEL, "davis_cup", "atp_finals", "olympics", "professional")


def normalised(requests: DataFrame, today: Column) -> DataFrame:
    """Requests with trimmed lower-case categories, a default date, and all their issues.

    A tournament or round may come as its name or as its number, not both.
    """
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = requests.withColumns({"surface": low("surface"), "tournament": low("tournament"), "round": low("round"), "player_id": F.upper(F.trim("player_id")), "opponent_id": F.upper(F.trim("opponent_id")), "match_date": F.coalesce("match_date", today)})
    free = lambda c, values: F.col(c).isNull() | F.col(c).isin(*values)
    rules = {
        "player missing": F.coalesce("player_id", F.lit("")) != "",
        "opponent missing": F.coalesce("opponent_id", F.lit("")) != "",
        "self play": ~F.col("player_id").eqNullSafe(F.col("opponent_id")),
        "surface unknown": free("surface", SURFACES),
        "tournament unknown": free("tournament", TOURNAMENTS),
        "round unknown": free("round", (*ROUNDS, "rr")),
        "tournament given twice": F.col("tournament").isNull() | F.col("tournament_level").isNull(),
        "round given twice": F.col("round").isNull() | F.col("round_encoded").isNull(),
        "is_indoor out of domain": free("is_indoor", (0, 1)),
        "best_of out of domain": free("best_of", (1, 3, 5)),
    }
    return rows.withColumn("issues", issue_list(rules))


def supported(events: DataFrame) -> DataFrame:
    """Events with categories that scoring doesn't know set to its defaults."""
    known = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(other).cast("string"))
    return events.withColumns({"round": known("round", ROUNDS, None), "tournament": known("tournament", tuple(TOURNAMENT_LEVEL), None), "surface": known("surface", SURFACES, "hard")})


def both_orientations(events: DataFrame) -> DataFrame:
    """Two requests per event, side 0 from the first player and side 1 from the second."""
    side = lambda i, a, b: F.struct(F.lit(i).alias("side"), F.col(a).alias("player_id"), F.col(b).alias("opponent_id"), (F.col("winner_id") == F.col(a)).cast("int").alias("match_won"))
    rows = events.select("match_id", "match_date", "surface", "tournament", "round", "is_indoor", "best_of", F.explode(F.array(side(0, "player1_id", "player2_id"), side(1, "player2_id", "player1_id"))).alias("s"))
    return rows.select("match_id", "match_date", "surface", "tournament", "round", "is_indoor", "best_of", "s.*")


def response_mismatches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response of the same position and players, and responses to nothing."""
    got = responses.select("position", F.col("player_id").alias("p"), F.col("opponent_id").alias("o"), F.lit(True).alias("there"))
    both = requests.select("position", "player_id", "opponent_id", F.lit(True).alias("asked")).join(got, "position", "full_outer")
    issue = F.when(F.col("there").isNull(), "no response").when(F.col("asked").isNull(), "no request").when((F.col("p") != F.col("player_id")) | (F.col("o") != F.col("opponent_id")), "other players")
    return both.select("position", issue.alias("issue")).where("issue IS NOT NULL")
