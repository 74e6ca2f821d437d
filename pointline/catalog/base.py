"""What the queries share: the derived tables of a data folder, and rounding for comparison."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import standins
from ..operators import events, features, profiles
from ..operators.ordered import stored


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, so that two engines' sums compare."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


class Tables:
    """The tables of one data folder. Small ones are plans; those that several plans read again are
    written to the shared folder once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = standins.match_events(spark, sf_dir)
        self.profiles = standins.player_profiles(spark, sf_dir)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, df: DataFrame) -> DataFrame:
        return stored(df)

    @property
    def rankings(self) -> DataFrame:
        return standins.rankings(self.spark, self.sf_dir)

    @property
    def matches(self) -> DataFrame:
        return events.player_matches(self.events)

    @property
    def snapshots(self) -> DataFrame:
        return events.rolling_features(self.matches)

    @cached_property
    def kept_matches(self) -> DataFrame:
        return self.stored(self.matches)

    @cached_property
    def kept_snapshots(self) -> DataFrame:
        return self.stored(events.rolling_features(self.kept_matches))

    @cached_property
    def defaults(self) -> DataFrame:
        return self.stored(profiles.pool_defaults(self.kept_snapshots, self.kept_matches, self.profiles))

    @property
    def lifetime(self) -> DataFrame:
        return profiles.lifetime_profiles(self.profiles, self.kept_matches, self.kept_snapshots, self.rankings)

    @property
    def features(self) -> DataFrame:
        return features.match_features(self.events, self.kept_matches, self.kept_snapshots, self.defaults, self.profiles)
