"""Descriptive queries of the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def win_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and win rate by each prefix of the columns; level counts the columns rolled up."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.avg("match_won").alias("win_rate"), F.grouping_id().alias("level"))


def gap_bins(rows: DataFrame, column: str, width: float) -> DataFrame:
    """Win rate by bins of a difference."""
    return rows.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg("match_won").alias("win_rate"))


def label_correlations(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(column, correlation) with the label, in one scan."""
    wide = rows.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")


def missing_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, distinct values) in one scan."""
    wide = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns], *[F.countDistinct(c).alias(f"d_{c}") for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])).alias("x")).select("x.*")
