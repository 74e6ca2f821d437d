"""What a published set of tables must be: names, columns and types of the stored files, and rules on their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


@dataclass(frozen=True)
class Contract:
    """``columns``: of each table, in order, with types. ``keys``: unique columns of a table. ``pairs``: the
    table with two mirrored rows per event. ``finite`` and ``domains``: its columns that must be finite or of some values."""

    columns: Mapping[str, Sequence[tuple[str, str]]]
    keys: Mapping[str, Sequence[str]]
    pairs: str
    finite: Sequence[str] = ()
    domains: Mapping[str, Sequence] | None = None


def schema_faults(stored: Mapping[str, DataFrame], contract: Contract) -> dict[str, int]:
    """Faults of the stored files' schemas, which need no scan: missing or further tables, and tables whose columns or types differ."""
    common = stored.keys() & contract.columns.keys()
    names = {t: [c for c, _ in contract.columns[t]] for t in common}
    return {
        "table set": len(stored.keys() ^ contract.columns.keys()),
        "column order": sum(stored[t].columns != names[t] for t in common),
        "column type": sum(stored[t].columns == names[t] and dict(stored[t].dtypes) != dict(contract.columns[t]) for t in common),
    }


def pair_faults(rows: DataFrame) -> DataFrame:
    """One row: events without exactly two rows, with a player twice, whose two rows don't name each other, or whose labels aren't 0 and 1.

    One aggregation by event tells all four: two rows mirror each other if their players are the
    same two as their opponents and none is its own.
    """
    events = rows.groupBy("match_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("player_id").alias("players"),
        (F.coalesce(F.min("player_id") == F.min("opponent_id"), F.lit(False)) & F.coalesce(F.max("player_id") == F.max("opponent_id"), F.lit(False)) & ~F.bool_or(F.col("player_id").eqNullSafe(F.col("opponent_id")))).alias("mirrored"),
        F.count_if(F.col("match_won").cast("int") == 1).alias("won"),
        F.count_if(F.col("match_won").cast("int") == 0).alias("lost"),
    )
    two = F.col("n") == 2
    return events.agg(
        F.count_if(~two).alias("two rows"),
        F.count_if(F.col("players") < F.col("n")).alias("directional key"),
        F.count_if(two & ~F.col("mirrored")).alias("reciprocity"),
        F.count_if(two & ((F.col("won") != 1) | (F.col("lost") != 1))).alias("labels"),
    )


def contract_faults(stored: Mapping[str, DataFrame], contract: Contract) -> dict[str, int]:
    """How often each rule is broken; rules on rows are asked only of tables that have the right columns."""
    faults = schema_faults(stored, contract)
    if any(faults.values()):
        return {rule: n for rule, n in faults.items() if n}
    faults["empty table"] = sum(df.isEmpty() for df in stored.values())
    for table, key in contract.keys.items():
        faults["unique key"] = faults.get("unique key", 0) + stored[table].groupBy(*key).count().where("count > 1").count()
    rows = stored[contract.pairs]
    faults |= pair_faults(rows).first().asDict()
    cells = [F.count_if(~is_finite(F.col(c))) for c in contract.finite]
    values = [F.count_if(~F.coalesce(F.col(c).isin(*allowed), F.lit(False))) for c, allowed in (contract.domains or {}).items()]
    both = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate([*cells, *values])]).first() if cells or values else ()
    faults["finite cells"], faults["domain"] = sum(both[: len(cells)]), sum(both[len(cells) :])
    return {rule: n for rule, n in faults.items() if n}


def publish_contract(tables: Mapping[str, DataFrame], root: str, version: str, contract: Contract) -> dict[str, int]:
    """Write a version, hold the files written against the contract, and only then move the pointer. Returns the faults; none if published."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/version={version}/{name}")
    faults = contract_faults({name: spark.read.parquet(f"{root}/version={version}/{name}") for name in tables}, contract)
    if not faults:
        # appending one file is atomic: readers see the newest pointer that is whole
        spark.createDataFrame([(version,)], "version string").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return faults
