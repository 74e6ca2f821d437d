"""Keeping derived tables correct under late, corrected and deleted arrivals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SURFACES
from .ordered import shuffles_dropped, stored

def keep_latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def insert_absent(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows, and new ones of keys that aren't stored."""
    return stored.unionByName(new.join(stored.select(*key), list(key), "left_anti"))


def overwrite(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows, and stored ones of other keys."""
    return stored.join(new.select(*key), list(key), "left_anti").unionByName(new).select(*stored.columns)


def upsert_actions(stored: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], force: Column | None = None, skip: Column | None = None) -> DataFrame:
    """What an upsert does with each new key: inserted, updated (forced and different), noop or skipped with a reason."""
    old = stored.select(*key, F.struct(*values).alias("__old"))
    same = F.struct(*values).eqNullSafe(F.col("__old"))
    reason = skip if skip is not None else F.lit(None).cast("string")
    may = force if force is not None else F.lit(True)
    action = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("__old").isNull(), "inserted").when(~same & may, "updated").otherwise("noop")
    return new.withColumn("reason", reason).join(old, list(key), "left").withColumn("action", action).select(*key, "action", "reason")


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"), F.count("reason").alias("with_reason"))


def changed_entities(events: DataFrame, since: Column, stamp: str = "ingested_at") -> DataFrame:
    """Ids on either side of events that arrived after ``since``."""
    return events.where(F.col(stamp) > since).select(F.explode(F.array("player1_id", "player2_id")).alias("player_id")).distinct()


def changed_by_windows(fresh: DataFrame, built: DataFrame, key: Sequence[str], watched: Sequence[str], entity: str) -> DataFrame:
    """Entities with rows that are missing from the built table or whose watched values differ there,
    and entities of built rows that the fresh table no longer has."""
    old = built.select(*key, F.struct(*watched).alias("__old"), F.lit(True).alias("__there"))
    new = fresh.select(*key, F.struct(*watched).alias("__new"), F.lit(True).alias("__here"))
    both = new.join(old, list(key), "full_outer")
    off = F.col("__here").isNull() | F.col("__there").isNull() | ~F.col("__new").eqNullSafe(F.col("__old"))
    return both.where(off).select(entity).distinct()


def affected_events(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Every event with a changed entity on either side."""
    sides = events.select("match_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    return sides.join(entities, "player_id", "left_semi").select("match_id").distinct()


def rebuild(events: DataFrame, built: DataFrame, entities: DataFrame, build: Callable[[DataFrame], DataFrame], entity: str = "player_id") -> DataFrame:
    """The built table with all rows of ``entities`` made anew from their full histories.

    Only events with a changed entity go through ``build``; of what it gives, rows of other entities,
    whose histories are incomplete there, are left out.
    """
    part = events.join(affected_events(events, entities), "match_id", "left_semi")
    fresh = build(part).join(entities, entity, "left_semi")
    return built.join(entities, entity, "left_anti").unionByName(fresh).select(*built.columns)


def publish(df: DataFrame, root: str, version: str, checks: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> str:
    """Write a version, check what was written, then point ``current`` to it.

    A failed check raises and leaves the pointer as it was. The pointer is a one-row table.
    """
    spark: SparkSession = df.sparkSession
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    failed = [name for name, check in checks if check(stored).limit(1).count()]
    if failed:
        raise ValueError(f"not published: {', '.join(failed)}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return path


def publish_set(tables: Mapping[str, DataFrame], root: str, version: str, checks: Sequence[tuple[str, Callable[[Mapping[str, DataFrame]], DataFrame]]]) -> str:
    """Write several tables of one view as a version, check what was written, then point to all at once.

    A check gives faulty rows from the written tables by name. A failed check raises and leaves the
    pointer, which is one row in a folder per version, as it was.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/version={version}/{name}")
    stored = {name: spark.read.parquet(f"{root}/version={version}/{name}") for name in tables}
    failed = [name for name, check in checks if check(stored).limit(1).count()]
    if failed:
        raise ValueError(f"not published: {', '.join(failed)}")
    # appending one file is atomic: readers see the newest pointer that is whole
    spark.createDataFrame([(version,)], "version string").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return f"{root}/version={version}"


def read_set(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of the version published last."""
    version = spark.read.parquet(f"{root}/pointers").agg(F.max_by("version", F.struct("published_at", "version"))).first()[0]
    return {name: spark.read.parquet(f"{root}/version={version}/{name}") for name in names}


def advance_watermark(events: DataFrame, path: str, pipeline: str, build: Callable[[], None]) -> None:
    """Run ``build``, then append the watermark of the events that it saw; a failed build appends nothing."""
    seen = events.agg(F.max("ingested_at").alias("watermark")).first()[0]
    build()
    if seen is not None:
        events.sparkSession.createDataFrame([(pipeline, seen)], "pipeline string, watermark timestamp").coalesce(1).write.mode("append").parquet(path)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={spark.read.parquet(f'{root}/current').first()[0]}")


def write_buckets(df: DataFrame, path: str, entity: str, buckets: int = 64) -> None:
    """Replace only the hash buckets of the entities that ``df`` has rows of."""
    (
        df.withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))
        .repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def replace_buckets(df: DataFrame, path: str, entity: str, buckets: int, touched: Sequence[int]) -> None:
    """Replace the hash buckets ``touched`` by the rows of ``df``; those that it has no rows of become empty."""
    kept = stored(df)
    there = {r[0] for r in kept.select(F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")).distinct().collect()}  # at most ``buckets`` numbers
    with shuffles_dropped(df.sparkSession):
        write_buckets(kept, path, entity, buckets)
    for bucket in sorted(set(touched) - there):
        kept.limit(0).write.mode("overwrite").parquet(f"{path}/bucket={bucket}")


def watermarks(events: DataFrame, state: DataFrame, pipeline: str) -> DataFrame:
    """One row: the source's watermark, the built one, and whether there is anything to build."""
    source = events.agg(F.max("ingested_at").alias("source"))
    built = state.where(F.col("pipeline") == pipeline).agg(F.max("watermark").alias("built"))
    return source.crossJoin(built).withColumn("stale", F.col("source").isNotNull() & (F.col("built").isNull() | (F.col("source") > F.col("built"))))


def missing_mondays(dates: DataFrame, date: str, start: Column, end: Column, keys: DataFrame | None = None) -> DataFrame:
    """Mondays from start to end that the table has no row of; with ``keys``, those of each key."""
    first = F.next_day(F.date_sub(start, 1), "MON")
    week = F.when(first <= end, F.sequence(first, end, F.expr("interval 7 days")))
    on = [date] if keys is None else [*keys.columns, date]
    owners = dates.sparkSession.range(1).select() if keys is None else keys
    calendar = owners.select("*", F.explode(week).alias(date))
    return calendar.join(dates.select(*on).distinct(), on, "left_anti")


def later_meetings(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events of a pair that come after the pair's first new event; both sides in either order.

    The first day of each pair is enough, so that no pair's history meets itself.
    """
    pair = [F.least("player1_id", "player2_id").alias("__lo"), F.greatest("player1_id", "player2_id").alias("__hi")]
    first = new.groupBy(*pair).agg(F.min("match_date").alias("__first"))
    return events.select("*", *pair).join(first, ["__lo", "__hi"]).where("match_date > __first").drop("__lo", "__hi", "__first")


def run_window(start: Column, end: Column, watermark: Column, today: Column) -> Column:
    """(first, last) of a run: as given, an open end is today, an open start is the watermark's day;
    null where there is nothing to do."""
    first = F.coalesce(start, watermark)
    last = F.coalesce(end, today)
    return F.when(first.isNotNull() & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def backfilled(rows: DataFrame) -> DataFrame:
    """Events written before ranks could be missing and surfaces were canonical: rank 0 is null, any other
    surface hard; a null surface stays. Doing it again changes nothing."""
    surface = F.when(~F.col("surface").isin(*SURFACES), F.lit("hard")).otherwise(F.col("surface"))
    return rows.withColumns({"surface": surface} | {c: F.nullif(F.col(c), F.lit(0)) for c in ("player1_ranking", "player2_ranking")})


def enrich(stored: DataFrame, found: DataFrame, key: str, column: str, unknown: str = "UNK") -> DataFrame:
    """Fill ``column`` where it is null, blank or unknown; known values stay."""
    new = found.select(key, F.col(column).alias("__new"))
    old = F.nullif(F.nullif(F.trim(column), F.lit("")), F.lit(unknown))
    return stored.join(new, key, "left").withColumn(column, F.coalesce(old, "__new", F.lit(unknown))).drop("__new")
