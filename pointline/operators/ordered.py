"""Positions and running totals over a global order, without bringing the rows to one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go when the write ends; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder and read from there by every later plan.

    Compressed columns take a fraction of the disk of a checkpoint's rows, and readers take only the columns they use.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def running_totals(rows: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """Add, under each name, the sum of a column over all rows strictly before each row in the order.

    The order must be total, or rows that tie get totals in an unspecified order. A range sort deals
    the rows; sums within a partition come from a window over it, and one row per partition carries
    what lies before. An empty table stays empty.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [f"__v{i}" for i in range(len(totals))]
    made = rows.select("*", *[totals[n].alias(v) for n, v in zip(totals, values, strict=True)])
    # fixed once: partition numbers and places must not change between the two uses
    placed = stored(made.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sums = placed.groupBy(part.alias("__part")).agg(*[F.sum(v).alias(k) for v, k in zip(values, [f"__s{i}" for i in range(len(values))], strict=True)])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", *[F.sum(f"__s{i}").over(before).alias(f"__o{i}") for i in range(len(values))])
    within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("__part", part)
    for i, v in enumerate(values):
        run = run.withColumn(f"__w{i}", F.coalesce(F.sum(v).over(within), F.lit(0)))
    run = run.join(F.broadcast(starts), "__part")  # one row per partition
    out = [(F.col(f"__w{i}") + F.coalesce(F.col(f"__o{i}"), F.lit(0))).alias(n) for i, n in enumerate(totals)]
    return run.select(*[F.col(f"`{c}`") for c in rows.columns], *out)


def write_ordered(rows: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Write the rows so that the files, in the order of their names, hold them in ``order``: a range sort."""
    rows.orderBy(*order).write.parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_ordered with their position (from 1), counted over the files as they are stored.

    A file's rows are numbered where they are read; one row per file carries what lies before it.
    Empty tables give no rows.
    """
    stored = spark.read.parquet(path)
    name = F.col("_metadata.file_name")
    rows = stored.select(*[F.col(f"`{c}`") for c in stored.columns], F.regexp_extract(name, "^part-([0-9]+)", 1).cast("long").alias("__task"), name.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__task", "__file").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__task", "__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.join(F.broadcast(starts), "__file")  # one row per file
    return placed.select(*[F.col(f"`{c}`") for c in stored.columns], (F.col("__start") + F.col("__row") + 1).alias("position"))


def exact_medians(cells: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median) of each group's values; the mean of the middle two where they are even in number.

    Equal values are counted first, and counts run on over a range sort, so that neither a group nor
    its distinct values come together in one task. Null values don't count.
    """
    counts = cells.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    run = running_totals(counts, [F.col(by), F.col(value)], {"__before": F.col("__n")})
    groups = run.groupBy(by).agg(F.min("__before").alias("__first"), F.sum("__n").alias("__all"))
    placed = run.join(F.broadcast(groups), by).withColumn("__at", F.col("__before") - F.col("__first"))  # one row per group
    holds = lambda i: (F.col("__at") <= i) & (i < F.col("__at") + F.col("__n"))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return placed.groupBy(by).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def exact_quantile(cells: DataFrame, value: str, share: float) -> DataFrame:
    """One row, (quantile): the least value with at least ``share`` of all values at or below it; null without values.

    Counted and run on like exact_medians. Null values don't count.
    """
    counts = cells.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    run = running_totals(counts, [F.col(value)], {"__before": F.col("__n")})
    all_ = F.broadcast(run.agg(F.sum("__n").alias("__all")))  # one row
    at = F.greatest(F.lit(1), F.ceil(F.col("__all") * share))
    holds = (F.col("__before") < at) & (at <= F.col("__before") + F.col("__n"))
    return run.crossJoin(all_).agg(F.max(F.when(holds, F.col(value))).alias("quantile"))
