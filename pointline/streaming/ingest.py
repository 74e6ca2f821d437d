"""Streaming ingest of event files into the derived tables, and windowed counts over an event stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.incremental import keep_latest, replace_buckets
from ..operators.ordered import shuffles_dropped, stored


def stream_events(spark: SparkSession, path: str, schema: StructType, stamp: str = "ingested_at", late: str = "7 days", key: str = "match_id", files: int = 8) -> DataFrame:
    """New Parquet files as a stream, each (key, stamp) once within the watermark."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key, stamp])


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def folders(spark: SparkSession, path: str, by: str, numbers: Sequence[int]) -> DataFrame | None:
    """The table at ``path`` in the given buckets; no other folder is even listed. None where there is none of them yet."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/{by}={{{','.join(map(str, numbers))}}}")
    except AnalysisException:
        return None


def one_batch(df: DataFrame, path: str, by: str) -> None:
    """Write the batch's part of a log, replacing what an earlier attempt at the same batch wrote there."""
    with shuffles_dropped(df.sparkSession):
        df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "epoch").parquet(path)


def earlier_players(spark: SparkSession, batch: DataFrame, path: str, epoch: int, buckets: int) -> DataFrame:
    """(match_id, player_id) of the versions of a batch's events that earlier batches brought.

    The log of versions is narrow and lies in buckets of the event's id; only the batch's are read.
    """
    own = [r[0] for r in batch.select(bucket_of("match_id", buckets)).distinct().collect()]  # at most ``buckets`` numbers
    log = folders(spark, path, "match_bucket", own)
    if log is None:
        return batch.select("match_id", F.lit(None).cast("string").alias("player_id")).limit(0)
    old = log.where(F.col("epoch") < epoch)
    return old.join(batch.select("match_id").distinct(), "match_id", "left_semi").select("match_id", "player_id")


def touched_events(spark: SparkSession, path: str, touched: Sequence[int], stamp: str = "ingested_at") -> DataFrame:
    """The newest version of each event in the buckets ``touched`` of the event log; no other folder is read.

    The newest is that of the last batch, and within one that of the newest stamp.
    """
    return keep_latest(folders(spark, path, "bucket", touched).drop("bucket"), ["match_id"], [F.desc("epoch"), F.desc(stamp)]).drop("epoch")


def maintain(stream: DataFrame, events_path: str, table_path: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = 64, first_epoch: int = 0) -> StreamingQuery:
    """Each micro-batch joins the event log, then the buckets of the players it touches are rebuilt.

    The log holds each event in the buckets of both its players, and a new version of an event also
    in those of the players of its earlier versions, who thereby learn that it isn't theirs any more.
    So a bucket holds all that its players' rows follow from: a batch reads the buckets that it
    touches and no others, however long the log is. Arrivals in any order give the table of a full
    build. A repeated batch replaces itself, in the log and in the table. A stream with a checkpoint
    of its own that goes on with the same log counts its batches from a higher ``first_epoch``.
    """
    versions, log = f"{events_path}/versions", f"{events_path}/log"

    def apply(batch: DataFrame, number: int) -> None:
        spark, epoch = batch.sparkSession, first_epoch + number
        batch = stored(batch.withColumn("epoch", F.lit(epoch)))
        if batch.isEmpty():
            return
        sides = batch.select("match_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
        known = sides.union(earlier_players(spark, batch, versions, epoch, buckets)).distinct()
        filed = stored(known.select("match_id", bucket_of("player_id", buckets).alias("bucket")).distinct())
        touched = sorted(r[0] for r in filed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        one_batch(batch.join(filed, "match_id"), log, "bucket")
        one_batch(sides.distinct().withColumn("match_bucket", bucket_of("match_id", buckets)).withColumn("epoch", F.lit(epoch)), versions, "match_bucket")
        rows = build(touched_events(spark, log, touched)).where(bucket_of("player_id", buckets).isin(touched))
        replace_buckets(rows, table_path, "player_id", buckets, touched)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, stamp: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums per key and event-time window, with a watermark on a stream."""
    if stream.isStreaming:
        stream = stream.withWatermark(stamp, late)
    return stream.groupBy(F.window(stamp, size, slide), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, stamp: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: runs of a key's events without a longer gap."""
    if stream.isStreaming:
        stream = stream.withWatermark(stamp, late)
    return stream.groupBy(F.session_window(stamp, gap), key).agg(F.count("*").alias("n"))
