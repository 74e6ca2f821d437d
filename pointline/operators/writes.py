"""Writes that say what they did: validated inserts in one pass, and upserts that rewrite only touched buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_surface
from .checks import validated
from .ordered import shared_folder


def folder(spark: SparkSession, path: str, pattern: str = "") -> DataFrame | None:
    """The table at ``path``, or the folders of it that ``pattern`` names; None where nothing has been written."""
    try:
        return spark.read.option("basePath", path).parquet(path + pattern)
    except AnalysisException:
        return None


def validated_insert(rows: DataFrame, rules: Mapping[str, Column], key: Sequence[str], path: str, batch: int) -> dict[str, int]:
    """Insert the valid rows whose key isn't stored yet; keep the others with their reasons. Returns the counts.

    Surfaces are made canonical, then each row gets all its issues and a status: dropped with issues,
    skipped if its key is stored or an equal key comes first in the batch (by all columns), inserted
    else; batches count from 0. All three are written in one job, under the batch's number and their
    status. The counts n_input, n_valid, n_dropped, n_skipped and n_inserted are those of the files
    written: a scan of no column, which reads their row counts alone. (An ``Observation`` would count
    while it writes, but with Spark 4.1 a session that has used one can't fit MLlib's trees any more.)
    A batch that runs again replaces itself; the stored table is what is under ``inserted``.
    """
    spark = rows.sparkSession
    told = validated(rows.withColumn("surface", canonical_surface(F.col("surface"))), rules)
    ok = F.size("issues") == 0
    stored = folder(spark, path, "/batch=*/status=inserted") if batch else None
    if stored is not None:
        told = told.join(stored.where(F.col("batch") < batch).select(*key).distinct().withColumn("__stored", F.lit(True)), list(key), "left")
    else:
        told = told.withColumn("__stored", F.lit(None).cast("boolean"))
    first = F.row_number().over(Window.partitionBy(*key, ok).orderBy(*[F.col(c) for c in rows.columns if c not in key]))
    told = told.withColumn("status", F.when(~ok, "dropped").when(F.col("__stored") | (first > 1), "skipped").otherwise("inserted")).drop("__stored")
    told.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(path)
    n = {r["status"]: r["count"] for r in spark.read.option("basePath", path).parquet(f"{path}/batch={batch}").groupBy("status").count().collect()}
    counts = {f"n_{s}": n.get(s, 0) for s in ("dropped", "skipped", "inserted")}
    return {"n_input": sum(n.values()), "n_valid": counts["n_skipped"] + counts["n_inserted"], **counts}


def inserted_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*/status=inserted").drop("batch", "status", "issues")


def quarantined_rows(spark: SparkSession, path: str) -> DataFrame:
    """The dropped rows of all batches, with their issues."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*/status=dropped").drop("status")


def bucket_number(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def upsert_buckets(path: str, new: DataFrame, key: Sequence[str], now: Column, overwrite: bool = True, buckets: int = 64, stamp: str = "ingested_at") -> DataFrame:
    """Insert rows of new keys and, with ``overwrite``, replace stored rows whose values differ. Returns (key, action) of the rows affected.

    The table lies in hash buckets of its key. Only the buckets of the new keys are read, and of
    these only those with an inserted or updated row are written again; all other files stay as they
    are. ``stamp`` is set to ``now`` on affected rows; equal rows keep theirs. Of repeated new keys
    the first by all columns counts.
    """
    spark = new.sparkSession
    shared_folder(spark)
    values = [c for c in new.columns if c not in key]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*values))
    new = new.withColumn("__first", first).where("__first = 1").drop("__first").withColumn("bucket", bucket_number(key, buckets)).checkpoint()
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = folder(spark, path, f"/bucket={{{','.join(map(str, touched))}}}") if touched else None
    if old is None:
        old = new.withColumn(stamp, now).limit(0)
    there = old.select(*key, F.struct(*values).alias("__old"))
    action = F.when(F.col("__old").isNull(), "inserted").when(F.lit(overwrite) & ~F.struct(*values).eqNullSafe(F.col("__old")), "updated")
    affected = new.join(there, list(key), "left").withColumn("action", action).where("action IS NOT NULL").drop("__old").checkpoint()
    changed = [r[0] for r in affected.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if changed:
        kept = old.where(F.col("bucket").isin(changed)).join(affected.select(*key), list(key), "left_anti")
        # read whole before its files are replaced
        merged = kept.unionByName(affected.drop("action").withColumn(stamp, now)).checkpoint()
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return affected.select(*key, "action")
