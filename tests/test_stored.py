"""Tables that are kept in the shared folder: compressed columns, written once."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from pointline.operators.ordered import shared_folder, stored
from pointline.plans.boosting import fit_boosted
from pointline.streaming import ingest as streaming


def kept(spark) -> dict[str, int]:
    """Bytes of each folder in the shared one."""
    root = urlparse(shared_folder(spark)).path
    return {d: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(os.path.join(root, d)) for f in fs) for d in os.listdir(root)}


def test_stored_rows_are_the_same_and_small(spark):
    rows = spark.range(0, 20_000, 1, 3).select("id", F.struct(F.lit("x").alias("a"), F.array("id").alias("b")).alias("s"), *[(F.col("id") % 7).cast("double").alias(f"c{i}") for i in range(40)], F.lit(None).cast("date").alias("d"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = set(kept(spark)), spark.conf.get(name, None)
    got = stored(rows.repartition(4, "id"))
    new = {d: n for d, n in kept(spark).items() if d not in before}
    assert len(new) == 1 and 0 < sum(new.values()) < 20_000 * 40  # rows as they are take 8 bytes for each of 43 columns
    assert got.dtypes == rows.dtypes and got.count() == 20_000 and got.exceptAll(rows).isEmpty()
    assert stored(rows.limit(0)).dtypes == rows.dtypes and stored(rows.limit(0)).isEmpty()
    assert spark.conf.get(name, None) in (conf, "false")


def test_boosting_keeps_its_rows_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)).round(2)
    rows = spark.createDataFrame([(*map(float, r), int(r[0] * r[1] > 0), i % 4 == 0) for i, r in enumerate(x)], "a double, b double, match_won int, is_val boolean")
    before = set(kept(spark))
    fit_boosted(rows, ["a", "b"], trees=3, depth=2, bins=8, patience=3)
    assert len(set(kept(spark)) - before) == 1


def test_streams_keep_no_rows_uncompressed(spark, sf, tmp_path):
    from pointline.operators import events as ops
    from pointline.standins import match_events

    e = match_events(spark, sf).withColumn("ingested_at", F.lit("2002-01-01").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = set(kept(spark))
    stream = streaming.stream_events(spark, str(tmp_path / "in"), e.schema, files=1)
    streaming.maintain(stream, str(tmp_path / "events"), str(tmp_path / "table"), ops.player_matches, str(tmp_path / "checkpoint"), buckets=2).awaitTermination()
    new = set(kept(spark)) - before
    assert new and all(d.startswith("stored-") for d in new)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2 * e.count()
