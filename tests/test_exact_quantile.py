"""The exact quantile, and event halves over more rows than a sketch holds."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pointline.catalog import evaluate
from pointline.operators import ordered


@pytest.mark.parametrize("values", [[], [None, None], [7], [3, 1], [5, 5, 5, 1], [2, None, 9, 4, 4], list(range(101))])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_quantile_is_the_least_value_that_holds_the_share(spark, values, share):
    known = sorted(v for v in values if v is not None)
    want = known[max(1, math.ceil(share * len(known))) - 1] if known else None
    got = ordered.exact_quantile(spark.createDataFrame([(v,) for v in values], "v long"), "v", share).collect()
    assert [r.quantile for r in got] == [want]


def test_halves_of_many_events(spark, sf, tmp_path):
    for t in ("orders", "customer"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    rows = spark.range(0, 3_000_000, 1, 8).select(F.timestamp_micros(F.col("id") * 1_999_993 % 3_000_017).cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in evaluate.event_halves(spark, str(tmp_path)).collect()] == con.sql(evaluate.O["event_halves"]).fetchall()
