"""Tables of exploded arrays, which Spark takes to be small, aren't broadcast."""

from __future__ import annotations

from pointline.catalog import ingest, more


def broadcast_generators(df) -> list[str]:
    """Generators below a broadcast in the plan."""
    found, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        under = None if under is not None and depth <= under else under
        if "BroadcastExchange" in line:
            under = depth if under is None else under
        elif under is not None and "Generate " in line:
            found.append(line)
    return found


def test_import_broadcasts_no_rankings(spark, sf):
    assert broadcast_generators(more.ranking_import(spark, sf)) == []


def test_unmapped_sources_broadcast_no_rankings(spark, sf):
    assert broadcast_generators(more.unmapped_sources(spark, sf)) == []


def test_missing_weeks_broadcast_no_rankings(spark, sf):
    assert broadcast_generators(ingest.missing_weeks(spark, sf)) == []
