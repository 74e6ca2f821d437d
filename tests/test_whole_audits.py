"""The orphan and reciprocity audits report what every planted fault leaves, over all rows, by plain Python."""

from __future__ import annotations

from collections import Counter

from pointline import catalog
from pointline.catalog.base import Tables


def numbered(spark, sf):
    """(event, player, opponent, the player's how many-th event) of every directional row."""
    seen, out = Counter(), []
    events = [(e.match_id, e.player1_id, e.player2_id) for e in sorted(Tables(spark, sf).events.collect(), key=lambda e: (e.match_date, e.match_id))]
    for match, one, two in events:
        for player, opponent in ((one, two), (two, one)):
            seen[player] += 1
            out.append((match, player, opponent, seen[player]))
    return out


def test_orphans_of_both_faults(spark, sf):
    want = {(p, m) for m, p, _, n in numbered(spark, sf) if int(m) % 43 == 0 or n % 20 == 0}
    got = [(r.player_id, r.match_id) for r in catalog.queries()["orphan_rows"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(int(m) % 43 for _, m in got)


def test_the_orphan_audit_reads_snapshots_and_no_second_copy_of_the_rows(spark, sf):
    plan = catalog.queries()["orphan_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "weighted_form_10" in plan  # a stored snapshot, not the row it was derived from


def test_reciprocity_of_both_faults(spark, sf):
    filed = [("lost " + m if int(m) % 61 == 0 and p < o or n % 20 == 0 else m, p, o) for m, p, o, n in numbered(spark, sf)]
    sides = set(filed)
    want = sorted((m, p) for m, p, o in filed if (m, o, p) not in sides)
    got = sorted((r.match_id, r.player_id) for r in catalog.queries()["reciprocity"](spark, sf).collect())
    # the misfiled rows are read and reported too, not left out
    assert got == want and any(m.startswith("lost ") for m, _ in got)
