"""Raw mirrors, selections and stored orders on planted rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from pointline.operators.ordered import read_ordered, write_ordered
from pointline.sources import files

EVENT = {
    "match_id": "2003-77-005", "match_date": datetime.date(2003, 2, 9), "tournament": "masters", "tournament_name": " Harbour Cup ", "surface": "clay", "is_indoor": None, "best_of": 3, "round": "qf", "score": "6-1 6-2",
    "player1_id": "ab12", "player2_id": "CD34", "player1_ranking": 0, "player2_ranking": 17, "player1_rank_points": None, "player2_rank_points": 900, "player1_age": 21.5, "player2_age": float("nan"),
    "winner_seed": "2", "minutes": 71.25, "player1_name": "First", "player2_name": "Second",
}
TYPES = {"match_date": "date", "is_indoor": "smallint", "best_of": "smallint", "minutes": "double"}


def event_table(spark, *changes):
    whole = {f"player{i}_{x}": (i if x == "aces" else None) for i in (1, 2) for x in files.RAW_STATS.values()}
    rows = [EVENT | whole | c for c in changes]
    kind = lambda c: TYPES.get(c, "double" if c.endswith("age") else "string" if c.endswith(("name", "id")) or not c.startswith("player") else "int")
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kind(c)}" for c in rows[0]))


def test_raw_mirror_cells(spark):
    profiles = spark.createDataFrame([("AB12", "Ann", "L", 0, "UNK"), ("XX", "none", "R", 180, "ESP")], "player_id string, display_name string, handedness string, height int, ioc string")
    events = event_table(spark, {}, {"match_id": "nokey"}, {"match_id": None}, {"match_id": "2003-77-1000"})
    got = [r.asDict() for r in files.to_raw_rows(events, profiles).collect()]
    assert all(tuple(r) == files.RAW_COLUMNS and len(r) == 50 for r in got)
    blank = [r for r in got if r["tourney_id"] is None]
    assert len(blank) == 2 and all(v is None for r in blank for v in r.values())
    row, long = sorted((r for r in got if r["tourney_id"]), key=lambda r: len(r["match_num"]))
    assert (row["tourney_id"], row["match_num"], long["match_num"]) == ("2003-77", "5", "1000")
    assert (row["winner_name"], row["winner_hand"], row["winner_ht"], row["winner_ioc"]) == ("Ann", "L", None, None)  # 0 and UNK are unknown
    assert (row["loser_name"], row["loser_hand"]) == ("Second", None)  # without a profile the page's name stands
    assert (row["winner_rank"], row["loser_rank"], row["winner_rank_points"], row["winner_age"], row["loser_age"]) == (None, "17", None, "21.500", None)
    assert (row["winner_seed"], row["winner_entry"], row["draw_size"], row["minutes"], row["indoor"]) == ("2", None, None, "71.250", None)
    assert (row["tourney_name"], row["surface"], row["tourney_level"], row["round"]) == ("Harbour Cup", "Clay", "M", "QF")
    assert (row["w_ace"], row["l_ace"], row["w_df"]) == ("1", "2", "0")


def test_match_files_may_have_more_columns(spark, tmp_path):
    files.to_raw_rows(event_table(spark, {})).write.option("header", True).csv(str(tmp_path / "whole"))
    assert [r.winner_id for r in files.read_matches(spark, str(tmp_path / "whole")).collect()] == ["ab12"]
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "matches.csv").write_text("tourney_id,winner_id\n1,2\n")
    with pytest.raises(ValueError, match="loser_id"):
        files.read_matches(spark, str(tmp_path / "short"))


def test_selection_takes_events_once(spark):
    ids = spark.createDataFrame([("2003-77-005",), ("2003-77-005",), (None,), ("other",)], "match_id string")
    events = event_table(spark, {}, {"match_id": "2003-77-006"}, {"match_id": None})
    assert [r.match_id for r in files.selected(events, ids).collect()] == ["2003-77-005"]
    assert files.selected(events, ids.limit(0)).count() == 0


def test_positions_are_those_of_the_files(spark, tmp_path):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v", "id % 3 AS w")
    write_ordered(rows, str(tmp_path / "a"), [F.desc("v")])
    got = read_ordered(spark, str(tmp_path / "a")).collect()
    assert sorted((r.position, r.v) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    same = spark.range(50).selectExpr("1 AS v")  # ties: every position once
    write_ordered(same, str(tmp_path / "b"), [F.col("v")])
    assert sorted(r.position for r in read_ordered(spark, str(tmp_path / "b")).collect()) == list(range(1, 51))
    write_ordered(rows.limit(0), str(tmp_path / "c"), [F.col("v")])
    assert read_ordered(spark, str(tmp_path / "c")).count() == 0
