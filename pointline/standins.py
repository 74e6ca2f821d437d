"""Match events, profiles and rankings derived from the driver's order and customer tables.

The expressions are plain SQL that Spark and DuckDB read alike, so that each stand-in is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Players are the customers; each plays within its league of so many neighbouring keys, so that pairs meet again.
LEAGUE = 12
MULTIPLIERS = ((13, 17, 19, 23, 29, 31, 37, 41, 43), (47, 53, 59, 61, 67, 71, 73, 79, 83))


def _pick(key: str, names: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN ({v}) THEN '{n}'" for n, v in names.items()) + f" ELSE '{other}' END"


def _sides() -> tuple[list[str], list[str], list[str]]:
    first, second, third = [], [], []
    for i, m in enumerate(MULTIPLIERS, 1):
        first += [f"50 + (k * {m[0]}) % 70 AS sv{i}", f"(k * {m[5]}) % 12 AS bf{i}", f"CASE WHEN k % 29 = {i - 1} THEN NULL ELSE 1 + (p{i} * 7 + k) % 200 END AS r{i}"]
        second.append(f"floor(sv{i} * (50 + (k * {m[1]}) % 25) / 100) AS fs{i}")
        stat = {
            "aces": f"least(fs{i}, (k * {m[7]}) % 20)", "double_faults": f"least(sv{i} - fs{i}, (k * {m[8]}) % 9)", "first_serves_made": f"fs{i}",
            "total_serve_points": f"sv{i}", "first_serve_points_won": f"floor(fs{i} * (55 + (k * {m[2]}) % 30) / 100)",
            "second_serve_points_won": f"floor((sv{i} - fs{i}) * (35 + (k * {m[3]}) % 30) / 100)", "service_games": f"8 + (k * {m[4]}) % 10",
            "break_points_saved": f"floor(bf{i} * ((k * {m[6]}) % 101) / 100)", "break_points_faced": f"bf{i}",
        }
        third += [f"CAST(CASE WHEN k % 97 = 0 THEN 0 ELSE {x} END AS INT) AS player{i}_{s}" for s, x in stat.items()]
        third += [f"CAST(r{i} AS INT) AS player{i}_ranking", f"CAST(CASE WHEN r{i} IS NULL THEN 0 ELSE 20000 - 90 * r{i} END AS INT) AS player{i}_rank_points"]
        third.append(f"CAST(18 + p{i} % 20 + (year(d) - 1995) AS DOUBLE) AS player{i}_age")
    return first, second, third


_FIRST, _SECOND, _THIRD = _sides()
#: Select lists applied one after another to ``orders``.
EVENT_LAYERS = (
    ["o_orderkey AS k", "CAST(o_orderdate AS DATE) AS d", "o_custkey AS p1", f"o_custkey - o_custkey % {LEAGUE} + (o_custkey % {LEAGUE} + 1 + (o_orderkey * 7) % {LEAGUE - 1}) % {LEAGUE} AS p2"],
    ["*", *_FIRST],
    ["*", *_SECOND],
    [
        "lpad(CAST(k AS VARCHAR(20)), 10, '0') AS match_id", "d AS match_date", "concat('P', lpad(CAST(p1 AS VARCHAR(20)), 9, '0')) AS player1_id",
        "concat('P', lpad(CAST(p2 AS VARCHAR(20)), 9, '0')) AS player2_id", "concat('P', lpad(CAST(p1 AS VARCHAR(20)), 9, '0')) AS winner_id",
        _pick("k % 8", {"grand_slam": "0", "masters": "1", "atp_500": "2, 3", "atp_250": "4, 5, 6"}, "davis_cup") + " AS tournament",
        _pick("k % 9", {"r128": "0", "r64": "1", "r32": "2", "r16": "3", "qf": "4", "sf": "5", "f": "6"}, "rr") + " AS round",
        "CAST(CASE WHEN k % 50 = 0 THEN NULL WHEN k % 8 = 0 THEN 5 ELSE 3 END AS SMALLINT) AS best_of",
        _pick("k % 20", {"carpet": "0", "grass": "1, 2, 3", "clay": "4, 5, 6, 7, 8, 9"}, "hard") + " AS surface",
        "CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 END AS SMALLINT) AS is_indoor", "CAST(k % 10 AS INT) AS batch", *_THIRD,
    ],
)

PROFILE_LAYERS = (
    [
        "concat('P', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')) AS player_id", "c_name AS display_name",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN 'L' ELSE 'R' END AS handedness",
        "CASE WHEN c_custkey % 3 = 0 THEN '1H' ELSE '2H' END AS backhand", "CAST(170 + c_custkey % 30 AS INT) AS height",
        "CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 1985 + c_custkey % 15 END AS INT) AS turned_pro", "CAST(c_nationkey AS INT) AS nation",
        "CAST(c_custkey AS INT) AS c",
    ],
)

RANK_LAYERS = (
    ["player_id", "c", "CAST(week AS INT) AS week"],
    ["player_id", "week", "c", "date_add(DATE '1995-01-02', week * 7) AS ranking_date", "1 + (c * 7 + week) % 200 AS rank"],
    ["player_id", "CAST(ranking_date AS DATE) AS ranking_date", "CAST(rank AS SMALLINT) AS rank", "CAST(CASE WHEN week < 52 THEN NULL ELSE 20000 - 90 * rank END AS INT) AS points"],
)
WEEKS = 344


def layered(source: str, layers) -> str:
    for select in layers:
        source = f"(SELECT {', '.join(select)} FROM {source})"
    return source[1:-1]


def _apply(df: DataFrame, layers) -> DataFrame:
    for select in layers:
        df = df.selectExpr(*select)
    return df


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(spark.read.parquet(f"{sf_dir}/orders.parquet"), EVENT_LAYERS)


def player_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(spark.read.parquet(f"{sf_dir}/customer.parquet"), PROFILE_LAYERS)


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly ranks of all players. Spark takes an exploded table to be as small as the one it comes from
    and would broadcast it, so joins are asked to sort and merge."""
    weeks = player_profiles(spark, sf_dir).selectExpr("player_id", "c", f"explode(sequence(0, {WEEKS - 1})) AS week").where("(c + week) % 5 <> 0")
    return _apply(weeks, RANK_LAYERS).hint("merge")


#: Common table expressions for DuckDB, with the names of the functions above.
SQL = {
    "match_events": layered("orders", EVENT_LAYERS),
    "player_profiles": layered("customer", PROFILE_LAYERS),
    "rankings": layered(f"(SELECT * FROM player_profiles, (SELECT unnest(range(0, {WEEKS})) AS week) WHERE (c + week) % 5 <> 0)", RANK_LAYERS).replace("date_add(DATE '1995-01-02', week * 7)", "DATE '1995-01-02' + week * 7"),
}
