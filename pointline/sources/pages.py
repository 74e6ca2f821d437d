"""Parsers of scraped pages and payloads, as column expressions over tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import date_range, sequence_of, set_score
from ..schemas import COUNT_STATS


def plain_text(html: Column) -> Column:
    """Text of a fragment: tags out, the common references decoded, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_blocks(pages: DataFrame, html: str, marker: str, keep: list[str]) -> DataFrame:
    """One row per block that begins with ``marker`` (a pattern), numbered in page order."""
    parts = F.split(html, f"(?={marker})")
    return pages.select(*keep, F.posexplode(parts).alias("position", "block")).where(F.col("block").rlike(f"^{marker}"))


def archive_tournaments(pages: DataFrame) -> DataFrame:
    """Tournaments of archive pages (html, year): id, slug, name, tier badge, dates."""
    cards = cut_blocks(pages, "html", r'<[a-z]+[^>]*class="[^"]*\btournament\b', ["year"])
    link = r'href="[^"]*/tournaments/([^/"]+)/([^/"]+)/'
    cell = lambda c: F.nullif(plain_text(F.regexp_extract("block", rf'class="[^"]*\b{c}\b[^"]*"[^>]*>(.*?)</', 1)), F.lit(""))
    rows = cards.select("year", "position", F.regexp_extract("block", link, 1).alias("slug"), F.regexp_extract("block", link, 2).alias("tournament_id"), cell("name").alias("name"), F.regexp_extract("block", r"categorystamps_([a-z0-9]+)", 1).alias("tier"), cell("Date").alias("dates"))
    start, end = date_range(F.col("dates"), F.col("year"))
    return rows.where("tournament_id <> ''").select("year", "position", "tournament_id", "slug", "name", "tier", start.alias("start_date"), end.alias("end_date"))


def result_matches(pages: DataFrame) -> DataFrame:
    """Matches of results pages (page_id, html): the nearest day header above, round, both players
    with the winner flagged, and the set score from the winner's side."""
    blocks = cut_blocks(pages, "html", '<[a-z]+[^>]*class="(?:tournament-day|match)"', ["page_id"])
    day = F.to_date(F.nullif(F.regexp_extract("block", r'class="tournament-day"[^>]*>[^0-9<]*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), F.lit("")))
    above = F.last(day, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    player = r'href="/en/players/([^/"]+)/([A-Za-z0-9]+)/[^"]*"[^>]*>([^<]*)</a>'
    ids, names = F.regexp_extract_all("block", F.lit(player), 2), F.regexp_extract_all("block", F.lit(player), 3)
    scores = F.transform(F.regexp_extract_all("block", F.lit(r'class="scores"[^>]*>(.*?)</div>'), 1), lambda s: F.regexp_extract_all(s, F.lit(r"<span>([0-9]+)</span>"), 1))
    won = F.regexp_extract_all("block", F.lit(r'class="player( winner)?"'), 1)
    first = won[0] != ""
    side = lambda a, i: F.when(first, a[i]).otherwise(a[1 - i])
    rows = blocks.withColumn("match_date", above).where(F.size(ids) == 2)
    return rows.select("page_id", "position", "match_date", F.lower(F.regexp_extract("block", r'class="round"[^>]*>([^<]*)<', 1)).alias("round"), F.upper(side(ids, 0)).alias("winner_id"), F.upper(side(ids, 1)).alias("loser_id"), F.trim(side(names, 0)).alias("winner_name"), F.trim(side(names, 1)).alias("loser_name"), set_score(side(scores, 0), side(scores, 1)).alias("score"))


def ranking_rows(pages: DataFrame, limit: int = 200) -> DataFrame:
    """Ranks 1 to ``limit`` of ranking pages (ranking_date, html): the first table with player links of each page.

    A page's rows are parsed and filtered within its array, so that each pattern runs once a row.
    """
    linked = F.filter(F.split("html", "(?=<table)"), lambda block: block.startswith("<table") & block.contains("/players/"))
    table = F.split_part(F.get(linked, F.lit(0)), F.lit("</table>"), F.lit(1))
    blocks = F.filter(F.split(table, "(?=<tr)"), lambda block: block.startswith("<tr") & block.contains("/players/"))
    number = lambda c, i: F.regexp_replace(plain_text(F.get(c, F.lit(i))), "[,.]", "").try_cast("int")
    cells = F.transform(blocks, lambda block: F.struct(block.alias("block"), F.regexp_extract_all(block, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1).alias("c")))
    ranked = F.filter(F.transform(cells, lambda x: F.struct(number(x["c"], 0).alias("rank"), x["block"].alias("block"), x["c"].alias("c"))), lambda x: x["rank"].between(1, limit))
    rows = F.transform(ranked, lambda x: F.struct(x["rank"].alias("rank"), F.upper(F.regexp_extract(x["block"], r'/players/[^/"]+/([A-Za-z0-9]+)/', 1)).alias("player_id"), plain_text(F.regexp_extract(x["block"], r'(?s)/players/[^"]*"[^>]*>(.*?)</a>', 1)).alias("name"), number(x["c"], 2).alias("points")))
    kept = F.explode(F.filter(rows, lambda r: r["player_id"] != ""))
    return pages.select("ranking_date", kept.alias("r")).select("ranking_date", F.col("r.rank").cast("short").alias("rank"), "r.player_id", "r.name", "r.points")


def overview_profiles(pages: DataFrame) -> DataFrame:
    """Profiles of overview pages (player_id, html); a page of another player is rejected."""
    get = lambda pattern: F.nullif(plain_text(F.regexp_extract("html", pattern, 1)), F.lit(""))
    fact = lambda name: get(f"(?s)<span[^>]*>\\s*{name}\\s*</span>\\s*<span[^>]*>(.*?)</span>")
    own = F.upper(get(r'data-player-id="([A-Za-z0-9]+)"'))
    plays = F.lower(fact("Plays"))
    return pages.select(
        "player_id", get(r'(?s)class="player_name"[^>]*>(.*?)</').alias("display_name"), F.try_to_date(F.regexp_extract(fact("DOB"), r"([0-9]{4}[/.-][0-9]{2}[/.-][0-9]{2})", 1), "yyyy/MM/dd").alias("birthdate"),
        F.regexp_extract(fact("Weight"), r"\(?([0-9]+) ?kg", 1).try_cast("short").alias("weight"), F.regexp_extract(fact("Height"), r"\(?([0-9]+) ?cm", 1).try_cast("short").alias("height"), fact("Turned pro").try_cast("int").alias("turned_pro"),
        F.when(plays.contains("left-handed"), "L").when(plays.contains("right-handed"), "R").alias("handedness"), F.when(plays.contains("two-handed"), "2H").when(plays.contains("one-handed"), "1H").alias("backhand"), fact("Birthplace").alias("birthplace"),
        F.upper(get(r"flags/([a-z]{3})\.svg")).alias("ioc"), F.when(own.isNull(), "no player id").when(own != F.upper("player_id"), "other player").alias("reject_reason"),
    )


#: Names of the statistics in a payload's serve block.
PAYLOAD_STATS = {"aces": "Aces", "double_faults": "DoubleFaults", "first_serves_made": "FirstServesIn", "total_serve_points": "ServePoints", "first_serve_points_won": "FirstServePointsWon", "second_serve_points_won": "SecondServePointsWon", "service_games": "ServiceGames", "break_points_saved": "BreakPointsSaved", "break_points_faced": "BreakPointsFaced"}
_BLOCK = T.StructType([T.StructField(n, T.LongType()) for n in PAYLOAD_STATS.values()])
_TEAM = T.StructType([T.StructField("PlayerId", T.StringType()), T.StructField("Totals", _BLOCK), T.StructField("Sets", T.ArrayType(T.StructType([T.StructField("Score", T.StringType()), T.StructField("Stats", T.StructType([T.StructField("ServiceStats", _BLOCK)]))])))])
PAYLOAD = T.StructType([T.StructField("Match", T.StructType([T.StructField("MatchId", T.StringType()), T.StructField("WinningPlayerId", T.StringType()), T.StructField("MatchTime", T.StringType()), T.StructField("PlayerTeam", _TEAM), T.StructField("OpponentTeam", _TEAM)]))])


def payload_events(payloads: DataFrame) -> DataFrame:
    """Statistics of payloads (payload_id, player1_id, player2_id, json), winner first, or a reason.

    A side's totals block is used where it is whole, else the sum of its sets; all 18 statistics must
    be there, and the two players must be those that were announced.
    """
    rows = payloads.withColumn("m", F.from_json("json", PAYLOAD)["Match"])

    def stat(team: str, name: str) -> Column:
        sets = F.transform(F.coalesce(f"m.{team}.Sets", F.array()), lambda s: s["Stats"]["ServiceStats"][name])
        summed = F.when((F.size(sets) > 0) & ~F.exists(sets, lambda x: x.isNull()), F.aggregate(sets, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.coalesce(f"m.{team}.Totals.{name}", summed)

    first = F.upper("m.WinningPlayerId") == F.upper("m.PlayerTeam.PlayerId")
    both = {n: (stat("PlayerTeam", p), stat("OpponentTeam", p)) for n, p in PAYLOAD_STATS.items()}
    ids = F.array_sort(F.array(F.upper("m.PlayerTeam.PlayerId"), F.upper("m.OpponentTeam.PlayerId")))
    missing = F.lit(False)
    for a, b in both.values():
        missing = missing | a.isNull() | b.isNull()
    reason = (
        F.when(F.col("m").isNull(), "unreadable")
        .when(F.coalesce("m.PlayerTeam.PlayerId", F.lit("")).eqNullSafe("") | F.coalesce("m.OpponentTeam.PlayerId", F.lit("")).eqNullSafe(""), "player missing")
        .when(~ids.eqNullSafe(F.array_sort(F.array(F.upper("player1_id"), F.upper("player2_id")))), "other players")
        .when(~F.coalesce(F.upper("m.WinningPlayerId").isin(F.upper("m.PlayerTeam.PlayerId"), F.upper("m.OpponentTeam.PlayerId")), F.lit(False)), "winner unknown")
        .when(sequence_of(F.col("m.MatchId")) == 0, "match id malformed")
        .when(missing, "statistics missing")
    )
    pick = lambda a, b: F.when(F.col("first"), a).otherwise(b)
    rows = rows.withColumn("reason", reason).withColumn("first", first)
    ok = F.col("reason").isNull()
    out = [F.when(ok, F.upper(pick(F.col("m.PlayerTeam.PlayerId"), F.col("m.OpponentTeam.PlayerId")))).alias("winner_id"), F.when(ok, sequence_of(F.col("m.MatchId"))).alias("sequence")]
    for i in (1, 2):
        out += [F.when(ok, pick(*(both[s] if i == 1 else both[s][::-1]))).cast("int").alias(f"player{i}_{s}") for s in COUNT_STATS]
    return rows.select("payload_id", *out, "reason")


def biography(text: Column, limit: int = 1000) -> Column:
    """The first paragraph of the section on playing style, else the lead paragraph; white space
    collapsed, cut after the last full stop within ``limit`` characters."""
    section = F.regexp_extract(text, r"(?is)==+\s*playing style\s*==+\s*(.*?)(?:\n\s*\n|\n==|$)", 1)
    lead = F.regexp_extract(text, r"(?s)^\s*(.*?)(?:\n\s*\n|$)", 1)
    chosen = F.trim(F.regexp_replace(F.coalesce(F.nullif(section, F.lit("")), lead), r"\s+", " "))
    head = F.substring(chosen, 1, limit)
    stop = F.regexp_extract(head, r"(?s)^(.*\.)", 1)
    cut = F.when(F.length(chosen) <= limit, chosen).when(stop != "", stop).otherwise(head)
    return F.nullif(cut, F.lit(""))
