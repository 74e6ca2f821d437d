"""Readers and writers of raw match, ranking and profile files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import best_of, canonical_country, canonical_indoor, canonical_surface, clean_score, event_id, positive_rank, safe_float, safe_int

#: Statistics of a raw match file, as they follow w_ and l_.
RAW_STATS = {
    "ace": "aces", "df": "double_faults", "svpt": "total_serve_points", "1stIn": "first_serves_made", "1stWon": "first_serve_points_won",
    "2ndWon": "second_serve_points_won", "SvGms": "service_games", "bpSaved": "break_points_saved", "bpFaced": "break_points_faced",
}
RAW_REQUIRED = (
    "tourney_id", "tourney_name", "tourney_level", "tourney_date", "match_num", "surface", "indoor", "best_of", "round", "score",
    *[f"{s}_{c}" for s in ("winner", "loser") for c in ("id", "rank", "rank_points", "age")],
    *[f"{s}_{c}" for s in ("w", "l") for c in RAW_STATS],
)
#: What a raw match file says of a side, as it follows winner_ and loser_.
RAW_SIDE = ("id", "seed", "entry", "name", "hand", "ht", "ioc", "age", "rank", "rank_points")
#: The columns of a raw match file, in order.
RAW_COLUMNS = (
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "indoor", "tourney_date", "match_num",
    *[f"{s}_{c}" for s in ("winner", "loser") for c in RAW_SIDE], "score", "best_of", "round", "minutes",
    *[f"{s}_{c}" for s in ("w", "l") for c in RAW_STATS],
)
#: Raw level letters.
LEVELS = {"G": "grand_slam", "M": "masters", "500": "atp_500", "250": "atp_250", "D": "davis_cup", "F": "atp_finals", "O": "olympics", "A": "professional"}
RANKING_HEADER = ("ranking_date", "rank", "player", "points")
PROFILE_HEADER = ("id", "player", "atpname", "birthdate", "weight", "height", "turnedpro", "birthplace", "coaches", "hand", "backhand", "ioc")


def read_strings(spark: SparkSession, path: str | Sequence[str], header: Sequence[str], pattern: str | None = None) -> DataFrame:
    """CSV cells as text under an exact header; blank cells are null, spaces are trimmed."""
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)


def read_matches(spark: SparkSession, path: str, exclude: str = "challenger") -> DataFrame:
    """Raw match rows of all files but the excluded ones; rows without both ids are left out,
    missing statistics are 0.

    All files have one header with at least RAW_REQUIRED, in any order; other columns aren't read.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("pathGlobFilter", "*.csv").csv(path)
    missing = [c for c in RAW_REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"the match file lacks {', '.join(missing)}")
    rows = rows.where(~F.lower("_metadata.file_name").contains(exclude)).select(*RAW_REQUIRED)
    stats = [f"{s}_{c}" for s in ("w", "l") for c in RAW_STATS]
    return rows.where("winner_id IS NOT NULL AND loser_id IS NOT NULL").withColumns({c: safe_int(F.col(c)) for c in stats})


def to_match_events(raw: DataFrame) -> DataFrame:
    """Raw rows as stored events, winner first; an unknown level raises."""
    day = F.try_to_date("tourney_date", "yyyyMMdd")
    level = F.lit(None).cast("string")
    for code, name in LEVELS.items():
        level = F.when(F.col("tourney_level") == code, name).otherwise(level)
    level = F.coalesce(level, F.raise_error(F.concat(F.lit("unknown tournament level "), F.coalesce("tourney_level", F.lit("null")))).cast("string"))
    side = lambda i, s, n: [F.col(f"{n}_id").alias(f"player{i}_id"), positive_rank(F.col(f"{n}_rank")).alias(f"player{i}_ranking"), safe_int(F.col(f"{n}_rank_points")).alias(f"player{i}_rank_points"), safe_float(F.col(f"{n}_age")).alias(f"player{i}_age"), *[safe_int(F.col(f"{s}_{c}")).alias(f"player{i}_{x}") for c, x in RAW_STATS.items()]]
    rows = raw.withColumn("__day", day).withColumn("__level", level)
    return rows.select(
        event_id(F.col("tourney_id"), F.col("match_num"), F.year("__day")).alias("match_id"), F.col("__day").alias("match_date"), F.col("winner_id"), F.col("__level").alias("tournament"), F.col("tourney_name").alias("tournament_name"),
        F.lower("round").alias("round"), clean_score(F.col("score")).alias("score"), best_of(F.col("best_of"), F.col("__level"), F.col("round"), F.col("score")).alias("best_of"), canonical_surface(F.col("surface")).alias("surface"),
        canonical_indoor(F.col("indoor")).alias("is_indoor"), *side(1, "w", "winner"), *side(2, "l", "loser"),
    )


def number_cell(c: Column) -> Column:
    """A number as a raw cell: whole ones without decimals, others with three; nulls, zeros and NaN are blank."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(None)).when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.3f", x))


def to_raw_rows(events: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The inverse of to_match_events, under RAW_COLUMNS: the key split into tournament and sequence,
    cells that are unknown blank (null).

    Seeds, entries, draw size, minutes and the names that a page gave (player1_name, player2_name)
    come from the events where these have such columns. ``profiles``, with one row for each upper-case
    player_id, gives display names, hands, heights and countries. An event whose id has no sequence
    gives a blank row.
    """
    word = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    own = lambda c: word(c) if c in events.columns else F.lit(None).cast("string")
    code = F.lit(None).cast("string")
    for letter, name in LEVELS.items():
        code = F.when(F.col("tournament") == name, letter).otherwise(code)
    rows, cells = events, {}
    for i, side, s in ((1, "winner", "w"), (2, "loser", "l")):
        known = dict.fromkeys(("display_name", "handedness", "height", "ioc"), F.lit(None).cast("string"))
        if profiles is not None:
            names = [F.col(c).cast("string").alias(f"__{s}_{c}") for c in known]
            rows = rows.join(profiles.select(F.col("player_id").alias(f"__{s}_id"), *names), F.upper(f"player{i}_id") == F.col(f"__{s}_id"), "left")
            known = {c: word(f"__{s}_{c}") for c in known}
        cells |= {
            f"{side}_id": word(f"player{i}_id"), f"{side}_seed": own(f"{side}_seed"), f"{side}_entry": own(f"{side}_entry"), f"{side}_name": F.coalesce(known["display_name"], own(f"player{i}_name")),
            f"{side}_hand": known["handedness"], f"{side}_ht": number_cell(known["height"]), f"{side}_ioc": F.nullif(known["ioc"], F.lit("UNK")),
            f"{side}_age": number_cell(F.col(f"player{i}_age")), f"{side}_rank": number_cell(F.col(f"player{i}_ranking")), f"{side}_rank_points": number_cell(F.col(f"player{i}_rank_points")),
            **{f"{s}_{c}": F.coalesce(F.col(f"player{i}_{x}"), F.lit(0)).cast("string") for c, x in RAW_STATS.items()},
        }
    cells |= {
        "tourney_id": F.regexp_extract("match_id", r"^(.*)-[0-9]+$", 1), "tourney_name": word("tournament_name"), "surface": F.initcap(word("surface")), "draw_size": number_cell(own("draw_size")), "tourney_level": code,
        "indoor": F.when(F.col("is_indoor") == 1, "I").when(F.col("is_indoor") == 0, "O"), "tourney_date": F.date_format("match_date", "yyyyMMdd"), "match_num": F.regexp_extract("match_id", r"-0*([0-9]+)$", 1),
        "score": word("score"), "best_of": number_cell(F.col("best_of")), "round": F.upper(word("round")), "minutes": number_cell(own("minutes")),
    }
    keyed = F.coalesce(F.col("match_id").rlike("^.*-[0-9]+$"), F.lit(False))
    return rows.select(*[F.when(keyed, cells[c]).alias(c) for c in RAW_COLUMNS])


#: Tournament levels that are taken in.
ELIGIBLE = ("grand_slam", "masters", "atp_500", "atp_250")


def eligible(events: DataFrame) -> DataFrame:
    """Events of the levels that are taken in; an unknown level isn't one."""
    return events.where(F.col("tournament").isin(*ELIGIBLE))


def selected(events: DataFrame, ids: DataFrame, key: str = "match_id") -> DataFrame:
    """Events whose id is among ``ids``, once each however often it is given there; null ids select nothing."""
    return events.join(ids.select(key), key, "left_semi")


def append_new(path: str, rows: DataFrame, stored: DataFrame | None, key: Sequence[str], partition: Column, order: Sequence[str]) -> int:
    """Append rows of keys that ``stored`` lacks, once each, under a partition column; how many."""
    once = rows.dropDuplicates(list(key))
    new = once if stored is None else once.join(stored.select(*key), list(key), "left_anti")
    new = new.withColumn("part", partition).persist()
    n = new.count()
    new.repartition("part").sortWithinPartitions(*order).write.mode("append").partitionBy("part").parquet(path)
    new.unpersist()
    return n


def read_rankings(spark: SparkSession, path: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """Typed ranking rows with a reject_reason (null where the row is sound).

    With ``limit`` rows of worse ranks, as far as they are numbers, are left out before validation.
    """
    rows = read_strings(spark, path, RANKING_HEADER)
    rank, points = F.col("rank").try_cast("int"), F.col("points").try_cast("int")
    if limit is not None:
        rows = rows.where(rank.isNull() | (rank <= limit))
    day = F.when(F.col("ranking_date").rlike("^[0-9]{8}$"), F.try_to_date("ranking_date", "yyyyMMdd"))
    reason = F.when(day.isNull(), "ranking_date").when(rank.isNull() | (rank < 1) | ~F.col("rank").rlike("^[0-9]+$"), "rank").when(F.col("player").isNull() | ~F.col("player").rlike("^[A-Za-z0-9]+$"), "player").when(F.col("points").isNotNull() & (points.isNull() | (points < 0)), "points")
    return rows.select(day.alias("ranking_date"), rank.cast("short").alias("rank"), F.col("player").alias("player_id"), points.alias("points"), reason.alias("reject_reason"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Typed profile rows, the last of each id in file order; 0 and blank measures are missing."""
    rows = read_strings(spark, path, PROFILE_HEADER).select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__seq"))
    whole = lambda c, lo, hi: F.when(F.col(c).try_cast("int").between(lo, hi), F.col(c).try_cast("int"))
    birth = F.when(F.col("birthdate").rlike("^[0-9]{8}$"), F.try_to_date("birthdate", "yyyyMMdd"))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__file"), F.desc("__seq")))
    rows = rows.where("id IS NOT NULL").withColumn("__rn", last).where("__rn = 1")
    return rows.select(
        F.upper("id").alias("player_id"), F.col("player").alias("display_name"), F.col("atpname").alias("atp_name"), F.when(F.year(birth).between(1900, 2100), birth).alias("birthdate"), whole("weight", 1, 500).cast("short").alias("weight"),
        whole("height", 1, 300).cast("short").alias("height"), whole("turnedpro", 1900, 2100).alias("turned_pro"), "birthplace", "coaches", F.col("hand").alias("handedness"), "backhand", F.coalesce(F.upper("ioc"), F.lit("UNK")).alias("ioc"),
    )


#: Columns of a source's player file that are read; it may have others.
SOURCE_NAMES = ("player_id", "name_first", "name_last", "ioc")


def read_source_names(spark: SparkSession, path: str) -> DataFrame:
    """source_id, name and country of a ranking source's player files, the last row of each id in file order.

    Files have a header with at least SOURCE_NAMES, which is checked. Ids are trimmed, rows without
    one are left out; a name is its parts, trimmed, with one space between; unknown countries are UNK.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in SOURCE_NAMES if c not in rows.columns]
    if missing:
        raise ValueError(f"the player file lacks {', '.join(missing)}")
    part = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = rows.select(part("player_id").alias("source_id"), F.trim(F.concat_ws(" ", part("name_first"), part("name_last"))).alias("name"), canonical_country(F.col("ioc")).alias("country"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__seq"))
    last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("__file"), F.desc("__seq")))
    return rows.where("source_id <> ''").withColumn("__rn", last).where("__rn = 1").select("source_id", "name", "country")


def map_issues(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source_id, issue) of a reviewed identity map: blank cells, repeated sources, unknown targets."""
    blank = rows.where(F.coalesce(F.trim("source_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("player_id"), F.lit("")).eqNullSafe("")).select("source_id", F.lit("blank cell").alias("issue"))
    twice = rows.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit("repeated source").alias("issue"))
    lost = rows.join(canonical.select("player_id"), "player_id", "left_anti").select("source_id", F.lit("unknown target").alias("issue"))
    return blank.union(twice).union(lost)
