"""Queries of the read models and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import activity, candidate_report, match_names, newest_by_token, unknown_entities
from ..plans import reads, search, similarity
from .base import Tables, rounded
from .sql import rounded as sql_rounded
from .sql import with_tables

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return register


#: All comparisons of a profile with the tour, and what stands beside them.
_DELTAS = [*reads.COMPARISONS, *reads.COMPLEMENTS]
_SURFACE_VALUES = [f"{s}_{c}" for s in ("hard", "clay", "grass") for c in ("win_rate", "matches")]
_OWN = ["dominance", "career_win_rate"]
_AGAINST = ", ".join([f"l.{a} - d.{b} AS {a}_delta" for a, b in reads.COMPARISONS.items()] + [f"l.{a} - (1 - d.{b}) AS {a}_delta" for a, b in reads.COMPLEMENTS.items()])


@query(
    with_tables(
        sql_rounded(
            f"SELECT p.player_id, p.display_name, p.handedness, p.backhand, p.height, p.turned_pro, l.match_count, l.current_rank, {', '.join(f'l.{c}' for c in [*_DELTAS, *_OWN, *_SURFACE_VALUES])}, {_AGAINST}, l.win_rate_10, l.recent_snapshot_date, l.latest_rank_points, l.earliest_rank_points, l.rank_points_delta FROM player_profiles p LEFT JOIN lp l USING (player_id) CROSS JOIN ta d",
            [*_DELTAS, *_OWN, *[c for c in _SURFACE_VALUES if c.endswith("rate")], *[f"{c}_delta" for c in _DELTAS], "win_rate_10"],
        ),
        "lp",
        "ta",
    )
)
def profile_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, lifetime values, their 14 differences from the tour, surfaces, recent form and points."""
    t = Tables(spark, sf_dir)
    page = reads.player_profiles(t.profiles, t.lifetime, t.defaults)
    deltas = [F.col(f"against_tour.{c}").alias(f"{c}_delta") for c in _DELTAS]
    return rounded(page.select("player_id", "display_name", "handedness", "backhand", "height", "turned_pro", "match_count", "current_rank", "lifetime.*", "surfaces.*", *deltas, "recent.*", "points.*"))


@query(with_tables("SELECT player_id, ranking_date, rank, points FROM rankings", "rankings"))
def rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, F4."""
    return Tables(spark, sf_dir).rankings.select("player_id", "ranking_date", "rank", "points").orderBy("player_id", "ranking_date")


@query(
    with_tables(
        "SELECT p.player_id, p.rn::INT AS rn, p.match_id, p.match_date, e.tournament, e.round, p.surface, p.match_won, p.opponent_id, n.display_name AS opponent_name, CASE WHEN coalesce(p.opponent_ranking, r.rank) IS NOT NULL THEN coalesce(p.opponent_ranking, r.rank)::VARCHAR WHEN p.opponent_id IN (SELECT player_id FROM rankings) THEN '200+' ELSE 'N/A' END AS opponent_rank FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) AS rn FROM pm) p LEFT JOIN match_events e USING (match_id) LEFT JOIN player_profiles n ON n.player_id = p.opponent_id LEFT JOIN LATERAL (SELECT rank FROM rankings r WHERE r.player_id = p.opponent_id AND r.ranking_date <= p.match_date ORDER BY r.ranking_date DESC LIMIT 1) r ON true WHERE rn <= 20",
        "pm",
        "rankings",
    )
)
def match_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3, C2, C8, F2, H19."""
    t = Tables(spark, sf_dir)
    return reads.match_history(t.matches, t.events, t.profiles, t.rankings)


@query(with_tables("SELECT match_id, match_date, tournament, round, surface, winner_id FROM match_events WHERE least(player1_id, player2_id) = 'P000000001' AND greatest(player1_id, player2_id) = 'P000000002' ORDER BY match_date DESC, match_id DESC LIMIT 20", "match_events"))
def pair_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4, F3, B17."""
    return reads.pair_page(Tables(spark, sf_dir).events, "P000000002", "P000000001")


@query(with_tables("SELECT p.player_id, p.display_name, coalesce(l.match_count, 0) AS matches_played, l.current_rank, coalesce(n.n_name, 'UNK') AS country FROM player_profiles p LEFT JOIN lp l USING (player_id) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON n.n_nationkey = p.nation", "lp"))
def player_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory with its countries, of which every fifth is unknown."""
    t = Tables(spark, sf_dir)
    countries = t.raw("nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("country_key"), F.col("n_name").alias("country"))
    return reads.directory(t.profiles.withColumnRenamed("nation", "country_key"), t.lifetime, countries)


@query(with_tables("SELECT (SELECT count(*) FROM player_profiles) AS players, count(*) AS matches, max(match_date) AS latest_match_date FROM match_events", "match_events", "player_profiles"))
def directory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5, A17, Q21."""
    t = Tables(spark, sf_dir)
    return reads.directory_totals(t.profiles, t.events)


_V = """SELECT p.player_id, [CASE WHEN p.handedness = 'R' THEN 1.0 ELSE 0.0 END, CASE WHEN p.backhand = '2H' THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS b1,
  [p.height, 0, coalesce(2002 - p.turned_pro, 0)]::DOUBLE[] AS b2,
  [coalesce(first_serve_in_pct, 0), coalesce(overall_serve_points_won_pct, 0), coalesce(aces_per_service_game, 0), coalesce(return_points_won_pct, 0), coalesce(break_point_conversion_pct, 0)]::DOUBLE[] AS b3,
  [0.5::DOUBLE + (coalesce(hard_win_rate, 0) - 0.5::DOUBLE) * hard_matches / (hard_matches + 30), 0.5::DOUBLE + (coalesce(clay_win_rate, 0) - 0.5::DOUBLE) * clay_matches / (clay_matches + 30), 0.5::DOUBLE + (coalesce(grass_win_rate, 0) - 0.5::DOUBLE) * grass_matches / (grass_matches + 30),
    hard_matches / (hard_matches + 30), clay_matches / (clay_matches + 30), grass_matches / (grass_matches + 30)]::DOUBLE[] AS b4,
  [coalesce(dominance, 0)]::DOUBLE[] AS b5, [match_count / (match_count + 100), coalesce(career_win_rate, 0.5)]::DOUBLE[] AS b6
FROM player_profiles p JOIN lp USING (player_id)"""
_N = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
_U = "list_transform({v}, lambda x: CASE WHEN " + _N + " > 0 THEN x / " + _N + " * {w}::DOUBLE ELSE 0 END)"
_W = ", ".join(f"{_U.format(v=f'b{i}', w=w)} AS u{i}" for i, w in enumerate((0.10, 0.10, 0.35, 0.25, 0.35, 0.25), 1))
_VEC = f"SELECT player_id, {_U.format(v='w', w=1)} AS vector FROM (SELECT player_id, list_concat(list_concat(list_concat(u1, u2), list_concat(u3, u4)), list_concat(u5, u6)) AS w FROM (SELECT player_id, {_W} FROM ({_V})))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return similarity.similarity_vectors(t.profiles, t.lifetime, F.lit("2002-01-01").cast("date"))


@query(with_tables("SELECT player_id, i::INT AS position, round(vector[i], 6) + 0.0::DOUBLE AS value FROM (SELECT player_id, vector, unnest(range(1, 20)) AS i FROM v)", "lp", "player_profiles", more={"v": _VEC}))
def similarity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 components in six weighted unit blocks."""
    return rounded(vectors(spark, sf_dir).select("player_id", F.posexplode("vector").alias("position", "value")).select("player_id", (F.col("position") + 1).alias("position"), "value"))


@query(with_tables("SELECT query_id, rank::INT AS rank, player_id, round(s, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, player_id) AS rank FROM (SELECT a.player_id AS query_id, b.player_id, round(list_dot_product(a.vector, b.vector), 9) AS s FROM v a JOIN v b ON a.player_id <> b.player_id WHERE substr(a.player_id, 2)::BIGINT % 20 = 0)) WHERE rank <= 5", "lp", "player_profiles", more={"v": _VEC}))
def similar_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most alike of every twentieth player."""
    v = vectors(spark, sf_dir)
    return similarity.top_k_similar(v, v.where("cast(substr(player_id, 2) AS bigint) % 20 = 0").select("player_id"))


_ASKED = ("CAST(c AS INT) AS ask_id", "CASE c / 20 % 4 WHEN 0 THEN player_id WHEN 1 THEN upper(display_name) WHEN 2 THEN lower(display_name) ELSE concat('nobody ', player_id) END AS query")


@query(
    with_tables(
        "SELECT ask_id, rank::INT AS rank, player_id, display_name, round(s, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY s DESC, player_id) AS rank FROM (SELECT ask_id, b.player_id, round(list_dot_product(a.vector, b.vector), 9) AS s FROM asked JOIN player_profiles p ON p.player_id = asked.query OR lower(p.display_name) = lower(asked.query) JOIN v a ON a.player_id = p.player_id JOIN v b ON a.player_id <> b.player_id)) JOIN player_profiles USING (player_id) WHERE rank <= 3",
        "lp",
        "player_profiles",
        more={"v": _VEC, "asked": f"SELECT {', '.join(_ASKED).replace('c / 20', 'c // 20')} FROM player_profiles WHERE c % 20 = 0"},
    )
)
def similar_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three players most alike of those that are asked for by id or by name in any case; unknown names give nothing."""
    p = Tables(spark, sf_dir).profiles
    asks = p.where("c % 20 = 0").selectExpr(*[x.replace("c / 20", "c div 20") for x in _ASKED])
    return similarity.similar_to_names(vectors(spark, sf_dir), p, asks)


_E = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"


@query(f"WITH e AS ({_E}) SELECT query_id, rank::INT AS rank, vec_id, round(s, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 on embeddings: every twentieth row asks all others."""
    e = Tables(spark, sf_dir).raw("embeddings").select("vec_id", similarity.unit(F.col("embedding").cast("array<double>")).alias("vector"))
    return similarity.top_k_similar(e, e.where("vec_id % 20 = 0").select("vec_id"), key="vec_id")


@query(with_tables("SELECT player_id, i AS block, round(sqrt(list_sum(list_transform(vector[a:b], lambda x: x * x))), 6) AS norm FROM v, (VALUES ('identity', 1, 2), ('profile', 3, 5), ('playstyle', 6, 10), ('surface', 11, 16), ('dominance', 17, 17), ('reputation', 18, 19)) t(i, a, b)", "lp", "player_profiles", more={"v": _VEC}))
def block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's share of a vector's length."""
    return rounded(vectors(spark, sf_dir).select("player_id", F.explode("block_norms").alias("block", "norm")))


@query(
    "WITH q(query_id, q) AS (VALUES (1, 'customer 000000012'), (2, 'custmer 000000034'), (3, 'cust 0000000')), a AS (SELECT query_id, unnest(string_split(q, ' ')) AS ask FROM q), n AS (SELECT c_custkey, c_name, unnest(list_filter(string_split(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM customer), h AS (SELECT query_id, c_custkey, c_name, ask, min(CASE WHEN starts_with(word, ask) THEN 0 ELSE levenshtein(ask, word) END) AS e FROM a JOIN n ON starts_with(word, ask) OR levenshtein(ask, word) <= round(length(ask) * 0.2) GROUP BY ALL) SELECT query_id, c_custkey::VARCHAR AS player_id, c_name AS display_name, sum(e)::BIGINT AS edits FROM h GROUP BY ALL HAVING count(*) = 2"
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and edit-distance search of three names."""
    people = Tables(spark, sf_dir).raw("customer").select(F.col("c_custkey").cast("string").alias("player_id"), F.col("c_name").alias("display_name"))
    asks = spark.createDataFrame([(1, "customer 000000012"), (2, "custmer 000000034"), (3, "cust 0000000")], "query_id int, query string")
    return search.search_names(*search.name_index(people), asks)


#: Names of players, and how sources write them: a letter short, last name first, or as they are. Spark and DuckDB read the same text.
_NAMED = (
    "concat('P', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')) AS player_id",
    "c_custkey AS c",
    "concat(substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 7), ' ', substr(md5(CAST(c_custkey AS VARCHAR(20))), 8, 7)) AS name",
)
_SOURCED = (
    "concat('S', c) AS source_id",
    "CASE WHEN c % 3 = 0 THEN concat(substr(name, 1, 3), substr(name, 5)) WHEN c % 3 = 1 THEN concat(substr(name, 9), ' ', substr(name, 1, 7)) ELSE name END AS name",
)
_PLAYERS = f"SELECT {', '.join(_NAMED)} FROM customer"
_SRC = f"SELECT {', '.join(_SOURCED)} FROM ({_PLAYERS})"


def player_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).raw("customer").selectExpr(*_NAMED)


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_names(spark, sf_dir).selectExpr(*_SOURCED)


#: What is typed for every twentieth player: first words short of a letter, a beginning, or the words the other way round with a wrong letter.
_TYPED = (
    "player_id AS query_id",
    "CASE c / 20 % 3 WHEN 0 THEN concat(substr(name, 1, 2), substr(name, 4)) WHEN 1 THEN substr(name, 1, 3) ELSE concat(substr(name, 9), ' x', substr(name, 2, 6)) END AS query",
)


@query(
    with_tables(
        "SELECT query_id, player_id, name, sum(e)::BIGINT AS edits FROM (SELECT query_id, player_id, name, ask, min(CASE WHEN starts_with(word, ask) THEN 0 ELSE levenshtein(ask, word) END) AS e FROM (SELECT query_id, unnest(list_distinct(string_split(query, ' '))) AS ask FROM typed) a JOIN (SELECT player_id, name, unnest(list_distinct(string_split(name, ' '))) AS word FROM named) n ON starts_with(word, ask) OR levenshtein(ask, word) <= round(length(ask) * 0.2) GROUP BY ALL) JOIN (SELECT query_id, len(list_distinct(string_split(query, ' '))) AS need FROM typed) USING (query_id) GROUP BY query_id, player_id, name, need HAVING count(*) = need",
        more={"named": _PLAYERS, "typed": f"SELECT {', '.join(_TYPED).replace('c / 20', 'c // 20')} FROM ({_PLAYERS}) WHERE c % 20 = 0"},
    )
)
def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is typed for every twentieth player finds names through the stored index of all players' words."""
    t = Tables(spark, sf_dir)
    players = player_names(spark, sf_dir)
    entries, postings = search.name_index(players.select("player_id", "name"), name="name")
    asks = players.where("c % 20 = 0").selectExpr(*[x.replace("c / 20", "c div 20") for x in _TYPED])
    return search.search_names(t.stored(entries), t.stored(postings), asks)


_STATS = "SELECT player_id, count(*) AS matches, min(r) FILTER (WHERE r > 0) AS best_rank FROM (SELECT player1_id AS player_id, player1_ranking AS r FROM match_events UNION ALL SELECT player2_id, player2_ranking FROM match_events) GROUP BY 1"


@query(
    with_tables(
        "SELECT source_id, player_id, round(ratio, 6) AS ratio FROM (SELECT source_id, player_id, ratio, row_number() OVER (PARTITION BY source_id ORDER BY ratio DESC, matches DESC, best_rank, player_id) AS rn FROM (SELECT s.source_id, c.player_id, max(1 - levenshtein(k, c.key) / greatest(length(k), length(c.key))) AS ratio, any_value(coalesce(matches, 0)) AS matches, any_value(coalesce(best_rank, 1000000000)) AS best_rank FROM (SELECT source_id, unnest([regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(array_to_string(list_reverse(string_split(name, ' ')), ' ')), '[^a-z0-9]+', '', 'g')]) AS k FROM src) s CROSS JOIN (SELECT player_id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM named) c LEFT JOIN stats USING (player_id) GROUP BY 1, 2) WHERE ratio >= 0.8) WHERE rn = 1",
        "match_events",
        more={"src": _SRC, "named": _PLAYERS, "stats": _STATS},
    )
)
def fuzzy_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in either order, exact or at least 80% alike."""
    return rounded(match_names(source_names(spark, sf_dir), player_names(spark, sf_dir), activity(Tables(spark, sf_dir).events), measure="levenshtein"))


@query(with_tables("SELECT player_id, matches, best_rank FROM stats", "match_events", more={"stats": _STATS}))
def corpus_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return activity(Tables(spark, sf_dir).events)


@query(with_tables("SELECT s.source_id, s.name, coalesce(array_to_string(x.exact, ','), '') AS exact, coalesce(array_to_string(a.alike, ','), '') AS alike, coalesce(len(a.alike), 0) > 1 AS ambiguous FROM src s LEFT JOIN (SELECT source_id, list(player_id ORDER BY player_id) AS exact FROM src JOIN named USING (name) GROUP BY 1) x USING (source_id) LEFT JOIN (SELECT source_id, list(player_id ORDER BY player_id) AS alike FROM src JOIN named n ON regexp_replace(lower(src.name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(n.name), '[^a-z0-9]+', '', 'g') GROUP BY 1) a USING (source_id)", more={"src": _SRC, "named": _PLAYERS}))
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19."""
    out = candidate_report(source_names(spark, sf_dir), player_names(spark, sf_dir).select("player_id", "name"))
    return out.withColumn("exact", F.array_join("exact", ",")).withColumn("alike", F.array_join("alike", ","))


@query(with_tables("SELECT player_id, count(*) AS n FROM (SELECT player1_id AS player_id FROM match_events UNION ALL SELECT player2_id FROM match_events) WHERE player_id NOT IN (SELECT player_id FROM player_profiles WHERE c % 7 <> 0) GROUP BY 1", "match_events", "player_profiles"))
def unknown_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on either side that aren't known, where every seventh profile is missing."""
    t = Tables(spark, sf_dir)
    return unknown_entities(t.events, t.profiles.where("c % 7 <> 0"))


@query(with_tables("SELECT tournament || '_' || round AS token, arg_max(surface, (match_date, match_id)) AS surface FROM match_events GROUP BY 1", "match_events"))
def newest_surface_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface of the newest event of each tournament token."""
    e = Tables(spark, sf_dir).events.withColumn("match_id", F.concat(F.lit("1-"), F.col("tournament"), F.lit("_"), F.col("round"), F.lit("-"), F.col("match_id")))
    return newest_by_token(e, "surface")


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def country_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country dimension by region."""
    return Tables(spark, sf_dir).raw("nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
