"""DuckDB text of the derived tables, from which the queries' SQL is put together."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .. import standins
from ..schemas import COUNT_STATS, DIFF_COLS, DIFF_SOURCES, FEATURE_COLS, FORM_SURFACES, META_COLS, POOL_CONSTANTS, POOL_MEDIANS, ROUND_LEVEL, SIDE_COLS, SIMILARITY_COLS, SIMILARITY_SIDE, SNAPSHOT_VALUES, TOURNAMENT_LEVEL


def _side(me: int, other: int) -> str:
    return f"""SELECT match_id, match_date, surface, player{me}_id AS player_id, player{other}_id AS opponent_id,
  nullif(player{me}_ranking, 0) AS player_ranking, nullif(player{other}_ranking, 0) AS opponent_ranking,
  nullif(player{me}_rank_points, 0) AS player_rank_points, nullif(player{me}_age, 0) AS player_age,
  {', '.join(f'player{me}_{s} AS {s}' for s in COUNT_STATS)},
  player{other}_total_serve_points - player{other}_first_serve_points_won - player{other}_second_serve_points_won AS return_points_won,
  player{other}_total_serve_points AS return_points_available, (winner_id = player{me}_id)::INT AS match_won
FROM match_events"""


def _smooth(s: str, t: str, w: str) -> str:
    return f"(sum({s}) OVER {w} + 1.0::DOUBLE) / ({t} OVER {w} + 2.0::DOUBLE)"


_RATES = {
    "win_rate_10": ("match_won", "count(*)"), "ace_rate_10": ("aces", "sum(first_serves_made)"), "first_serve_pct_10": ("first_serves_made", "sum(total_serve_points)"),
    "break_points_saved_pct_10": ("break_points_saved", "sum(break_points_faced)"), "first_serve_win_pct_10": ("first_serve_points_won", "sum(first_serves_made)"),
    "second_serve_win_pct_10": ("second_serve_points_won", "sum(total_serve_points - first_serves_made)"),
    "serve_win_pct_10": ("first_serve_points_won + second_serve_points_won", "sum(total_serve_points)"),
    "return_points_won_pct_10": ("return_points_won", "sum(return_points_available)"), "df_rate_10": ("double_faults", "sum(total_serve_points)"),
}

_OWN = """count(DISTINCT match_id) AS match_count, max(match_date) AS latest_match_date,
  arg_max(player_rank_points, (match_date, match_id)) FILTER (WHERE player_rank_points > 0) AS latest_rank_points,
  arg_min(player_rank_points, (match_date, match_id)) FILTER (WHERE player_rank_points > 0) AS earliest_rank_points,
  min(match_date) FILTER (WHERE player_rank_points > 0) AS earliest_rank_points_date,
  max(match_date) FILTER (WHERE player_rank_points > 0) AS latest_rank_points_date,
  arg_max(player_ranking, (match_date, match_id)) FILTER (WHERE player_ranking IS NOT NULL) AS last_match_rank"""


def _ratios(ratios: dict) -> str:
    return ", ".join(f"sum({a})::DOUBLE / nullif(sum({b}), 0) AS {n}" for n, (a, b) in ratios.items())


def _dominance(w: str = "") -> str:
    over = f" OVER {w}" if w else ""
    return f"""((sum(return_points_won){over} + 1.0::DOUBLE) / (sum(return_points_available){over} + 2.0::DOUBLE))
    / (1.0::DOUBLE - (sum(first_serve_points_won + second_serve_points_won){over} + 1.0::DOUBLE) / (sum(total_serve_points){over} + 2.0::DOUBLE))"""


def _tables() -> dict[str, str]:
    from ..operators.profiles import OWN_RATIOS, RETURN_RATIOS, TOUR_RATIOS

    kept = [c for c in SNAPSHOT_VALUES if c == "win_rate_10" or not c.endswith("win_rate_10")]
    fill = POOL_CONSTANTS | {"days_since_default": 365.0, "matches_30d_default": 0.0, "left_handed_rate": 0.0, "avg_years_pro": 8.0}
    names = {"latest_player_ranking": "ranking", "latest_player_rank_points": "rank_points", "latest_player_age": "age"}
    case = lambda key, codes: f"(CASE {key} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in codes.items()) + " ELSE 0 END)::SMALLINT"
    return {
        "pm": f"""SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date, match_id) AS player_match_number,
  count(*) OVER (PARTITION BY player_id ORDER BY match_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS matches_30d_before
FROM ({_side(1, 2)} UNION ALL {_side(2, 1)})""",
        "rf": f"""SELECT player_id, match_id, match_date AS snapshot_date, player_match_number, surface, player_ranking AS latest_player_ranking,
  player_rank_points AS latest_player_rank_points, player_age AS latest_player_age,
  sum(match_won * pow(0.9::DOUBLE, n_all - player_match_number)) OVER w10 / sum(pow(0.9::DOUBLE, n_all - player_match_number)) OVER w10 AS weighted_form_10,
  {', '.join(f'{_smooth(s, t, "w10")} AS {n}' for n, (s, t) in _RATES.items())},
  {_dominance('life')} AS dominance, count(*) OVER w10 AS matches_10,
  (sum(aces) OVER w10)::DOUBLE / nullif(sum(service_games) OVER w10, 0) AS aces_per_svc_game_10,
  avg(player_ranking) OVER w10 AS avg_player_rank_10, avg(opponent_ranking) OVER w10 AS avg_rank_faced_10,
  CASE WHEN match_won = 1 THEN player_match_number - max(CASE WHEN match_won = 0 THEN player_match_number ELSE 0 END) OVER life
    ELSE max(CASE WHEN match_won = 1 THEN player_match_number ELSE 0 END) OVER life - player_match_number END AS streak,
  {', '.join(f"last_value(CASE WHEN surface = '{s}' THEN surface_rate END IGNORE NULLS) OVER life AS {s}_win_rate_10" for s in FORM_SURFACES)}
FROM (SELECT *, count(*) OVER (PARTITION BY player_id) AS n_all, {_smooth('match_won', 'count(*)', 'on_surface')} AS surface_rate FROM pm
  WINDOW on_surface AS (PARTITION BY player_id, surface ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WINDOW w10 AS (PARTITION BY player_id ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
  life AS (PARTITION BY player_id ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "ta": f"""SELECT 1 AS singleton_id, pool_as_of_date, snapshot_pool_rows, snapshot_pool_players, profile_rows, player_match_rows,
  {', '.join(f'round(coalesce({c}::DOUBLE, {v}::DOUBLE), 5) AS {c}' for c, v in fill.items())}, 0.5::DOUBLE AS rate_default,
  {', '.join(f'round({c}, 5) AS {c}' for c in TOUR_RATIOS)}
FROM (SELECT (coalesce(max(snapshot_date), current_date) + 1)::DATE AS pool_as_of_date, count(*) AS snapshot_pool_rows, count(DISTINCT player_id) AS snapshot_pool_players,
    {', '.join(f'round_even(quantile_cont({c}::DOUBLE, 0.5), 0) AS {c}' if c in POOL_MEDIANS else f'avg({c}) AS {c}' for c in SNAPSHOT_VALUES)} FROM rf),
  (SELECT round_even(quantile_cont((p.d - l.last_date)::DOUBLE, 0.5), 0) AS days_since_default, round_even(quantile_cont(coalesce(r.n, 0)::DOUBLE, 0.5), 0) AS matches_30d_default
    FROM (SELECT player_id, max(snapshot_date) AS last_date FROM rf GROUP BY 1) l, (SELECT (max(snapshot_date) + 1)::DATE AS d FROM rf) p
    LEFT JOIN (SELECT player_id, count(*) AS n FROM pm, (SELECT (max(snapshot_date) + 1)::DATE AS d FROM rf) WHERE match_date >= d - 30 AND match_date < d GROUP BY 1) r ON r.player_id = l.player_id),
  (SELECT avg(CASE handedness WHEN 'L' THEN 1 WHEN 'R' THEN 0 END) AS left_handed_rate, avg(year(d) - turned_pro) AS avg_years_pro, count(*) AS profile_rows
    FROM player_profiles, (SELECT (max(snapshot_date) + 1)::DATE AS d FROM rf)),
  (SELECT count(*) AS player_match_rows, {_ratios(TOUR_RATIOS)} FROM pm)""",
        "lp": f"""SELECT b.player_id, coalesce(match_count, 0) AS match_count, latest_match_date, latest_rank_points, earliest_rank_points, earliest_rank_points_date, latest_rank_points_date,
  latest_rank_points - earliest_rank_points AS rank_points_delta, coalesce(r.official_rank, last_match_rank) AS current_rank,
  {', '.join([*OWN_RATIOS, *RETURN_RATIOS])}, {', '.join(f'coalesce({s}_matches, 0) AS {s}_matches, {s}_win_rate' for s in ('hard', 'clay', 'grass'))},
  dominance, career_win_rate, recent_snapshot_date, win_rate_10
FROM player_profiles b
LEFT JOIN (SELECT player_id, {_OWN}, {_ratios(OWN_RATIOS)}, {_dominance()} AS dominance, avg(match_won) AS career_win_rate,
    {', '.join(f"count(*) FILTER (WHERE surface = '{s}') AS {s}_matches, avg(match_won) FILTER (WHERE surface = '{s}') AS {s}_win_rate" for s in ('hard', 'clay', 'grass'))}
  FROM pm GROUP BY player_id) a USING (player_id)
LEFT JOIN (SELECT p.player_id, {_ratios({n: tuple(re.sub(r'([a-z_]+)', r'o.\1', x) for x in r) for n, r in RETURN_RATIOS.items()})}
  FROM pm p JOIN pm o ON o.match_id = p.match_id AND o.player_id = p.opponent_id GROUP BY p.player_id) f USING (player_id)
LEFT JOIN (SELECT player_id, max(snapshot_date) AS recent_snapshot_date, arg_max(win_rate_10, (snapshot_date, match_id)) AS win_rate_10 FROM rf GROUP BY 1) s USING (player_id)
LEFT JOIN (SELECT player_id, arg_max(rank, ranking_date) AS official_rank FROM rankings GROUP BY 1) r USING (player_id)""",
        "sides": f"""SELECT m.match_id, m.match_date, e.tournament, e.round, m.surface, e.is_indoor, e.best_of, m.player_id, m.opponent_id, m.match_won,
  {', '.join(f'coalesce(s.{c}::DOUBLE, d.{c}) AS {names.get(c, c)}' for c in kept)},
  coalesce(s.avg_player_rank_10, d.avg_player_rank_10) - coalesce(s.latest_player_ranking::DOUBLE, d.latest_player_ranking) AS rank_trend_10,
  CASE m.surface {' '.join(f"WHEN '{s}' THEN coalesce(s.{s}_win_rate_10, d.{s}_win_rate_10)" for s in FORM_SURFACES)} ELSE d.rate_default END AS surface_form,
  ln(1.0::DOUBLE + least(30.0::DOUBLE, coalesce((m.match_date - s.snapshot_date)::DOUBLE, d.days_since_default))) AS log_rest,
  coalesce(s.matches_10, 0)::INT AS matches_10,
  coalesce((CASE p.handedness WHEN 'L' THEN 1 WHEN 'R' THEN 0 END)::DOUBLE, d.left_handed_rate) AS is_left_handed,
  coalesce((year(m.match_date) - p.turned_pro)::DOUBLE, d.avg_years_pro) AS years_pro
FROM pm m LEFT JOIN match_events e USING (match_id) LEFT JOIN player_profiles p ON p.player_id = m.player_id CROSS JOIN ta d
LEFT JOIN LATERAL (SELECT * FROM rf WHERE rf.player_id = m.player_id AND rf.snapshot_date < m.match_date ORDER BY rf.snapshot_date DESC, rf.match_id DESC LIMIT 1) s ON true""",
        "h2h": """SELECT match_id, player_id, count(*) AS n, count(*) FILTER (WHERE won) AS w, count(*) FILTER (WHERE here) AS sn, count(*) FILTER (WHERE here AND won) AS sw
FROM (SELECT m.match_id, m.player_id, e.winner_id = m.player_id AS won, e.surface = m.surface AS here,
    row_number() OVER (PARTITION BY m.match_id, m.player_id ORDER BY e.match_date DESC, e.match_id DESC) AS rn
  FROM pm m JOIN match_events e ON least(e.player1_id, e.player2_id) = least(m.player_id, m.opponent_id)
    AND greatest(e.player1_id, e.player2_id) = greatest(m.player_id, m.opponent_id) AND e.match_date < m.match_date)
WHERE rn <= 5 GROUP BY 1, 2""",
        "mf": f"""SELECT {', '.join('p.' + c for c in META_COLS)},
  {', '.join(f'p.{s} - o.{s} AS {d}' for d, s in zip(DIFF_COLS, DIFF_SOURCES, strict=True))},
  {', '.join(f'{a}.{c} AS {b}_{c}' for c in (*SIDE_COLS, *SIMILARITY_SIDE) for a, b in (('p', 'player'), ('o', 'opponent')))},
  coalesce(h.n, 0)::INT AS h2h_exposure, (coalesce(h.w, 0) + 1.0::DOUBLE) / (coalesce(h.n, 0) + 2.0::DOUBLE) - 0.5::DOUBLE AS h2h_advantage,
  (coalesce(h.sw, 0) + 1.0::DOUBLE) / (coalesce(h.sn, 0) + 2.0::DOUBLE) - 0.5::DOUBLE AS h2h_surface_advantage,
  {', '.join(f"(p.surface = '{s}')::SMALLINT AS is_{s}" for s in FORM_SURFACES)}, coalesce(p.is_indoor, 0)::SMALLINT AS is_indoor, coalesce(p.best_of, 3)::SMALLINT AS best_of,
  {case('p.tournament', TOURNAMENT_LEVEL)} AS tournament_level, {case('p.round', ROUND_LEVEL)} AS round_encoded
FROM sides p JOIN sides o ON o.match_id = p.match_id AND o.player_id = p.opponent_id LEFT JOIN h2h h ON h.match_id = p.match_id AND h.player_id = p.player_id""",
    }


TABLES = standins.SQL | _tables()
NEEDS = {
    "player_profiles": (), "match_events": (), "rankings": ("player_profiles",), "pm": ("match_events",), "rf": ("pm",), "ta": ("rf", "pm", "player_profiles"),
    "lp": ("player_profiles", "pm", "rf", "rankings"), "sides": ("pm", "match_events", "player_profiles", "ta", "rf"), "h2h": ("pm", "match_events"), "mf": ("sides", "h2h"),
}


def with_tables(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """``body`` under the common tables that it and they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS[n]:
            need(x)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = [f"{n} AS MATERIALIZED ({TABLES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def rounded(body: str, columns: Iterable[str], places: int = 6) -> str:
    """The rows of ``body`` with the columns as doubles to ``places``."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, {places}) + 0.0::DOUBLE AS {c}' for c in columns)}) FROM ({body})"


DOUBLES = {
    "rf": ("latest_player_age", *(c for c in SNAPSHOT_VALUES if not c.startswith("latest") and c != "streak")),
    "mf": (*DIFF_COLS, *(c for c in (*FEATURE_COLS, *SIMILARITY_COLS) if c.endswith(("form_10", "handed", "pro", "pct_10", "advantage")) and c not in DIFF_COLS)),
}
