"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from ..sources.contest import CONTEST_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SERIES_SQL = """
tallies AS (SELECT series_id, min(date) AS date, min(season) AS season, min(patch) AS patch, min(team_a) AS team_a, min(team_b) AS team_b, min(league_a) AS league_a, min(league_b) AS league_b,
  min(tier) AS tier, max(best_of) AS declared, count(*) AS games, count(*) FILTER (winner = team_a) AS wins_a, count(*) FILTER (winner = team_b) AS wins_b, arg_max(winner, game_number) AS last_winner
  FROM games GROUP BY series_id),
formats AS (SELECT *, CAST(CASE WHEN greatest(games, greatest(wins_a, wins_b) * 2 - 1) > declared THEN CASE WHEN greatest(games, greatest(wins_a, wins_b) * 2 - 1) <= 3 THEN greatest(games, greatest(wins_a, wins_b) * 2 - 1) ELSE 5 END ELSE declared END AS BIGINT) AS best_of FROM tallies),
series AS (SELECT * EXCLUDE (declared), CASE WHEN greatest(wins_a, wins_b) > best_of // 2 OR games >= best_of THEN 'completed' ELSE 'ongoing' END AS state,
  CASE WHEN wins_a > wins_b THEN team_a WHEN wins_b > wins_a THEN team_b END AS winner FROM formats)"""
SIDES_SQL = """
sides AS (SELECT * EXCLUDE (team_a, team_b, league_a, league_b), CAST(1 AS BIGINT) AS side_no, team_a AS team, team_b AS opponent, league_a AS league, league_b AS opponent_league FROM games
  UNION ALL SELECT * EXCLUDE (team_a, team_b, league_a, league_b), CAST(2 AS BIGINT), team_b, team_a, league_b, league_a FROM games)"""
SERIES_SIDES_SQL = SIDES_SQL.replace("sides AS", "series_sides AS").replace("FROM games", "FROM series")
RECORDS_SQL = """
records AS (SELECT team, min(league) AS league, count(*) AS games, count(*) FILTER (winner = team) AS wins, max(date) AS last_date,
  floor((1500.0 + 400.0 * ((count(*) FILTER (winner = team) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) - 0.5::DOUBLE)) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS rating FROM sides GROUP BY team)"""
PARTS = {"series": SERIES_SQL, "sides": SIDES_SQL, "series_sides": SERIES_SIDES_SQL, "records": RECORDS_SQL}


def query(name: str, sql: str | None = None, parts: str = ""):
    """Register a query. ``parts`` names the expressions that its SQL stands on after the games; SQL that begins with ``,`` adds its own, and SQL that begins with ``WITH`` stands alone."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None and sql.startswith("WITH"):
            ORACLES[name] = sql
        elif sql is not None:
            ORACLES[name] = "WITH RECURSIVE " + ",".join([CONTEST_SQL, *(PARTS[p] for p in parts.split())]) + "\n" + sql
        return fn

    return add
