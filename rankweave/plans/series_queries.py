"""Series, scopes and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import LEAGUE_K
from ..operators import series as S
from ..sources.contest import contest_games
from .registry import query


@query("d1_series_key", "SELECT series_id, game_number, concat_ws('|', strftime(date, '%Y-%m-%d'), least(team_a, team_b) || '~' || greatest(team_a, team_b), tier) AS series_key FROM games")
def d1_series_key(spark, sf_dir):
    return S.series_key(contest_games(spark, sf_dir)).select("series_id", "game_number", "series_key")


@query("d2_series_resolution", "SELECT series_id, date, season, team_a, team_b, tier, games, wins_a, wins_b, last_winner, best_of, state, winner FROM series", "series")
def d2_series_resolution(spark, sf_dir):
    return S.resolve_series(contest_games(spark, sf_dir)).select("series_id", "date", "season", "team_a", "team_b", "tier", "games", "wins_a", "wins_b", "last_winner", "best_of", "state", "winner")


@query("d5_state_counts", "SELECT tier, best_of, state, count(*) AS n, count(*) FILTER (winner IS NULL) AS ties FROM series GROUP BY ALL", "series")
def d5_state_counts(spark, sf_dir):
    return S.resolve_series(contest_games(spark, sf_dir)).groupBy("tier", "best_of", "state").agg(F.count("*").alias("n"), F.count_if(F.col("winner").isNull()).alias("ties"))


@query("d7_outcomes", "SELECT series_id, team, opponent, CASE WHEN winner IS NULL THEN 0.5::DOUBLE WHEN winner = team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome, CASE WHEN state = 'completed' AND best_of > 1 THEN 1.0::DOUBLE + least(0.18::DOUBLE, 0.06::DOUBLE * (best_of - games)) ELSE 1.0::DOUBLE END AS signal FROM series_sides", "series series_sides")
def d7_outcomes(spark, sf_dir):
    rows = S.sides(S.resolve_series(contest_games(spark, sf_dir)))
    signal = F.when((F.col("state") == "completed") & (F.col("best_of") > 1), 1.0 + F.least(F.lit(0.18), 0.06 * (F.col("best_of") - F.col("games")))).otherwise(1.0)
    return rows.select("series_id", "team", "opponent", S.outcome().alias("outcome"), signal.alias("signal"))


@query(
    "d8_streaks",
    """, marked AS (SELECT team, date, series_id, game_number, side_no, winner = team AS won, CASE WHEN (winner = team) IS NOT DISTINCT FROM lag(winner = team) OVER w THEN 0 ELSE 1 END AS step, row_number() OVER w AS rn FROM sides WINDOW w AS (PARTITION BY team ORDER BY date, series_id, game_number)),
numbered AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 ELSE step END) OVER (PARTITION BY team ORDER BY date, series_id, game_number ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT team, CAST(island AS BIGINT) AS island, bool_and(won) AS won, count(*) AS length, min(date) AS first_date, max(date) AS last_date FROM numbered GROUP BY team, island""",
    "sides",
)
def d8_streaks(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir)).select("team", "date", "series_id", "game_number", S.won().alias("won"))
    return S.islands(rows, ["team"], ["date", "series_id", "game_number"], "won").groupBy("team", "island").agg(F.bool_and("won").alias("won"), F.count("*").alias("length"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("d12_date_batches", "SELECT date, count(*) AS games, count(DISTINCT series_id) AS series, count(DISTINCT tier) AS tiers FROM games GROUP BY date")
def d12_date_batches(spark, sf_dir):
    return contest_games(spark, sf_dir).groupBy("date").agg(F.count("*").alias("games"), F.countDistinct("series_id").alias("series"), F.countDistinct("tier").alias("tiers"))


@query("d13_match_history", "SELECT team, series_id, date, wins_a + wins_b AS games, row_number() OVER (PARTITION BY team ORDER BY date, series_id) AS match_no FROM series_sides WHERE state = 'completed'", "series series_sides")
def d13_match_history(spark, sf_dir):
    rows = S.sides(S.resolve_series(contest_games(spark, sf_dir)).where("state = 'completed'"))
    return rows.select("team", "series_id", "date", (F.col("wins_a") + F.col("wins_b")).alias("games"), F.row_number().over(Window.partitionBy("team").orderBy("date", "series_id")).cast("long").alias("match_no"))


@query("c1_rated_filter", "SELECT league_a, league_b, count(*) AS games FROM games WHERE league_a IN ('ASIA', 'EUROPE', 'AMERICA') AND league_b IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY ALL")
def c1_rated_filter(spark, sf_dir):
    rated = ["ASIA", "EUROPE", "AMERICA"]
    return contest_games(spark, sf_dir).where(F.col("league_a").isin(rated) & F.col("league_b").isin(rated)).groupBy("league_a", "league_b").agg(F.count("*").alias("games"))


@query("c3_scope_filter", "SELECT series_id, game_number, winner FROM games WHERE season = 1996 AND tier = 'worlds-playoffs' AND (league_a = 'ASIA' OR league_b = 'ASIA')")
def c3_scope_filter(spark, sf_dir):
    from ..operators.scopes import in_scope

    return in_scope(contest_games(spark, sf_dir), season=1996, tier="worlds-playoffs", league="ASIA").select("series_id", "game_number", "winner")


@query("c6_cumulative_scope", "SELECT s.season, count(*) AS games, count(DISTINCT g.series_id) AS series FROM (SELECT DISTINCT season FROM games) s JOIN games g ON g.season <= s.season GROUP BY s.season")
def c6_cumulative_scope(spark, sf_dir):
    games = contest_games(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("s"))
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    # A series lies in one season, so running sums of a row a season count distinct series.
    return games.select("season", F.sum("n").over(w).alias("games"), F.sum("s").over(w).alias("series"))


@query("c7_region_membership", "SELECT league, count(*) AS games, count(DISTINCT series_id) AS series FROM (SELECT DISTINCT series_id, game_number, league FROM sides) GROUP BY league", "sides")
def c7_region_membership(spark, sf_dir):
    rows = contest_games(spark, sf_dir).select("series_id", F.explode(F.array_distinct(F.array("league_a", "league_b"))).alias("league"))
    return rows.groupBy("league").agg(F.count("*").alias("games"), F.countDistinct("series_id").alias("series"))


@query("c8_scope_lattice", "SELECT season, tier, league_a AS league, count(*) AS games FROM games GROUP BY GROUPING SETS ((), (season), (tier), (league_a), (season, tier))")
def c8_scope_lattice(spark, sf_dir):
    from ..operators.scopes import scope_lattice

    return scope_lattice(contest_games(spark, sf_dir).withColumnRenamed("league_a", "league"))


@query(
    "c9_checkpoints",
    """, ends AS (SELECT season, tier, max(date) AS end_date FROM games WHERE tier IN ('worlds-playoffs', 'msi-bracket', 'major-playoffs') GROUP BY ALL)
SELECT season, tier, end_date, lag(end_date) OVER (ORDER BY end_date, tier) + 1 AS start_date FROM ends""",
)
def c9_checkpoints(spark, sf_dir):
    from ..operators.scopes import checkpoints

    return checkpoints(contest_games(spark, sf_dir))


@query(
    "c5_checkpoint_windows",
    """, ends AS (SELECT season, max(date) AS end_date FROM games WHERE tier = 'worlds-playoffs' GROUP BY ALL), spans AS (SELECT season, end_date, coalesce(lag(end_date) OVER (ORDER BY end_date) + 1, DATE '1900-01-01') AS start_date FROM ends)
SELECT s.season, count(*) AS games, count(DISTINCT g.team_a) AS teams FROM spans s JOIN games g ON g.date BETWEEN s.start_date AND s.end_date GROUP BY s.season""",
)
def c5_checkpoint_windows(spark, sf_dir):
    from ..operators.scopes import assign_windows

    games = contest_games(spark, sf_dir)
    return assign_windows(games, games.where("tier = 'worlds-playoffs'").groupBy("season").agg(F.max("date").alias("end_date"))).groupBy("scope").agg(F.count("*").alias("games"), F.countDistinct("team_a").alias("teams")).withColumnRenamed("scope", "season")


@query("c13_event_predicates", "SELECT tier, count(*) FILTER (league_a <> league_b) AS cross_league, count(*) FILTER (tier LIKE 'worlds%' OR tier LIKE 'msi%') AS international, count(*) FILTER (side_a IS NOT NULL) AS side_known, count(*) AS games FROM games GROUP BY tier")
def c13_event_predicates(spark, sf_dir):
    international = F.col("tier").isin([t for t, k in LEAGUE_K.items() if k])
    return contest_games(spark, sf_dir).groupBy("tier").agg(F.count_if(F.col("league_a") != F.col("league_b")).alias("cross_league"), F.count_if(international).alias("international"), F.count_if(F.col("side_a").isNotNull()).alias("side_known"), F.count("*").alias("games"))


@query("c14_board_filter", "SELECT team, league, games, wins, rating FROM records WHERE contains(lower(team || ' ' || league), 'am')", "sides records")
def c14_board_filter(spark, sf_dir):
    return S.team_records(contest_games(spark, sf_dir)).where(F.contains(F.lower(F.concat_ws(" ", "team", "league")), F.lit("am"))).select("team", "league", "games", "wins", "rating")
