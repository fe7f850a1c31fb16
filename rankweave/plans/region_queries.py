"""Regions, head-to-head and causal prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile, regions, series
from ..sources.contest import contest_games
from .analysis_queries import r4
from .registry import query


@query(
    "m10_region_resumes",
    f""", abroad AS (SELECT league, count(*) AS series, CAST(sum(CAST(CASE WHEN winner IS NULL THEN 0.5 WHEN winner = team THEN 1 ELSE 0 END AS DECIMAL(18,1))) AS DOUBLE) AS points FROM series_sides WHERE state = 'completed' AND league <> opponent_league GROUP BY league),
top AS (SELECT league, rating FROM records QUALIFY row_number() OVER (PARTITION BY league ORDER BY rating DESC, team) <= 4), depth AS (SELECT league, {r4('CAST(sum(CAST(rating AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 2)} AS top4 FROM top GROUP BY league),
scored AS (SELECT a.league, series, points, {r4('1500.0::DOUBLE + series::DOUBLE / (series::DOUBLE + 8.0::DOUBLE) * (1500.0::DOUBLE + 400.0::DOUBLE * (points / series::DOUBLE - 0.5::DOUBLE) - 1500.0::DOUBLE)', 2)} AS score, top4 FROM abroad a JOIN depth d ON a.league = d.league)
SELECT *, row_number() OVER (ORDER BY score DESC, league) AS rank FROM scored""",
    "sides records series series_sides",
)
def m10_region_resumes(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    return regions.region_resumes(series.resolve_series(games), series.team_records(games))


@query(
    "l13_head_to_head",
    "SELECT least(team_a, team_b) AS first_team, greatest(team_a, team_b) AS second_team, count(*) AS meetings, CAST(sum(CASE WHEN winner IS NULL THEN 0 WHEN winner = least(team_a, team_b) THEN 1 ELSE -1 END) AS BIGINT) AS balance, max(date) AS latest, arg_max_null(winner, struct_pack(d := date, s := series_id)) AS last_winner FROM series GROUP BY 1, 2",
    "series",
)
def l13_head_to_head(spark, sf_dir):
    return regions.head_to_head(series.resolve_series(contest_games(spark, sf_dir)))


@query(
    "k13_causal_prefix",
    """, rows_ AS (SELECT series_id, date, season, winner, series_id % 97 = 5 AND season >= 1998 AS touched FROM series), f AS (SELECT min(date) AS d, count(*) AS n FROM rows_ WHERE touched)
SELECT (SELECT count(*) FROM rows_, f WHERE rows_.date < f.d) AS proven, n AS changed, d AS replay_from FROM f""",
    "series",
)
def k13_causal_prefix(spark, sf_dir):
    rows = series.resolve_series(contest_games(spark, sf_dir)).select("series_id", "date", "season", F.coalesce("winner", F.lit("tie")).alias("winner"))
    touched = (F.col("series_id") % 97 == 5) & (F.col("season") >= 1998)
    new = rows.withColumn("winner", F.when(touched, "another").otherwise(F.col("winner")))
    ledger = lambda df: reconcile.ledger(df.select("series_id", "date", "winner"), ["series_id", "date"])
    return reconcile.causal_prefix(ledger(rows), ledger(new), ["series_id"])
