"""The chronological replay and what is built on it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import half_up
from ..operators import metrics, replay, series
from ..sources.contest import contest_games
from .analysis_queries import METRICS, r4
from .registry import PARTS, query

_K = "CASE s.tier WHEN 'worlds-playoffs' THEN 34 WHEN 'msi-bracket' THEN 34 WHEN 'major-playoffs' THEN 22 WHEN 'regional-regular' THEN 14 ELSE 12 END::DOUBLE"
_P = r4("1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (b.rating - a.rating) / 400.0::DOUBLE))")
_DECAY = r4("1500.0::DOUBLE + (rating - 1500.0::DOUBLE) * CASE WHEN q.gap > 0 THEN 0.62::DOUBLE + 0.38::DOUBLE * exp(-q.gap * 30.0::DOUBLE / 180.0::DOUBLE) ELSE 1.0::DOUBLE END")
PARTS["replayed"] = f"""
dated AS (SELECT *, year(date) * 12 + month(date) - 1 AS period FROM series_sides WHERE state = 'completed'),
periods AS (SELECT period, row_number() OVER (ORDER BY period) AS i, coalesce(period - lag(period) OVER (ORDER BY period), 0) AS gap FROM (SELECT DISTINCT year(date) * 12 + month(date) - 1 AS period FROM series)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, team, 1500.0::DOUBLE AS rating, 140.0::DOUBLE AS uncertainty, 1500.0::DOUBLE AS frozen FROM (SELECT DISTINCT team FROM series_sides)
  UNION ALL
  SELECT n.i, n.team, n.rating + coalesce(d.delta, 0), {r4('greatest(20.0::DOUBLE, n.uncertainty - coalesce(d.lost, 0))')}, n.rating
  FROM (SELECT q.i, w.team, {_DECAY} AS rating, w.uncertainty FROM walk w JOIN periods q ON q.i = w.i + 1) n
  LEFT JOIN (SELECT s.team, sum(floor({_K} * greatest(0.75::DOUBLE, least(1.75::DOUBLE, 1.0::DOUBLE + (a.uncertainty - 50.0::DOUBLE) / 100.0::DOUBLE)) * CASE WHEN s.best_of > 1 THEN 1.0::DOUBLE + least(0.18::DOUBLE, 0.06::DOUBLE * (s.best_of - s.games)) ELSE 1.0::DOUBLE END * 0.9::DOUBLE
      * (CASE WHEN s.winner IS NULL THEN 0.5::DOUBLE WHEN s.winner = s.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - {_P}) + 0.5::DOUBLE)) AS delta,
      CAST(sum(CAST({r4(f"5.0::DOUBLE + 8.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_K} - 12.0::DOUBLE) / 22.0::DOUBLE)) + CASE WHEN s.league <> s.opponent_league AND s.tier IN ('worlds-playoffs', 'msi-bracket') THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END")} AS DECIMAL(18,4))) AS DOUBLE) AS lost
    FROM (SELECT q.i, w.team, {_DECAY} AS rating, w.uncertainty FROM walk w JOIN periods q ON q.i = w.i + 1) a
    JOIN periods t ON t.i = a.i JOIN dated s ON s.period = t.period AND s.team = a.team
    JOIN (SELECT w.team, {_DECAY} AS rating FROM walk w JOIN periods q ON q.i = w.i + 1) b ON b.team = s.opponent GROUP BY s.team) d ON d.team = n.team),
scored AS (SELECT s.series_id, s.team, s.opponent, s.side_no, {_P} AS p, CASE WHEN s.winner IS NULL THEN 0.5::DOUBLE WHEN s.winner = s.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed
  FROM dated s JOIN periods t ON s.period = t.period JOIN (SELECT i, team, frozen AS rating FROM walk) a ON a.i = t.i AND a.team = s.team JOIN (SELECT i, team, frozen AS rating FROM walk) b ON b.i = t.i AND b.team = s.opponent)"""


def replayed(spark, sf_dir):
    return replay.replay(series.resolve_series(contest_games(spark, sf_dir)))


@query("l2_replay_standings", f"SELECT team, {r4('rating', 2)} AS rating, {r4('uncertainty', 2)} AS uncertainty, row_number() OVER (ORDER BY {r4('rating', 2)} DESC, team) AS rank FROM walk WHERE i = (SELECT max(i) FROM walk)", "series series_sides replayed")
def l2_replay_standings(spark, sf_dir):
    state, _ = replayed(spark, sf_dir)
    out = state.select("team", half_up(F.col("rating"), 2).alias("rating"), half_up(F.col("uncertainty"), 2).alias("uncertainty"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rating").desc(), "team")).cast("long"))


@query("l6_walk_forward", "SELECT series_id, team, opponent, p, observed FROM scored", "series series_sides replayed")
def l6_walk_forward(spark, sf_dir):
    return replayed(spark, sf_dir)[1].select("series_id", "team", "opponent", "p", "observed")


@query("f20_backtest", f"SELECT {METRICS} FROM (SELECT p, CAST(observed AS INTEGER) AS y FROM scored WHERE observed <> 0.5)", "series series_sides replayed")
def f20_backtest(spark, sf_dir):
    rows = replayed(spark, sf_dir)[1].where("observed <> 0.5")
    return metrics.forecast_metrics(rows.select("p", F.col("observed").cast("int").alias("y")))


# By UTC date instead of month, with gaps in days.
PARTS["replayed_by_date"] = PARTS["replayed"].replace("year(date) * 12 + month(date) - 1", "date - DATE '1970-01-01'").replace("q.gap * 30.0::DOUBLE", "q.gap")


def replayed_by_date(spark, sf_dir):
    return replay.replay_by_date(series.resolve_series(contest_games(spark, sf_dir)))


@query("l2_replay_standings_daily", f"SELECT team, {r4('rating', 2)} AS rating, {r4('uncertainty', 2)} AS uncertainty, row_number() OVER (ORDER BY {r4('rating', 2)} DESC, team) AS rank FROM walk WHERE i = (SELECT max(i) FROM walk)", "series series_sides replayed_by_date")
def l2_replay_standings_daily(spark, sf_dir):
    state, _ = replayed_by_date(spark, sf_dir)
    out = state.select("team", half_up(F.col("rating"), 2).alias("rating"), half_up(F.col("uncertainty"), 2).alias("uncertainty"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rating").desc(), "team")).cast("long"))


@query("l6_walk_forward_daily", "SELECT series_id, team, opponent, p, observed FROM scored", "series series_sides replayed_by_date")
def l6_walk_forward_daily(spark, sf_dir):
    return replayed_by_date(spark, sf_dir)[1].select("series_id", "team", "opponent", "p", "observed")


@query("f20_backtest_daily", f"SELECT {METRICS} FROM (SELECT p, CAST(observed AS INTEGER) AS y FROM scored WHERE observed <> 0.5)", "series series_sides replayed_by_date")
def f20_backtest_daily(spark, sf_dir):
    rows = replayed_by_date(spark, sf_dir)[1].where("observed <> 0.5")
    return metrics.forecast_metrics(rows.select("p", F.col("observed").cast("int").alias("y")))
