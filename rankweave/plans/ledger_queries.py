"""The ledger of a replay by quarters, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import series as S
from ..operators import variants as V
from ..operators.storage import new_path, write_back
from ..sources.contest import contest_games, stored_games
from .analysis_queries import METRICS, r4
from .model_queries import pregame_edges
from .registry import PARTS, query

MONTHS = 3
_K = "CASE tier WHEN 'worlds-playoffs' THEN 34 WHEN 'msi-bracket' THEN 34 WHEN 'major-playoffs' THEN 22 WHEN 'regional-regular' THEN 14 ELSE 12 END::DOUBLE"
_D = lambda x: f"{x}::DOUBLE"
_HELD = lambda c: r4(f"1500.0::DOUBLE + (w.{c} - 1500.0::DOUBLE) * CASE WHEN q.gap > 0 THEN 0.62::DOUBLE + 0.38::DOUBLE * exp(-q.gap * {30 * MONTHS}.0::DOUBLE / 180.0::DOUBLE) ELSE 1.0::DOUBLE END")
_CHANCE = lambda a, b: r4(f"1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (({b}) - ({a})) / 400.0::DOUBLE))")
_NOW = f"(SELECT q.i, q.period, w.team, {_HELD('r')} AS r, CASE WHEN q.fresh THEN 0.0::DOUBLE ELSE w.m END AS m, w.u, {_HELD('x')} AS x, w.r AS old_r, w.m AS old_m FROM ledger_walk w JOIN batches q ON q.i = w.i + 1)"
_SUM = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"


def _moves(own: str, other: str) -> str:
    """What side rows ``s`` give from the frozen states of both sides; ``reach`` is execution after the first k games."""
    p = _CHANCE(f"{own}.r + {own}.m", f"{other}.r + {other}.m")
    evidence = f"s.k * greatest(0.75::DOUBLE, least(1.75::DOUBLE, 1.0::DOUBLE + ({own}.u - 50.0::DOUBLE) / 100.0::DOUBLE)) * s.signal * (s.observed - {p})"
    return f"CASE WHEN s.done THEN floor({evidence} * 0.9::DOUBLE + 0.5::DOUBLE) ELSE 0.0::DOUBLE END AS stable, CASE WHEN s.done THEN {r4(evidence + ' * 0.1::DOUBLE')} ELSE 0.0::DOUBLE END AS form"


def _reach(own: str, other: str, games: str) -> str:
    step = lambda g, a, ma, b, mb: f"floor(s.game_k * ({g} - {_CHANCE(f'{a} + {ma}', f'{b} + {mb}')}) + 0.5::DOUBLE)"
    return f"list_reduce(list_prepend(struct_pack(g := CAST(0 AS BIGINT), o := 0.0::DOUBLE, t := 0.0::DOUBLE, e := {own}.x, f := {other}.x), {games}), lambda y, z: struct_pack(g := z.g, o := z.o, t := z.t, e := y.e + {step('z.o', 'y.e', f'{own}.m', 'y.f', f'{other}.m')}, f := y.f + {step('z.t', 'y.f', f'{other}.m', 'y.e', f'{own}.m')}))"


_SOFT = lambda won, sign: r4(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.75::DOUBLE * CASE WHEN {won} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.25::DOUBLE * (0.5::DOUBLE + {sign}ix)))", 6)
_FADE = r4("n.m * (pow(0.88::DOUBLE, CAST(coalesce(v.n, 0) AS DOUBLE)) - 1.0::DOUBLE)")
PARTS["ledger"] = f"""
indexed AS (SELECT *, least(0.25::DOUBLE, greatest(-0.25::DOUBLE, (CAST(kills AS DOUBLE) - 25.0::DOUBLE) / greatest(CAST(kills AS DOUBLE) + 25.0::DOUBLE, 1.0::DOUBLE) * 0.14::DOUBLE + (CAST(gold AS DOUBLE) - 38000.0::DOUBLE) / greatest(CAST(gold AS DOUBLE) + 38000.0::DOUBLE, 1.0::DOUBLE) * 0.72::DOUBLE + 0.0::DOUBLE)) AS ix FROM games),
soft AS (SELECT series_id, game_number, {_SOFT('winner = team_a', '')} AS sa, {_SOFT('winner <> team_a', '-')} AS sb FROM indexed),
played AS (SELECT series_id, list(struct_pack(g := game_number, o := sa, t := sb, e := 0.0::DOUBLE, f := 0.0::DOUBLE) ORDER BY game_number) AS ga, list(struct_pack(g := game_number, o := sb, t := sa, e := 0.0::DOUBLE, f := 0.0::DOUBLE) ORDER BY game_number) AS gb FROM soft GROUP BY series_id),
ledger_sides AS (SELECT s.series_id, (year(s.date) * 12 + month(s.date) - 1) // {MONTHS} AS period, s.team, s.opponent, s.state = 'completed' AS done, CASE WHEN s.winner IS NULL THEN 0.5::DOUBLE WHEN s.winner = s.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed, {_K} AS k,
  CASE WHEN s.best_of > 1 THEN 1.0::DOUBLE + least(0.18::DOUBLE, 0.06::DOUBLE * (s.best_of - s.games)) ELSE 1.0::DOUBLE END AS signal, {r4(f"5.0::DOUBLE + 8.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_K} - 12.0::DOUBLE) / 22.0::DOUBLE)) + CASE WHEN s.league <> s.opponent_league AND s.tier IN ('worlds-playoffs', 'msi-bracket') THEN 7.0::DOUBLE ELSE 0.0::DOUBLE END")} AS lost,
  {r4(f"{_K} / sqrt(CAST(greatest(s.best_of, 1) AS DOUBLE))", 6)} AS game_k, CASE s.side_no WHEN 1 THEN p.ga ELSE p.gb END AS gl FROM series_sides s JOIN played p ON p.series_id = s.series_id),
batches AS (SELECT period, row_number() OVER (ORDER BY period) AS i, coalesce(period - lag(period) OVER (ORDER BY period), 0) AS gap, coalesce(period * {MONTHS} // 12 <> lag(period) OVER (ORDER BY period) * {MONTHS} // 12, false) AS fresh FROM (SELECT DISTINCT period FROM ledger_sides)),
ledger_walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS period, team, 1500.0::DOUBLE AS r, 0.0::DOUBLE AS m, 140.0::DOUBLE AS u, 1500.0::DOUBLE AS x, 0.0::DOUBLE AS old_r, 0.0::DOUBLE AS old_m, 0.0::DOUBLE AS fr, 0.0::DOUBLE AS fm, 0.0::DOUBLE AS fu, 0.0::DOUBLE AS fx, 0.0::DOUBLE AS form, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT team FROM ledger_sides)
  UNION ALL SELECT n.i, CAST(n.period AS BIGINT), n.team, n.r + coalesce(v.stable, 0.0::DOUBLE), {r4(f"least(70.0::DOUBLE, greatest(-70.0::DOUBLE, n.m + {_FADE} + coalesce(v.form, 0.0::DOUBLE)))")}, {r4("greatest(20.0::DOUBLE, n.u - coalesce(v.lost, 0.0::DOUBLE))")}, n.x + coalesce(v.moved, 0.0::DOUBLE), n.old_r, n.old_m, n.r, n.m, n.u, n.x, coalesce(v.form, 0.0::DOUBLE), coalesce(v.n, 0)
  FROM {_NOW} n LEFT JOIN (SELECT team, {_SUM('stable')} AS stable, {_SUM('form')} AS form, {_SUM('lost')} AS lost, {_SUM('moved')} AS moved, count(*) FILTER (done) AS n FROM (SELECT s.team, s.done, CASE WHEN s.done THEN s.lost ELSE 0.0::DOUBLE END AS lost, {_moves('a', 'b')}, {_reach('a', 'b', 's.gl')}.e - a.x AS moved
    FROM {_NOW} a JOIN ledger_sides s ON s.period = a.period AND s.team = a.team JOIN {_NOW} b ON b.team = s.opponent) GROUP BY team) v ON v.team = n.team),
frozen_sides AS (SELECT i, period, team, fr AS r, fm AS m, fu AS u, fx AS x FROM ledger_walk WHERE i > 0),
ledger_moves AS (SELECT s.series_id, s.period, s.team, s.done, s.lost, s.gl, {_moves('a', 'b')}, list_transform(range(0, len(s.gl) + 1), lambda c: {_reach('a', 'b', 's.gl[1:c]')}.e) AS ends, list_transform(range(0, len(s.gl) + 1), lambda c: {_reach('a', 'b', 's.gl[1:c]')}.f) AS others, a.m AS am, b.m AS bm
  FROM ledger_sides s JOIN frozen_sides a ON a.period = s.period AND a.team = s.team JOIN frozen_sides b ON b.period = s.period AND b.team = s.opponent),
by_game AS (SELECT series_id, gl[c].g AS game_number, team, done AND c = len(gl) AS final, stable, form, lost, {_CHANCE('ends[c] + am', 'others[c] + bm')} AS execution_expected, floor(ends[c + 1] - ends[c] + 0.5::DOUBLE) AS execution_delta FROM (SELECT *, unnest(range(1, len(gl) + 1)) AS c FROM ledger_moves))"""


def ledger_of(spark, sf_dir, games=None):
    games = stored_games(spark, sf_dir) if games is None else games
    sides_ = games.select("series_id", "game_number", "winner", F.col("kills").alias("kills_a"), F.lit(25).alias("kills_b"), F.col("gold").alias("gold_a"), F.lit(38000).alias("gold_b"), F.lit(0).alias("objectives_a"), F.lit(0).alias("objectives_b"))
    return L.replay_ledger(S.resolve_series(games), sides_, MONTHS)


@query("l9_member_ledger", "SELECT series_id, game_number, team, CASE WHEN final THEN 'series-atomic' ELSE 'series-member-no-team-update' END AS unit, CASE WHEN final THEN stable ELSE 0.0 END AS stable_delta, CASE WHEN final THEN form ELSE 0.0 END AS form_delta, CASE WHEN final THEN -lost ELSE 0.0 END AS uncertainty_delta, execution_expected, execution_delta FROM by_game", "series series_sides ledger")
def l9_member_ledger(spark, sf_dir):
    """What every game gave both sides, by component, with the execution channel moving within each series."""
    return ledger_of(spark, sf_dir)[0].drop("period")


_TOTALS = f""", e AS (SELECT team, {_SUM('CASE WHEN final THEN stable ELSE 0.0 END')} AS stable_delta, {_SUM('CASE WHEN final THEN form ELSE 0.0 END')} AS form_delta, {_SUM('execution_delta')} AS execution_delta FROM by_game GROUP BY team),
faded AS (SELECT *, {_FADE.replace('n.m', 'fm').replace('coalesce(v.n, 0)', 'n')} AS fade FROM ledger_walk WHERE i > 0),
b AS (SELECT team, {_SUM(r4('fr - old_r'))} AS decay_delta, {_SUM(r4('fm - old_m'))} AS season_delta, {_SUM('fade')} AS fade_delta, {_SUM(r4('m - fm - fade - form'))} AS cap_delta FROM faded GROUP BY team),
last AS (SELECT team, r, m, x FROM ledger_walk WHERE i = (SELECT max(i) FROM ledger_walk))
SELECT l.team, stable_delta, form_delta, decay_delta, season_delta, fade_delta, cap_delta, execution_delta, {r4('r + m')} AS published, {r4('x')} AS execution, 0.0::DOUBLE AS gap FROM last l JOIN e ON e.team = l.team JOIN b ON b.team = l.team"""


@query("p11_ledger_totals", _TOTALS, "series series_sides ledger")
def p11_ledger_totals(spark, sf_dir):
    """Every team's components over the whole replay, and its published rating, which they lead to without a gap."""
    return L.reconciled(*ledger_of(spark, sf_dir))


# Forecasts of every series from the state of the ledger's replay at the start of its batch.

_BLUE = lambda b, n: f"400.0::DOUBLE / ln(10.0::DOUBLE) * ln(({b} + 0.5::DOUBLE) / ({n} - {b} + 0.5::DOUBLE)) * ({n} / ({n} + 24.0::DOUBLE))"
PARTS["side_edges"] = f"""
side_days AS (SELECT patch, date, count(*) FILTER ((side_a = 'blue') = (winner = team_a)) AS b, count(*) AS n FROM games WHERE side_a IS NOT NULL GROUP BY ALL),
side_before AS (SELECT d.patch, d.date, coalesce(sum(s.b) FILTER (s.patch = d.patch), 0) AS pb, coalesce(sum(s.n) FILTER (s.patch = d.patch), 0) AS pn, coalesce(sum(s.b), 0) AS ab, coalesce(sum(s.n), 0) AS an FROM (SELECT DISTINCT patch, date FROM games) d LEFT JOIN side_days s ON s.date < d.date GROUP BY ALL),
side_edges AS (SELECT patch, date, {r4(f"CASE WHEN pn > 0 THEN {_BLUE('pb', 'pn')} WHEN an > 0 THEN {_BLUE('ab', 'an')} ELSE 0.0::DOUBLE END")} AS edge FROM side_before)"""


def _points(own: str, other: str) -> str:
    return r4(f"list_transform([0.5::DOUBLE + (1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (({other}) - ({own})) / 360.0::DOUBLE)) - 0.5::DOUBLE) * greatest(0.45::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - sqrt(a.u * a.u + b.u * b.u) / 620.0::DOUBLE))], lambda p: CASE WHEN a.best_of <= 2 THEN p WHEN a.best_of <= 4 THEN p * p * (3.0::DOUBLE - 2.0::DOUBLE * p) ELSE p * p * p * (10.0::DOUBLE - 15.0::DOUBLE * p + 6.0::DOUBLE * p * p) END)[1]")


_RATED = {
    "published": "{0}.r + {0}.prior + {0}.m + {0}.side_points",
    "team_only": "{0}.r",
    "player_adjusted": "{0}.r + coalesce({0}.edge, 0.0::DOUBLE) + {0}.m",
    "execution_baseline": "{0}.r + {0}.prior + {0}.m",
    "execution_adjusted": "{0}.r + {0}.prior + {0}.m + {0}.x - {0}.r",
}
PARTS["forecasts"] = f"""
prior_told AS (SELECT s.series_id, s.team, s.opponent, s.date, s.patch, s.best_of, s.side_no, s.winner, g.edge FROM series_sides s LEFT JOIN edges g ON g.game = s.series_id AND g.team = s.team WHERE s.state = 'completed'),
last_told AS (SELECT team, date, edge FROM prior_told QUALIFY row_number() OVER (PARTITION BY team, date ORDER BY series_id DESC) = 1),
held AS (SELECT team, date, last_value(edge IGNORE NULLS) OVER (PARTITION BY team ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM last_told),
firsts AS (SELECT series_id, max(side_a) FILTER (game_number = 1) AS side_a FROM games GROUP BY series_id),
rated AS (SELECT t.*, coalesce(t.edge, h.held, 0.0::DOUBLE) AS prior, CASE WHEN f.side_a IS NULL THEN 0.0::DOUBLE WHEN (f.side_a = 'blue') = (t.side_no = 1) THEN e.edge * 0.5::DOUBLE ELSE e.edge * -0.5::DOUBLE END AS side_points, z.r, z.m, z.u, z.x
  FROM prior_told t JOIN held h ON h.team = t.team AND h.date = t.date JOIN firsts f ON f.series_id = t.series_id JOIN side_edges e ON e.patch = t.patch AND e.date = t.date JOIN frozen_sides z ON z.team = t.team AND z.period = (year(t.date) * 12 + month(t.date) - 1) // {MONTHS}),
forecasts AS (SELECT a.series_id, a.team, a.opponent, CASE WHEN a.winner IS NULL THEN 0.5::DOUBLE WHEN a.winner = a.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed, {", ".join(f"{_points(v.format('a'), v.format('b'))} AS {k}" for k, v in _RATED.items())} FROM rated a JOIN rated b ON b.series_id = a.series_id AND b.team = a.opponent)"""
_PARTS = "series series_sides ledger lines pairs player_walk frozen_players edges side_edges forecasts"


@query("l8_side_edges", "SELECT patch, date, edge FROM side_edges", "side_edges")
def l8_side_edges(spark, sf_dir):
    """What the blue side was worth before each date of each patch."""
    return V.side_edges(contest_games(spark, sf_dir))


def five_forecasts(spark, sf_dir):
    path = new_path(spark, "forecasts")
    games = stored_games(spark, sf_dir)
    _, batches, _ = ledger_of(spark, sf_dir, games)
    frozen = batches.select("period", "team", F.col("frozen_rating").alias("power"), *[F.col(f"frozen_{c}").alias(c) for c in ("rating", "momentum", "uncertainty", "execution")])
    first = games.groupBy("series_id").agg(F.max(F.when(F.col("game_number") == 1, F.col("side_a"))).alias("side_a"))
    period = F.floor((F.year("date") * 12 + F.month("date") - 1) / MONTHS).cast("long")
    series = S.resolve_series(games).join(first, "series_id").withColumn("period", period)
    edges = pregame_edges(spark, sf_dir, games).withColumnRenamed("game", "series_id")
    # The forecasts read each of them several times.
    series, frozen, edges, blue = (write_back(df, f"{path}/{name}") for name, df in (("series", series), ("frozen", frozen), ("edges", edges), ("blue", V.side_edges(games))))
    return V.forecasts(series, frozen, edges, blue)


@query("l6_five_forecasts", "SELECT * FROM forecasts", _PARTS)
def l6_five_forecasts(spark, sf_dir):
    """Both sides of every completed series by all five variants of the forecast."""
    return five_forecasts(spark, sf_dir)


@query("f20_five_variants", f"SELECT variant, {METRICS} FROM (SELECT CAST(observed AS INTEGER) AS y, variant, p FROM (UNPIVOT forecasts ON {', '.join(_RATED)} INTO NAME variant VALUE p) WHERE observed <> 0.5) GROUP BY variant", _PARTS)
def f20_five_variants(spark, sf_dir):
    """Accuracy, Brier score and log loss of the five variants over all decided series."""
    return M.forecast_metrics(V.by_variant(five_forecasts(spark, sf_dir)), "variant")
