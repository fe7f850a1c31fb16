"""Joins, aggregates, forecasts and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ratings as R
from ..functions.rounding import half_up
from ..operators import history as H
from ..operators import metrics as M
from ..operators import reconcile as X
from ..operators import series as S
from ..sources.contest import contest_games, table
from .history_queries import points, records
from .registry import PARTS, query

D = "::DOUBLE"


def r4(x, places=4):
    return f"(floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE)"


def game_p(a, b):
    return r4(f"1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, ({b} - {a}) / 360.0::DOUBLE))")


PARTS["predictions"] = f"""
predictions AS (SELECT g.*, {r4(f"0.5::DOUBLE + ({game_p('a.rating', 'b.rating')} - 0.5::DOUBLE) * {r4('greatest(0.45::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - sqrt(100.0::DOUBLE * 100.0::DOUBLE + 100.0::DOUBLE * 100.0::DOUBLE) / 620.0::DOUBLE))')}")} AS p,
  CASE WHEN g.winner = g.team_a THEN 1 ELSE 0 END AS y FROM games g JOIN records a ON g.team_a = a.team JOIN records b ON g.team_b = b.team)"""


def predictions(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    rated = S.team_records(games).select("team", "rating")
    a, b = rated.toDF("team_a", "rating_a"), rated.toDF("team_b", "rating_b")
    u = F.lit(100.0)
    # A row a team: the optimizer broadcasts both sides.
    joined = games.join(a, "team_a").join(b, "team_b")
    return joined.withColumns({"p": R.game_probability(F.col("rating_a"), F.col("rating_b"), u, u), "y": F.when(F.col("winner") == F.col("team_a"), 1).otherwise(0)})


def mean(x):
    return f"floor(CAST(sum(CAST(round({x}, 8) AS DECIMAL(20,8))) AS DOUBLE) / count({x}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"


METRICS = f"""count(*) AS n, {mean("CASE WHEN p = 0.5 THEN 0.5::DOUBLE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS accuracy, {mean("(p - y) * (p - y)")} AS brier,
  {mean("-(y * ln(greatest(0.001::DOUBLE, least(0.999::DOUBLE, p))) + (1.0::DOUBLE - y) * ln(1.0::DOUBLE - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p))))")} AS log_loss"""


@query("f15_forecast_metrics", f"SELECT {METRICS} FROM predictions", "sides records predictions")
def f15_forecast_metrics(spark, sf_dir):
    return M.forecast_metrics(predictions(spark, sf_dir))


@query("f16_calibration", f"SELECT least(90, CAST(floor(floor(greatest(p, 1.0::DOUBLE - p) * 1000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) * 10 AS BIGINT)) AS decile, count(*) AS n, {mean('greatest(p, 1.0::DOUBLE - p)')} AS mean_probability, {mean('CAST(CASE WHEN p >= 0.5 THEN y ELSE 1 - y END AS DOUBLE)')} AS hit_rate FROM predictions GROUP BY 1", "sides records predictions")
def f16_calibration(spark, sf_dir):
    return M.calibration(predictions(spark, sf_dir))


@query(
    "f17_segment_metrics",
    f""", tagged AS (SELECT *, unnest(list_filter([CASE WHEN league_a <> league_b THEN 'cross-league' END, CASE WHEN best_of >= 5 THEN 'long' END, CASE WHEN side_a IS NOT NULL THEN 'side-known' END, 'all'], lambda x: x IS NOT NULL)) AS segment FROM predictions)
SELECT segment, {METRICS} FROM tagged GROUP BY segment""",
    "sides records predictions",
)
def f17_segment_metrics(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(F.col("league_a") != F.col("league_b"), "cross-league"), F.when(F.col("best_of") >= 5, "long"), F.when(F.col("side_a").isNotNull(), "side-known"), F.lit("all")))
    return M.forecast_metrics(predictions(spark, sf_dir).withColumn("segment", F.explode(tags)), "segment")


@query("f18_baselines", f", variants AS (SELECT 'model' AS variant, p, y FROM predictions UNION ALL SELECT 'coin-flip', 0.5::DOUBLE, y FROM predictions) SELECT variant, {METRICS} FROM variants GROUP BY variant", "sides records predictions")
def f18_baselines(spark, sf_dir):
    each = F.explode(F.array(F.struct(F.lit("model").alias("variant"), F.col("p").alias("p")), F.struct(F.lit("coin-flip").alias("variant"), F.lit(0.5).alias("p"))))
    rows = predictions(spark, sf_dir).select("y", each.alias("v")).select("y", "v.*")
    return M.forecast_metrics(rows, "variant")


@query(
    "f1_event_summary",
    """, n AS (SELECT tier, team, count(*) AS c FROM sides GROUP BY ALL), top AS (SELECT tier, list(team ORDER BY c DESC, team) AS teams FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tier ORDER BY c DESC, team) <= 3) GROUP BY tier)
SELECT g.tier, count(*) AS games, min(date) AS first_date, max(date) AS last_date, array_to_string(any_value(top.teams), ',') AS top_teams FROM games g JOIN top ON g.tier = top.tier GROUP BY g.tier""",
    "sides",
)
def f1_event_summary(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    counts = S.sides(games).groupBy("tier", "team").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.col("c").desc(), "team"))
    top = counts.withColumn("r", rank).where("r <= 3").groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("r", "team"))).alias("t")).select("tier", F.array_join("t.team", ",").alias("top_teams"))
    return games.groupBy("tier").agg(F.count("*").alias("games"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).join(top, "tier")


@query(
    "f2_season_summary",
    """, s AS (SELECT season, team, count(*) FILTER (winner = team) AS wins, count(*) AS n FROM sides GROUP BY ALL), best AS (SELECT season, team AS top_team, wins AS top_wins FROM s QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, team) = 1)
SELECT g.season, count(*) AS games, count(DISTINCT tier) AS events, count(DISTINCT team_a) AS teams, any_value(top_team) AS top_team, any_value(top_wins) AS top_wins FROM games g JOIN best ON g.season = best.season GROUP BY g.season""",
    "sides",
)
def f2_season_summary(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    wins = S.sides(games).groupBy("season", "team").agg(F.count_if(S.won()).alias("wins"))
    best = wins.groupBy("season").agg(F.min(F.struct((-F.col("wins")).alias("w"), "team")).alias("b")).select("season", F.col("b.team").alias("top_team"), (-F.col("b.w")).alias("top_wins"))
    return games.groupBy("season").agg(F.count("*").alias("games"), F.countDistinct("tier").alias("events"), F.countDistinct("team_a").alias("teams")).join(best, "season")


@query("f4_region_strength", f"SELECT league, count(*) AS teams, {r4('avg(rating) FILTER (r <= 3)', 2)} AS top3, {r4('avg(rating)', 2)} AS mean_rating, rank() OVER (ORDER BY {r4('avg(rating) FILTER (r <= 3)', 2)} DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY rating DESC, team) AS r FROM records) GROUP BY league", "sides records")
def f4_region_strength(spark, sf_dir):
    ranked = records(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("league").orderBy(F.col("rating").desc(), "team")))
    out = ranked.groupBy("league").agg(F.count("*").alias("teams"), half_up(F.avg(F.when(F.col("r") <= 3, F.col("rating"))), 2).alias("top3"), half_up(F.avg("rating"), 2).alias("mean_rating"))
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.col("top3").desc())).cast("long"))


@query(
    "f8_region_history",
    f""", spine AS (SELECT d.date, t.team FROM (SELECT DISTINCT date FROM closes) d CROSS JOIN (SELECT DISTINCT team FROM closes) t),
filled AS (SELECT s.team, s.date, last_value(score IGNORE NULLS) OVER (PARTITION BY s.team ORDER BY s.date) AS score FROM spine s LEFT JOIN closes c ON s.team = c.team AND s.date = c.date),
ranked AS (SELECT r.league, f.date, f.score, row_number() OVER (PARTITION BY r.league, f.date ORDER BY f.score DESC, f.team) AS k FROM filled f JOIN records r ON f.team = r.team WHERE f.score IS NOT NULL)
SELECT league, date, count(*) AS teams, {r4('CAST(sum(score) AS DOUBLE) / count(*)', 2)} AS power FROM ranked WHERE k <= 3 GROUP BY ALL""",
    "sides records points closes",
)
def f8_region_history(spark, sf_dir):
    rows = points(spark, sf_dir)
    league = rows.groupBy("team").agg(F.min("league").alias("league"))
    ranked = H.daily_ranks(rows).join(league, "team").withColumn("k", F.row_number().over(Window.partitionBy("league", "date").orderBy(F.col("score").desc(), "team")))
    return ranked.where("k <= 3").groupBy("league", "date").agg(F.count("*").alias("teams"), half_up(F.sum("score").cast("double") / F.count("*"), 2).alias("power"))


@query("f9_side_samples", "SELECT patch, count(*) FILTER ((side_a = 'blue') = (winner = team_a)) AS blue_wins, count(*) AS games FROM games WHERE side_a IS NOT NULL GROUP BY GROUPING SETS ((patch), ())")
def f9_side_samples(spark, sf_dir):
    games = contest_games(spark, sf_dir).where("side_a is not null")
    blue = (F.col("side_a") == "blue") == (F.col("winner") == F.col("team_a"))
    return games.groupingSets([[F.col("patch")], []], F.col("patch")).agg(F.count_if(blue).alias("blue_wins"), F.count("*").alias("games"))


@query("f10_control_means", f"SELECT role, league_a AS league, side_a AS side, tier, {r4('CAST(sum(CAST(kills AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS kills, count(*) AS games FROM games GROUP BY GROUPING SETS ((), (role), (role, league_a), (role, side_a), (role, tier))")
def f10_control_means(spark, sf_dir):
    games = contest_games(spark, sf_dir).select("role", F.col("league_a").alias("league"), F.col("side_a").alias("side"), "tier", "kills")
    sets = [[], ["role"], ["role", "league"], ["role", "side"], ["role", "tier"]]
    out = games.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, ("role", "league", "side", "tier")))
    return out.agg(half_up(F.sum(F.col("kills").cast("decimal(18,2)")).cast("double") / F.count("*"), 4).alias("kills"), F.count("*").alias("games"))


@query("f13_player_appearance", f", n AS (SELECT player, role, team_a AS team, count(*) AS games FROM games GROUP BY ALL) SELECT player, team, games, {r4('games / CAST(sum(games) OVER (PARTITION BY player) AS DOUBLE)')} AS share, row_number() OVER (PARTITION BY player ORDER BY games DESC, team) = 1 AS primary_team FROM n")
def f13_player_appearance(spark, sf_dir):
    counts = contest_games(spark, sf_dir).groupBy("player", "role", F.col("team_a").alias("team")).agg(F.count("*").alias("games"))
    w = Window.partitionBy("player")
    return counts.select("player", "team", "games", half_up(F.col("games") / F.sum("games").over(w).cast("double"), 4).alias("share"), (F.row_number().over(w.orderBy(F.col("games").desc(), "team")) == 1).alias("primary_team"))


@query("f21_quality_audit", "SELECT count(*) AS games, count(*) FILTER (side_a IS NULL) AS no_side, count(*) FILTER (kills IS NULL OR kills <= 0) AS no_kills, count(*) FILTER (league_a = league_b) AS same_league, count(DISTINCT player) AS players FROM games")
def f21_quality_audit(spark, sf_dir):
    return contest_games(spark, sf_dir).agg(F.count("*").alias("games"), F.count_if(F.col("side_a").isNull()).alias("no_side"), F.count_if(F.col("kills").isNull() | (F.col("kills") <= 0)).alias("no_kills"), F.count_if(F.col("league_a") == F.col("league_b")).alias("same_league"), F.countDistinct("player").alias("players"))


@query("f22_duplicate_codes", "SELECT upper(substr(n_name, 1, 2)) AS code, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM nation GROUP BY 1 HAVING count(*) > 1")
def f22_duplicate_codes(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.upper(F.substring("n_name", 1, 2)).alias("code")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("f25_coverage", "SELECT season, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, count(DISTINCT series_id) AS series FROM games GROUP BY season")
def f25_coverage(spark, sf_dir):
    return contest_games(spark, sf_dir).groupBy("season").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("dates"), F.countDistinct("series_id").alias("series"))


@query("f29_team_profile", ", n AS (SELECT team, tier, max(date) AS seen, count(*) AS games FROM sides GROUP BY ALL) SELECT team, tier, seen, games FROM n QUALIFY row_number() OVER (PARTITION BY team ORDER BY seen DESC, games DESC, tier) = 1", "sides")
def f29_team_profile(spark, sf_dir):
    counts = S.sides(contest_games(spark, sf_dir)).groupBy("team", "tier").agg(F.max("date").alias("seen"), F.count("*").alias("games"))
    return X.first_of(counts, ["team"], [F.col("seen").desc(), F.col("games").desc(), "tier"]).select("team", "tier", "seen", "games")


@query("f31_worlds_end", "SELECT season, max(date) AS worlds_end FROM games WHERE tier = 'worlds-playoffs' GROUP BY season")
def f31_worlds_end(spark, sf_dir):
    return contest_games(spark, sf_dir).where("tier = 'worlds-playoffs'").groupBy("season").agg(F.max("date").alias("worlds_end"))


@query("f33_expected_share", f"SELECT team, league, {r4('exp((rating - max(rating) OVER (PARTITION BY league)) / 400.0::DOUBLE) / sum(exp((rating - max_rating) / 400.0::DOUBLE)) OVER (PARTITION BY league)', 3)} AS share FROM (SELECT *, max(rating) OVER (PARTITION BY league) AS max_rating FROM records)", "sides records")
def f33_expected_share(spark, sf_dir):
    w = Window.partitionBy("league")
    rows = records(spark, sf_dir).withColumn("e", F.exp((F.col("rating") - F.max("rating").over(w)) / 400.0))
    return rows.select("team", "league", half_up(F.col("e") / F.sum("e").over(w), 3).alias("share"))


@query("f37_upper_median", "SELECT tier, quantile_disc(gold, 0.5) AS middle, max(gold) AS most FROM games GROUP BY tier")
def f37_upper_median(spark, sf_dir):
    return contest_games(spark, sf_dir).groupBy("tier").agg(F.expr("percentile_disc(0.5) within group (order by gold)").alias("middle"), F.max("gold").alias("most"))


@query(
    "f38_lineups",
    """, n AS (SELECT team_a AS team, role, player, count(*) AS games FROM games GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY team, role ORDER BY games DESC, player) AS r FROM n)
SELECT team, array_to_string(list(player ORDER BY role) FILTER (r = 1), ',') AS starters, count(*) FILTER (r > 1) AS substitutes FROM k GROUP BY team""",
)
def f38_lineups(spark, sf_dir):
    counts = contest_games(spark, sf_dir).groupBy(F.col("team_a").alias("team"), "role", "player").agg(F.count("*").alias("games"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("team", "role").orderBy(F.col("games").desc(), "player")))
    starters = F.array_sort(F.collect_list(F.when(F.col("r") == 1, F.struct("role", "player"))))
    return ranked.groupBy("team").agg(F.array_join(starters.getField("player").cast("array<string>"), ",").alias("starters"), F.count_if(F.col("r") > 1).alias("substitutes"))


_E1 = """, l AS (SELECT series_id, game_number, team_a, team_b, date, row_number() OVER (PARTITION BY team_a, team_b, date ORDER BY series_id, game_number) AS turn FROM games WHERE winner = team_a),
r AS (SELECT series_id AS other_series, game_number AS other_game, team_a, team_b, date, row_number() OVER (PARTITION BY team_a, team_b, date ORDER BY series_id, game_number) AS turn FROM games WHERE winner <> team_a)
SELECT l.team_a, l.team_b, l.date, l.turn, series_id, game_number, other_series, other_game FROM l JOIN r ON l.team_a = r.team_a AND l.team_b = r.team_b AND l.date = r.date AND l.turn = r.turn"""


@query("e1_consumable_match", _E1)
@query("e1_consumable_match_all", _E1)
def e1_consumable_match_all(spark, sf_dir):
    # Every game is on one of the sides: won by team_a on the left, by team_b on the right.
    games = contest_games(spark, sf_dir)
    columns = ("series_id", "game_number", "team_a", "team_b", "date")
    left = games.where("winner = team_a").select(*columns)
    right = games.where("winner <> team_a").select(*columns).withColumnsRenamed({"series_id": "other_series", "game_number": "other_game"})
    return X.consumable_match(left, right, ["team_a", "team_b", "date"], ["series_id", "game_number"], ["other_series", "other_game"])


_E2 = """, k AS (SELECT series_id, strftime(date, '%Y-%m-%d') || team_a AS k1, strftime(date, '%Y-%m-%d') || team_b AS k2 FROM games WHERE game_number = 1),
pairs AS (SELECT a.series_id, b.series_id AS other_id FROM k a JOIN k b ON a.k1 = b.k1 UNION ALL SELECT a.series_id, b.series_id FROM k a JOIN k b ON a.k2 = b.k2)
SELECT series_id, min(other_id) AS other_id FROM pairs GROUP BY series_id"""


@query("e2_any_key_match", _E2)
@query("e2_any_key_match_all", _E2)
def e2_any_key_match_all(spark, sf_dir):
    # Every series has one first game.
    day = F.date_format("date", "yyyy-MM-dd")
    rows = contest_games(spark, sf_dir).where("game_number = 1").select("series_id", F.concat(day, "team_a").alias("k1"), F.concat(day, "team_b").alias("k2"))
    return X.any_key_match(rows, rows.withColumnRenamed("series_id", "other_id"), ["k1", "k2"], "series_id", "other_id")


@query("e3_first_of_key", "SELECT team_a, team_b, date, series_id, game_number FROM games QUALIFY row_number() OVER (PARTITION BY team_a, team_b, date ORDER BY series_id, game_number) = 1")
def e3_first_of_key(spark, sf_dir):
    return X.first_of(contest_games(spark, sf_dir), ["team_a", "team_b", "date"], ["series_id", "game_number"]).select("team_a", "team_b", "date", "series_id", "game_number")


@query("e8_role_opponents", "SELECT a.role, count(*) AS pairs, count(*) FILTER (a.kills > b.kills) AS ahead FROM games a JOIN games b ON a.series_id = b.series_id AND a.role = b.role AND a.game_number < b.game_number GROUP BY a.role")
def e8_role_opponents(spark, sf_dir):
    games = contest_games(spark, sf_dir).select("series_id", "role", "game_number", "kills")
    other = games.withColumnsRenamed({"game_number": "other_game", "kills": "other_kills"})
    pairs = games.join(other, ["series_id", "role"]).where("game_number < other_game")
    return pairs.groupBy("role").agg(F.count("*").alias("pairs"), F.count_if(F.col("kills") > F.col("other_kills")).alias("ahead"))


@query(
    "e9_snapshot_before",
    """, closing AS (SELECT team, date, arg_max(player, seq) AS player FROM points GROUP BY team, date), before AS (SELECT team, date, lag(player) OVER (PARTITION BY team ORDER BY date) AS player_before FROM closing)
SELECT p.team, p.seq, b.player_before FROM points p JOIN before b ON p.team = b.team AND p.date = b.date""",
    "sides points",
)
def e9_snapshot_before(spark, sf_dir):
    rows = points(spark, sf_dir)
    # The last value before a date is the close of the team's date before: a lag at date grain, not a range join.
    closing = rows.groupBy("team", "date").agg(F.max_by("player", "seq").alias("player"))
    before = closing.select("team", "date", F.lag("player").over(Window.partitionBy("team").orderBy("date")).alias("player_before"))
    return rows.select("team", "date", "seq").join(before, ["team", "date"]).select("team", "seq", "player_before")


@query("e10_as_of", "SELECT team, arg_max(score, seq) AS score, max(date) AS date, count(*) AS games FROM points WHERE date <= DATE '1998-06-30' GROUP BY team", "sides points")
def e10_as_of(spark, sf_dir):
    return H.as_of(points(spark, sf_dir), F.lit("1998-06-30").cast("date"))


@query("e13_rank_bounds", "SELECT a.team, 1 + count(*) FILTER (b.rating > a.rating + 5) AS best_rank, 1 + count(*) FILTER (b.rating > a.rating - 5) AS worst_rank FROM records a CROSS JOIN records b GROUP BY a.team", "sides records")
def e13_rank_bounds(spark, sf_dir):
    return X.rank_bounds(records(spark, sf_dir).withColumn("u", F.lit(5.0)), "team", "rating", "u")


PARTS["ledgers"] = """
last_season AS (SELECT max(season) AS m FROM series),
old_ledger AS (SELECT series_id, date, wins_a, CASE WHEN state = 'completed' THEN winner END AS winner FROM series, last_season WHERE season < m),
new_ledger AS (SELECT series_id, date, wins_a, winner FROM series WHERE NOT (state <> 'completed' AND winner IS NULL)),
ledger_diff AS (SELECT coalesce(o.series_id, n.series_id) AS series_id, coalesce(n.date, o.date) AS date, CASE WHEN o.series_id IS NULL THEN 'added' WHEN n.series_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM old_ledger o FULL JOIN new_ledger n ON o.series_id = n.series_id WHERE o.series_id IS NULL OR n.series_id IS NULL OR o.wins_a <> n.wins_a OR o.winner IS DISTINCT FROM n.winner)"""


def ledgers(spark, sf_dir):
    """The ledger before the last season, with undecided series open, and the ledger now, without those that stay open; their diff has dates."""
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", "season", "date", "state", "wins_a", "winner")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("season").alias("last"))))
    done = F.col("state") == "completed"
    old = rows.where("season < last").select("series_id", "wins_a", F.when(done, F.col("winner")).alias("winner"))
    new = rows.where(done | F.col("winner").isNotNull()).select("series_id", "wins_a", "winner")
    diff = X.ledger_diff(X.ledger(old, ["series_id"]), X.ledger(new, ["series_id"]), ["series_id"])
    return diff.join(rows.select("series_id", "date"), "series_id"), rows


@query("e14_ledger_diff", "SELECT series_id, change FROM ledger_diff", "series ledgers")
def e14_ledger_diff(spark, sf_dir):
    return ledgers(spark, sf_dir)[0].select("series_id", "change")


@query("e19_pivot_merge", "SELECT season, count(*) FILTER (league = 'AFRICA') AS africa, count(*) FILTER (league = 'AMERICA') AS america, count(*) FILTER (league = 'ASIA') AS asia, count(*) FILTER (league = 'EUROPE') AS europe FROM sides GROUP BY season", "sides")
def e19_pivot_merge(spark, sf_dir):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    out = S.sides(contest_games(spark, sf_dir)).groupBy("season").pivot("league", names).agg(F.count(F.lit(1)))
    return out.select("season", *[F.coalesce(n, F.lit(0)).cast("long").alias(n.lower()) for n in names])


@query(
    "k9_change_kind",
    """, b AS (SELECT max(date) AS last FROM old_ledger), a AS (SELECT min(date) AS first FROM ledger_diff WHERE change = 'added'), u AS (SELECT 'all' AS part, date, change, last FROM ledger_diff, b UNION ALL SELECT 'added', date, change, last FROM ledger_diff, b WHERE change = 'added' UNION ALL SELECT 'same-day', date, change, first FROM ledger_diff, a WHERE change = 'added'),
k AS (SELECT part, count(*) AS changes, min(date) AS replay_from, bool_and(change = 'added' AND date > last) AS append, bool_and(change = 'added' AND date >= last) AS same_day FROM u GROUP BY part)
SELECT part, CASE WHEN append THEN 'latest-append' WHEN same_day THEN 'same-day-insertion' ELSE 'historical-correction' END AS kind, changes, replay_from FROM k UNION ALL SELECT 'none', 'no-change', 0, NULL""",
    "series ledgers",
)
def k9_change_kind(spark, sf_dir):
    """The kind of four updates: all that changed, what was added, the same seen from its first date, and nothing."""
    diff, rows = ledgers(spark, sf_dir)
    last = rows.where("season < last").agg(F.max("date")).first()[0]
    added = diff.where("change = 'added'")
    first = added.agg(F.min("date")).first()[0]
    parts = {"all": (diff, last), "added": (added, last), "same-day": (added, first), "none": (diff.limit(0), last)}
    each = [X.classify_changes(df.select("date", "change"), F.lit(day).cast("date")).withColumn("part", F.lit(name)) for name, (df, day) in parts.items()]
    return reduce(DataFrame.union, each)


@query("j17_event_weights", f"SELECT tier, count(*) AS games, {r4('CASE tier WHEN ' + chr(39) + 'worlds-playoffs' + chr(39) + ' THEN 34 WHEN ' + chr(39) + 'msi-bracket' + chr(39) + ' THEN 34 WHEN ' + chr(39) + 'major-playoffs' + chr(39) + ' THEN 22 WHEN ' + chr(39) + 'regional-regular' + chr(39) + ' THEN 14 ELSE 12 END / 14.0::DOUBLE')} AS weight FROM games GROUP BY tier")
def j17_event_weights(spark, sf_dir):
    return contest_games(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("games")).withColumn("weight", half_up(R.event_weight(F.col("tier")), 4))


@query(
    "j18_matchups",
    f""", m AS (SELECT a.team AS team_a, b.team AS team_b, {game_p('a.rating', 'b.rating')} AS p FROM records a JOIN records b ON a.team <> b.team)
SELECT team_a, team_b, p, {r4('3.0::DOUBLE * pow(p, 2) * pow(1.0::DOUBLE - p, 1) + 1.0::DOUBLE * pow(p, 3) * pow(1.0::DOUBLE - p, 0)')} AS best_of_3, {r4('10.0::DOUBLE * pow(p, 3) * pow(1.0::DOUBLE - p, 2) + 5.0::DOUBLE * pow(p, 4) * pow(1.0::DOUBLE - p, 1) + 1.0::DOUBLE * pow(p, 5) * pow(1.0::DOUBLE - p, 0)')} AS best_of_5 FROM m""",
    "sides records",
)
def j18_matchups(spark, sf_dir):
    # All pairs of teams is the result asked for; teams are a dimension of fixed size.
    rated = records(spark, sf_dir).select("team", "rating")
    pairs = rated.toDF("team_a", "a").crossJoin(F.broadcast(rated.toDF("team_b", "b"))).where("team_a <> team_b")
    pairs = pairs.withColumn("p", half_up(R.expected(F.col("a"), F.col("b"), R.ODDS_SCALE), 4))
    return pairs.select("team_a", "team_b", "p", R.series_probability(F.col("p"), 3).alias("best_of_3"), R.series_probability(F.col("p"), 5).alias("best_of_5"))


@query("j22_public_scale", f"SELECT team, {r4('greatest(1000.0::DOUBLE, least(3000.0::DOUBLE, 1800.0::DOUBLE + (rating - 1500.0::DOUBLE) * 3.25::DOUBLE))', 2)} AS score FROM records", "sides records")
def j22_public_scale(spark, sf_dir):
    return records(spark, sf_dir).select("team", half_up(R.public_score(F.col("rating")), 2).alias("score"))


@query("j25_side_edge", f", s AS (SELECT patch, count(*) FILTER ((side_a = 'blue') = (winner = team_a)) AS b, count(*) FILTER ((side_a = 'blue') <> (winner = team_a)) AS r FROM games WHERE side_a IS NOT NULL GROUP BY patch) SELECT patch, b AS blue, r AS red, {r4('400.0::DOUBLE / ln(10.0::DOUBLE) * ln((b + 0.5::DOUBLE) / (r + 0.5::DOUBLE)) * (b + r) / (b + r + 24.0::DOUBLE)', 1)} AS edge FROM s")
def j25_side_edge(spark, sf_dir):
    blue = (F.col("side_a") == "blue") == (F.col("winner") == F.col("team_a"))
    rows = contest_games(spark, sf_dir).where("side_a is not null").groupBy("patch").agg(F.count_if(blue).alias("blue"), F.count_if(~blue).alias("red"))
    return rows.withColumn("edge", R.side_edge(F.col("blue"), F.col("red")))


@query(
    "j30_eligibility",
    """, ends AS (SELECT season, max(date) AS e FROM points GROUP BY season), stats AS (SELECT p.season, team, count(*) AS matches, count(*) FILTER (date >= e - 90) AS recent, max(e) - max(date) AS idle FROM points p JOIN ends x ON p.season = x.season GROUP BY ALL)
SELECT season, team, array_to_string(list_filter([CASE WHEN matches < 20 THEN 'few-matches' END, CASE WHEN recent < 6 THEN 'few-recent' END, CASE WHEN idle > 90 THEN 'inactive' END, CASE WHEN 140 - least(matches, 100) > 105 THEN 'uncertain' END], lambda x: x IS NOT NULL), ',') AS reasons FROM stats""",
    "sides points",
)
def j30_eligibility(spark, sf_dir):
    rows = points(spark, sf_dir)
    rows = rows.join(rows.groupBy("season").agg(F.max("date").alias("end")), "season")
    late = F.col("date") >= F.date_sub("end", 90)
    stats = rows.groupBy("season", "team").agg(F.count("*").alias("matches"), F.count_if(late).alias("recent"), F.datediff(F.max("end"), F.max("date")).alias("idle"))
    reasons = R.eligibility_reasons(F.col("matches"), F.col("recent"), F.col("idle"), 140.0 - F.least(F.col("matches"), F.lit(100)))
    return stats.select("season", "team", F.array_join(reasons, ",").alias("reasons"))


@query(
    "m4_resume_scores",
    f""", ledger AS (SELECT s.team, CASE WHEN winner IS NULL THEN 0.5::DOUBLE WHEN winner = s.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed, {r4("1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (o.rating - m.rating) / 400.0::DOUBLE))")} AS expected,
  CASE s.tier WHEN 'worlds-playoffs' THEN 36 WHEN 'msi-bracket' THEN 34 WHEN 'major-playoffs' THEN 20 WHEN 'regional-regular' THEN 12 ELSE 8 END * CASE s.best_of WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.05::DOUBLE WHEN 3 THEN 1.12::DOUBLE ELSE 1.25::DOUBLE END AS weight
  FROM series_sides s JOIN records m ON s.team = m.team JOIN records o ON s.opponent = o.team WHERE state = 'completed'),
sums AS (SELECT team, count(*) AS series, CAST(sum(CAST(round(weight * (observed - expected), 6) AS DECIMAL(20,6))) AS DOUBLE) AS value, CAST(sum(CAST(round(weight, 6) AS DECIMAL(20,6))) AS DOUBLE) AS weight FROM ledger GROUP BY team),
scored AS (SELECT team, series, {r4('1500.0::DOUBLE + 420.0::DOUBLE * value / weight * sqrt(weight / (weight + 120.0::DOUBLE))', 1)} AS score FROM sums)
SELECT *, row_number() OVER (ORDER BY score DESC, team) AS rank FROM scored""",
    "sides records series series_sides",
)
def m4_resume_scores(spark, sf_dir):
    from ..operators.resume import resume_scores

    games = contest_games(spark, sf_dir)
    return resume_scores(S.resolve_series(games), S.team_records(games).select("team", "rating"))


@query(
    "i3_missing_teams",
    """, w AS (SELECT season, team, count(*) FILTER (winner = team) AS wins FROM sides GROUP BY ALL), top AS (SELECT season, team FROM w QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, team) <= 10)
SELECT season, team FROM top WHERE season > (SELECT min(season) FROM top) EXCEPT SELECT season + 1, team FROM top""",
    "sides",
)
def i3_missing_teams(spark, sf_dir):
    """Teams of each season's ten best that were not among those of the season before."""
    wins = S.sides(contest_games(spark, sf_dir)).groupBy("season", "team").agg(F.count_if(S.won()).alias("wins"))
    best = F.row_number().over(Window.partitionBy("season").orderBy(F.col("wins").desc(), "team"))
    top = wins.withColumn("r", best).where("r <= 10").select("season", "team")
    first = top.agg(F.min("season").alias("first"))
    later = top.crossJoin(F.broadcast(first)).where("season > first").select("season", "team")
    return later.exceptAll(top.select((F.col("season") + 1).alias("season"), "team"))


@query("p3_last_matches", "SELECT player, series_id, date, r AS back FROM (SELECT player, series_id, date, row_number() OVER (PARTITION BY player ORDER BY date DESC, series_id DESC) AS r FROM (SELECT DISTINCT player, series_id, date FROM games)) WHERE r <= 2")
def p3_last_matches(spark, sf_dir):
    rows = contest_games(spark, sf_dir).select("player", "series_id", "date").distinct()
    rank = F.row_number().over(Window.partitionBy("player").orderBy(F.col("date").desc(), F.col("series_id").desc())).cast("long")
    return rows.withColumn("back", rank).where("back <= 2")
