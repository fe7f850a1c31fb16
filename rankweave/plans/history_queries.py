"""Standings, ranks and windows over team histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import eras as E
from ..operators import history as H
from ..operators import scope_builder as L
from ..operators import series as S
from ..operators.storage import new_path, write_back
from ..sources.contest import contest_games
from .registry import PARTS, query

PARTS["points"] = """
points AS (SELECT team, league, opponent, season, date, series_id, game_number, tier, winner = team AS won, player, row_number() OVER w AS seq,
  CAST(1500 + sum(CASE WHEN winner = team THEN 10 ELSE -10 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS score FROM sides WINDOW w AS (PARTITION BY team ORDER BY date, series_id, game_number))"""
PARTS["closes"] = """
closes AS (SELECT team, date, arg_max(score, seq) AS score, count(*) AS games FROM points GROUP BY team, date)"""
PARTS["season_ranks"] = """
ranked AS (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY arg_max(score, seq) DESC, team) AS rank FROM points GROUP BY season, team)"""

def points(spark, sf_dir):
    return H.team_points(contest_games(spark, sf_dir))


def records(spark, sf_dir):
    return S.team_records(contest_games(spark, sf_dir))


@query("g1_standings", "SELECT team, league, games, wins, rating, games >= 20 AS eligible, row_number() OVER (ORDER BY games >= 20 DESC, rating DESC, team) AS rank FROM records", "sides records")
def g1_standings(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("eligible", F.col("games") >= 20)
    return rows.select("team", "league", "games", "wins", "rating", "eligible", F.row_number().over(Window.orderBy(F.col("eligible").desc(), F.col("rating").desc(), "team")).cast("long").alias("rank"))


@query("g3_competition_rank", "SELECT team, floor(rating + 0.5::DOUBLE)::BIGINT AS score, rank() OVER (ORDER BY floor(rating + 0.5::DOUBLE) DESC) AS rank FROM records", "sides records")
def g3_competition_rank(spark, sf_dir):
    rows = records(spark, sf_dir).select("team", F.floor(F.col("rating") + 0.5).cast("long").alias("score"))
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())).cast("long"))


@query(
    "g4_player_ranks",
    """, players AS (SELECT player, role, count(*) AS games, count(*) FILTER (winner = team_a) AS wins, CAST(sum(CAST(kills AS DECIMAL(18,2))) AS DOUBLE) AS kills FROM games GROUP BY player, role),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY kills DESC, player) AS role_rank, row_number() OVER (ORDER BY wins DESC, kills DESC, player) AS win_rank FROM players WHERE games >= 20)
SELECT player, role, games, wins, kills, role_rank, win_rank, role_rank - win_rank AS delta FROM ranked""",
)
def g4_player_ranks(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    players = games.groupBy("player", "role").agg(F.count("*").alias("games"), F.count_if(F.col("winner") == F.col("team_a")).alias("wins"), F.sum(F.col("kills").cast("decimal(18,2)")).cast("double").alias("kills")).where("games >= 20")
    players = players.withColumn("role_rank", F.row_number().over(Window.partitionBy("role").orderBy(F.col("kills").desc(), "player")).cast("long"))
    # Players grow with the input: they are numbered among those with equal wins, behind the counts of those with more, a row a number of wins.
    ahead = players.groupBy("wins").agg(F.count("*").alias("n"))
    ahead = ahead.select("wins", F.coalesce(F.sum("n").over(Window.orderBy(F.col("wins").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("wins").orderBy(F.col("kills").desc(), "player"))
    players = players.join(ahead, "wins").withColumn("win_rank", (F.col("ahead") + within).cast("long")).drop("ahead")
    return players.withColumn("delta", F.col("role_rank") - F.col("win_rank")).select("player", "role", "games", "wins", "kills", "role_rank", "win_rank", "delta")


@query("g5_form", "SELECT team, seq, array_to_string(list(CASE WHEN won THEN 'W' ELSE 'L' END) OVER (PARTITION BY team ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '') AS form FROM points", "sides points")
def g5_form(spark, sf_dir):
    return H.form(points(spark, sf_dir)).select("team", "seq", "form")


@query("g6_deltas", "SELECT team, date, score - lag(score) OVER (PARTITION BY team ORDER BY date) AS delta FROM closes", "sides points closes")
def g6_deltas(spark, sf_dir):
    return H.daily_close(points(spark, sf_dir)).select("team", "date", (F.col("score") - F.lag("score").over(Window.partitionBy("team").orderBy("date"))).alias("delta"))


@query("g7_daily_close", "SELECT team, date, score, games FROM closes", "sides points closes")
def g7_daily_close(spark, sf_dir):
    return H.daily_close(points(spark, sf_dir))


@query(
    "g8_daily_ranks",
    """, spine AS (SELECT d.date, t.team FROM (SELECT DISTINCT date FROM closes) d CROSS JOIN (SELECT DISTINCT team FROM closes) t),
filled AS (SELECT s.team, s.date, last_value(score IGNORE NULLS) OVER (PARTITION BY s.team ORDER BY s.date) AS score FROM spine s LEFT JOIN closes c ON s.team = c.team AND s.date = c.date)
SELECT team, date, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, team) AS rank FROM filled WHERE score IS NOT NULL""",
    "sides points closes",
)
def g8_daily_ranks(spark, sf_dir):
    return H.daily_ranks(points(spark, sf_dir))


@query("g10_cumulative_score", "SELECT series_id, game_number, CAST(sum(CASE WHEN winner = team_a THEN 1 ELSE 0 END) OVER w AS BIGINT) AS score_a, CAST(sum(CASE WHEN winner = team_b THEN 1 ELSE 0 END) OVER w AS BIGINT) AS score_b FROM games WINDOW w AS (PARTITION BY series_id ORDER BY game_number ROWS UNBOUNDED PRECEDING)")
def g10_cumulative_score(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("game_number").rowsBetween(Window.unboundedPreceding, 0)
    score = lambda t: F.sum(F.when(F.col("winner") == F.col(t), 1).otherwise(0)).over(w).cast("long")
    return contest_games(spark, sf_dir).select("series_id", "game_number", score("team_a").alias("score_a"), score("team_b").alias("score_b"))


@query(
    "g11_extremes",
    "SELECT team, max(score) AS peak, (min(struct_pack(s := -score, q := seq, d := date))).d AS peak_date, min(score) AS trough, (min(struct_pack(s := score, q := seq, d := date))).d AS trough_date, arg_min(score, seq) AS first_score, arg_max(score, seq) AS last_score, arg_max(score, seq) - arg_min(score, seq) AS net FROM points GROUP BY team",
    "sides points",
)
def g11_extremes(spark, sf_dir):
    return H.extremes(points(spark, sf_dir))


@query(
    "g12_rolling_movement",
    """, ended AS (SELECT max(date) AS e FROM points), both_ AS (SELECT team, arg_max(score, seq) AS score, arg_max(score, seq) FILTER (date <= e - 30) AS base, count(*) FILTER (date > e - 30) AS recent FROM points, ended GROUP BY team),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, team) AS rank, row_number() OVER (ORDER BY base DESC NULLS LAST, team) AS base_rank FROM both_)
SELECT *, base_rank - rank AS moved FROM ranked""",
    "sides points",
)
def g12_rolling_movement(spark, sf_dir):
    return H.rolling_movement(points(spark, sf_dir))


@query(
    "g13_biggest_upset",
    """, tagged AS (SELECT p.team, p.date, p.series_id, p.game_number, p.opponent, o.rating - m.rating AS gap FROM points p JOIN records m ON p.team = m.team JOIN records o ON p.opponent = o.team WHERE p.won)
SELECT team, date, series_id, game_number, opponent, gap FROM tagged QUALIFY row_number() OVER (PARTITION BY team ORDER BY gap DESC, date DESC, series_id DESC, game_number DESC) = 1""",
    "sides records points",
)
def g13_biggest_upset(spark, sf_dir):
    rated = records(spark, sf_dir).select("team", "rating")
    wins = points(spark, sf_dir).where("won").join(rated, "team").join(rated.withColumnsRenamed({"team": "opponent", "rating": "other"}), "opponent")
    wins = wins.withColumn("gap", F.col("other") - F.col("rating"))
    best = F.row_number().over(Window.partitionBy("team").orderBy(F.col("gap").desc(), F.col("date").desc(), F.col("series_id").desc(), F.col("game_number").desc()))
    return wins.withColumn("rn", best).where("rn = 1").select("team", "date", "series_id", "game_number", "opponent", "gap")


@query("g14_activity", "SELECT team, seq, count(*) OVER (PARTITION BY team ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS recent FROM points", "sides points")
def g14_activity(spark, sf_dir):
    days = F.unix_date("date")
    return points(spark, sf_dir).select("team", "seq", F.count("*").over(Window.partitionBy("team").orderBy(days).rangeBetween(-90, 0)).alias("recent"))


@query("g15_checkpoint_movement", "SELECT a.season, a.team, a.rank, b.rank AS before, b.rank - a.rank AS moved FROM ranked a LEFT JOIN ranked b ON a.team = b.team AND b.season = a.season - 1", "sides points season_ranks")
def g15_checkpoint_movement(spark, sf_dir):
    seasons = points(spark, sf_dir).groupBy("season", "team").agg(F.max_by("score", "seq").alias("score"))
    ranked = seasons.withColumn("rank", F.row_number().over(Window.partitionBy("season").orderBy(F.col("score").desc(), "team")).cast("long"))
    before = ranked.select((F.col("season") + 1).alias("season"), "team", F.col("rank").alias("before"))
    return ranked.join(before, ["season", "team"], "left").select("season", "team", "rank", "before", (F.col("before") - F.col("rank")).alias("moved"))


@query(
    "g16_eras",
    """, marked AS (SELECT team, seq, date, player % 7 AS signature, CASE WHEN player % 7 IS NOT DISTINCT FROM lag(player % 7) OVER (PARTITION BY team ORDER BY seq) THEN 0 ELSE 1 END AS step FROM points),
eras AS (SELECT team, signature, CAST(sum(step) OVER (PARTITION BY team ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS era, date FROM marked),
spans AS (SELECT team, era, min(signature) AS signature, min(date) AS started, count(*) AS games FROM eras GROUP BY team, era)
SELECT team, era, signature, games, started, lead(started) OVER (PARTITION BY team ORDER BY era) AS ended FROM spans""",
    "sides points",
)
def g16_eras(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir)).select("team", *H.GAME_ORDER, (F.col("player") % 7).alias("signature"))
    rows = S.islands(rows, ["team"], list(H.GAME_ORDER), "signature").withColumnRenamed("island", "era")
    spans = rows.groupBy("team", "era").agg(F.min("signature").alias("signature"), F.min("date").alias("started"), F.count("*").alias("games"), F.min("last_island").alias("last_island"), F.min("next_start").alias("next_start"))
    return spans.select("team", "era", "signature", "games", "started", S.ended("era", "started").alias("ended"))


@query(
    "g18_tier_labels",
    """, numbered AS (SELECT team, date, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY team ORDER BY date) AS i FROM closes),
base AS (SELECT *, CASE WHEN score >= 1600 THEN 'S' WHEN score >= 1540 THEN 'A' WHEN score >= 1480 THEN 'B' ELSE 'C' END AS plain_ FROM numbered),
walk AS (SELECT team, date, score, i, plain_ AS label FROM base WHERE i = 1 UNION ALL
  SELECT b.team, b.date, b.score, b.i, CASE WHEN b.score >= CASE w.label WHEN 'S' THEN 1600 WHEN 'A' THEN 1540 WHEN 'B' THEN 1480 ELSE -1e9 END - 35 AND b.score < CASE w.label WHEN 'S' THEN 1e9 WHEN 'A' THEN 1600 WHEN 'B' THEN 1540 ELSE 1480 END + 35 THEN w.label ELSE b.plain_ END
  FROM walk w JOIN base b ON b.team = w.team AND b.i = w.i + 1)
SELECT team, date, score, label FROM walk""",
    "sides points closes",
)
def g18_tier_labels(spark, sf_dir):
    return H.tier_labels(H.daily_close(points(spark, sf_dir)), "team", "date", "score")


@query("g20_daily_span", "SELECT team, min(score) AS low, max(score) AS high, arg_max(score, date) AS latest FROM closes GROUP BY team", "sides points closes")
def g20_daily_span(spark, sf_dir):
    return H.daily_close(points(spark, sf_dir)).groupBy("team").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max_by("score", "date").alias("latest"))


@query("h2_board_page", "SELECT team, rating, row_number() OVER (ORDER BY rating DESC, team) AS rank FROM records ORDER BY rank LIMIT 15", "sides records")
def h2_board_page(spark, sf_dir):
    ranked = records(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.col("rating").desc(), "team")).cast("long"))
    return ranked.select("team", "rating", "rank").orderBy("rank").limit(15)


@query("h3_match_pages", "SELECT season, (row_number() OVER (PARTITION BY season ORDER BY date, series_id) - 1) // 25 + 1 AS page, series_id FROM series", "series")
def h3_match_pages(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("season").orderBy("date", "series_id"))
    return S.resolve_series(contest_games(spark, sf_dir)).select("season", (F.floor((rn - 1) / 25) + 1).cast("long").alias("page"), "series_id")


@query("h9_metric_spread", "SELECT team, rating, floor((rating - min(rating) OVER ()) / (max(rating) OVER () - min(rating) OVER ()) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS share FROM records", "sides records")
def h9_metric_spread(spark, sf_dir):
    from ..functions.rounding import half_up

    rows = records(spark, sf_dir)
    ends = rows.agg(F.min("rating").alias("low"), F.max("rating").alias("high"))
    return rows.crossJoin(F.broadcast(ends)).select("team", "rating", half_up((F.col("rating") - F.col("low")) / (F.col("high") - F.col("low")), 4).alias("share"))


# Rosters that change by the month, and the replays that they ask for.
PARTS["monthly_eras"] = """
observed AS (SELECT DISTINCT team, series_id AS match_id, date, season || '-' || sum(player) OVER (PARTITION BY team, patch) % 3 AS signature FROM sides WHERE tier = 'worlds-playoffs'),
turned AS (SELECT *, CASE WHEN signature IS NOT DISTINCT FROM lag(signature) OVER (PARTITION BY team ORDER BY date, match_id) THEN 0 ELSE 1 END AS step FROM observed),
spelled AS (SELECT *, sum(step) OVER (PARTITION BY team ORDER BY date, match_id ROWS UNBOUNDED PRECEDING) AS era FROM turned),
spans AS (SELECT team, era, min(signature) AS signature, min(date) AS started, max(date) AS last, count(*) AS matches FROM spelled GROUP BY team, era),
roster_eras AS (SELECT *, lead(started) OVER (PARTITION BY team ORDER BY era) AS ended FROM spans)"""


def observations(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir)).where("tier = 'worlds-playoffs'")
    signature = F.concat_ws("-", "season", F.sum("player").over(Window.partitionBy("team", "patch")) % 3)
    return rows.select("team", F.col("series_id").alias("match_id"), "date", signature.alias("signature")).distinct()


@query("p28_overlapping_eras", "SELECT a.team, b.team AS other, count(*) AS overlaps, CAST(sum(least(a.last, b.last) - greatest(a.started, b.started) + 1) AS BIGINT) AS days FROM roster_eras a JOIN roster_eras b ON a.team < b.team AND a.started <= b.last AND b.started <= a.last GROUP BY ALL", "sides monthly_eras")
def p28_overlapping_eras(spark, sf_dir):
    """How often, and on how many days, the roster eras of two teams overlap."""
    eras = E.roster_eras(observations(spark, sf_dir)).select("team", "started", "last")
    other = eras.select(F.col("team").alias("other"), F.col("started").alias("other_started"), F.col("last").alias("other_last"))
    both = E.overlap_join(eras, other, ("started", "last"), ("other_started", "other_last")).where("team < other")
    days = F.datediff(F.least("last", "other_last"), F.greatest("started", "other_started")) + 1
    return both.groupBy("team", "other").agg(F.count("*").alias("overlaps"), F.sum(days).alias("days"))


@query(
    "p28_replay_starts",
    """, boundaries AS (SELECT DISTINCT last_day(date) AS boundary FROM sides),
opened AS (SELECT b.boundary, e.team, e.started, EXISTS (SELECT 1 FROM observed o WHERE o.team = e.team AND o.date > b.boundary AND o.date <= b.boundary + 10) AS fresh FROM boundaries b JOIN roster_eras e ON e.started <= b.boundary AND (e.ended IS NULL OR e.ended > b.boundary)),
starts AS (SELECT b.boundary, count(o.team) AS open_eras, min(o.started) FILTER (o.fresh) AS open_start FROM boundaries b LEFT JOIN opened o ON o.boundary = b.boundary GROUP BY b.boundary),
widened AS (SELECT boundary, open_start AS d FROM starts WHERE open_start IS NOT NULL UNION SELECT w.boundary, e.started FROM widened w JOIN roster_eras e ON e.started < w.d AND e.last >= w.d)
SELECT s.boundary, open_eras, open_start, (SELECT min(d) FROM widened w WHERE w.boundary = s.boundary) AS replay_from FROM starts s""",
    "sides monthly_eras",
)
def p28_replay_starts(spark, sf_dir):
    """At every month's end: open eras, the earliest start among teams that play in the next ten days, and where a replay has to begin."""
    path = new_path(spark, "starts")
    # The joins of spans look at their sides several times; all three are made once.
    rows = write_back(observations(spark, sf_dir), f"{path}/rows")
    ends = write_back(contest_games(spark, sf_dir).select(F.last_day("date").alias("boundary")).distinct().withColumn("until", F.date_add("boundary", 10)), f"{path}/ends")
    return E.replay_starts(write_back(E.roster_eras(rows), f"{path}/eras"), ends, rows)


# All scopes at once.
PARTS["scoped"] = """
scoped AS (SELECT p.*, s || '|' || e || '|' || r || '|All' AS scope FROM points p, LATERAL (SELECT unnest(['All', CAST(season AS VARCHAR)]) AS s) x, LATERAL (SELECT unnest(['All', tier]) AS e) y, LATERAL (SELECT unnest(list_distinct(['All', league, opponent_league_])) AS r) z
  UNION ALL SELECT p.*, season || '|All|All|' || CASE WHEN month(date) <= 6 THEN 'first' ELSE 'second' END FROM points p)"""
_POINTS_ABROAD = """, points AS (SELECT q.team, q.league, q.opponent, q.season, q.date, q.series_id, q.game_number, q.tier, q.won, q.player, q.seq, q.score, s.opponent_league AS opponent_league_, s.kills FROM plain_points q JOIN sides s ON s.team = q.team AND s.series_id = q.series_id AND s.game_number = q.game_number)"""
PARTS["scope_points"] = PARTS["points"].replace("points AS", "plain_points AS", 1) + _POINTS_ABROAD + "," + PARTS["scoped"]


def scope_parts():
    half = F.when(F.month("date") <= 6, "first").otherwise("second")
    return F.col("season"), F.col("tier"), [F.col("league"), F.col("opponent_league")], half


def all_standings(spark, sf_dir):
    rows = H.team_points(contest_games(spark, sf_dir), ("opponent_league",)).withColumn("delta", F.when(F.col("won"), 10).otherwise(-10))
    return L.standings_by_cell(rows, *scope_parts())


_STANDINGS = """, counted AS (SELECT scope, team, count(*) AS games, count(*) FILTER (won) AS wins, arg_max(score, seq) AS rating, arg_min(score - CASE WHEN won THEN 10 ELSE -10 END, seq) AS before, max(date) AS last_date FROM scoped GROUP BY ALL),
formed AS (SELECT scope, team, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY seq) AS form FROM (SELECT *, row_number() OVER (PARTITION BY scope, team ORDER BY seq DESC) AS back FROM scoped) WHERE back <= 5 GROUP BY ALL),
placed AS (SELECT c.*, f.form, c.games >= 3 AS eligible, row_number() OVER (PARTITION BY c.scope ORDER BY c.games >= 3 DESC, rating DESC, c.team) AS rank, row_number() OVER (PARTITION BY c.scope ORDER BY c.games >= 3 DESC, before DESC, c.team) AS rank_before FROM counted c JOIN formed f ON f.scope = c.scope AND f.team = c.team)"""


@query("p1_scope_standings", _STANDINGS + " SELECT scope, team, games, wins, games - wins AS losses, rating, before, form, eligible, rank, rank_before - rank AS moved FROM placed", "sides scope_points")
def p1_scope_standings(spark, sf_dir):
    """Standings and movement of all scopes, built together."""
    return all_standings(spark, sf_dir).select("scope", "team", "games", "wins", "losses", "rating", "before", "form", "eligible", "rank", "moved")


@query("p1_scope_summaries", _STANDINGS + " SELECT scope, count(*) AS teams, count(*) FILTER (eligible) AS eligible, CAST(sum(games) AS BIGINT) AS sides, arg_min(team, rank) AS best, arg_min(team, struct_pack(m := rank - rank_before, r := rank)) AS riser, max(last_date) AS last_date FROM placed GROUP BY scope", "sides scope_points")
def p1_scope_summaries(spark, sf_dir):
    """One row for each scope: its teams, its best, and the one that rose most."""
    return L.scope_summaries(all_standings(spark, sf_dir))


@query("p1_scope_players", "SELECT scope, player, games, wins, kills, rank FROM (SELECT scope, player, count(*) AS games, count(*) FILTER (won) AS wins, CAST(sum(kills) AS DOUBLE) AS kills, row_number() OVER (PARTITION BY scope ORDER BY count(*) FILTER (won) DESC, count(*) DESC, player) AS rank FROM scoped GROUP BY scope, player) WHERE rank <= 10", "sides scope_points")
def p1_scope_players(spark, sf_dir):
    """The ten leading players of every scope."""
    lines = S.sides(contest_games(spark, sf_dir)).select("season", "tier", "league", "opponent_league", "date", "player", S.won().alias("won"), "kills")
    return L.players_by_scope(lines, *scope_parts())[1]
