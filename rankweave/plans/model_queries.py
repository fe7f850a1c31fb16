"""Deserved standing, the player model and the whole rating model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import taxonomy as T
from ..functions.rounding import half_up
from ..operators import deserved as D
from ..operators import metrics as M
from ..operators import model_replay as R
from ..operators import player_model as P
from ..operators import series as S
from ..operators import static_rosters
from ..operators import tournaments as U
from ..operators.storage import new_path, write_back
from ..sources.contest import contest_games, contest_series, stored_games, table
from .analysis_queries import r4
from .event_queries import case, quoted
from .history_queries import records
from .registry import PARTS, query

#: Which region and tier the contest's leagues stand for.
REGIONS = {"AFRICA": "LCP", "AMERICA": "LCS", "ASIA": "LCK", "EUROPE": "LEC", "MIDDLE EAST": "CBLOL"}
LEAGUE_TIERS = {"AFRICA": "emerging", "AMERICA": "tier-two", "ASIA": "tier-one", "EUROPE": "tier-two", "MIDDLE EAST": "tier-three"}


def d(x) -> str:
    return f"{x!r}::DOUBLE"


def total(x: str, places: int = 6) -> str:
    return f"CAST(sum(CAST(round({x}, {places}) AS DECIMAL(28,{places}))) AS DOUBLE)"


_WAYS = {3: "3 * pow(p, 2) * pow(1.0::DOUBLE - p, 1) + 1 * pow(p, 3) * pow(1.0::DOUBLE - p, 0)", 5: "10 * pow(p, 3) * pow(1.0::DOUBLE - p, 2) + 5 * pow(p, 4) * pow(1.0::DOUBLE - p, 1) + 1 * pow(p, 5) * pow(1.0::DOUBLE - p, 0)"}


def expectation(p: str) -> str:
    return r4(f"CASE WHEN best_of <= 2 THEN {p} WHEN best_of <= 4 THEN {_WAYS[3].replace('p,', p + ',').replace('- p', '- ' + p)} ELSE {_WAYS[5].replace('p,', p + ',').replace('- p', '- ' + p)} END", 6)


PARTS["ledger"] = f"""
played AS (SELECT s.*, m.rating, o.rating AS other, CASE WHEN s.winner IS NULL THEN 0.5::DOUBLE WHEN s.winner = s.team THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS observed, {r4("CASE WHEN side_no = 1 THEN wins_a ELSE wins_b END / CAST(wins_a + wins_b AS DOUBLE)", 6)} AS game_rate,
  {r4("1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (o.rating - m.rating) / 400.0::DOUBLE))", 6)} AS p, {r4(case('tier', D.TIER_WEIGHT, '8') + " * CASE best_of WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.05::DOUBLE WHEN 3 THEN 1.12::DOUBLE ELSE 1.25::DOUBLE END", 4)} AS weight
  FROM series_sides s JOIN records m ON s.team = m.team JOIN records o ON s.opponent = o.team WHERE state = 'completed'),
expecting AS (SELECT *, {expectation('p')} AS expected FROM played),
ledger AS (SELECT *, {r4("0.5::DOUBLE * (observed - 0.5::DOUBLE) + 0.35::DOUBLE * (observed - expected) + 0.15::DOUBLE * (game_rate - p)", 6)} AS value FROM expecting)"""
_ROLES = D.ROLE_NAMES
PARTS["rosters"] = f"""
fielded AS (SELECT team_a AS team, date, {", ".join(f"arg_max(player, series_id * 10 + game_number) FILTER (role = {i}) AS {r}" for i, r in enumerate(_ROLES))} FROM games GROUP BY ALL),
rosters AS (SELECT *, {", ".join(f"lag({r}) OVER (PARTITION BY team ORDER BY date) AS {r}_before" for r in _ROLES)} FROM fielded)"""
_SAME = {r: f"coalesce({r} = {r}_before, false)" for r in _ROLES}
_NOW, _BEFORE = f"list_filter([{', '.join(_ROLES)}], lambda x: x IS NOT NULL)", f"list_filter([{', '.join(r + '_before' for r in _ROLES)}], lambda x: x IS NOT NULL)"


def one(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


PARTS["continuity"] = f"""
kept AS (SELECT *, {r4(f"CASE WHEN len({_NOW}) = 5 AND len({_BEFORE}) = 5 THEN coalesce(" + " + ".join(f"{d(D.ROLE_SHARES[i])} * {one(f'list_contains({_NOW}, {r}_before)')}" for i, r in enumerate(_ROLES)) + ", 0) ELSE 0.0::DOUBLE END")} AS retained,
  {r4(f"CASE WHEN len({_BEFORE}) > 0 THEN len(list_intersect({_NOW}, {_BEFORE})) / CAST(len({_BEFORE}) AS DOUBLE) ELSE 0.0::DOUBLE END")} AS synergy,
  {r4(f"0.4::DOUBLE * {one(_SAME['jungle'] + ' AND ' + _SAME['mid'])} + 0.3::DOUBLE * {one(_SAME['bot'] + ' AND ' + _SAME['support'])} + 0.15::DOUBLE * {one(_SAME['top'] + ' AND ' + _SAME['jungle'])} + 0.1::DOUBLE * {one(_SAME['support'])} + 0.05::DOUBLE * {one(_SAME['jungle'])}")} AS critical FROM rosters),
continuity AS (SELECT *, {r4("0.2::DOUBLE * 1.0::DOUBLE + 0.5::DOUBLE * retained + 0.2::DOUBLE * synergy + 0.1::DOUBLE * critical")} AS carryover, {r4("greatest(least(0.75::DOUBLE * retained + 0.15::DOUBLE * synergy + 0.1::DOUBLE * 1.0::DOUBLE, 1.0::DOUBLE), 0.05::DOUBLE)")} AS validity FROM kept)"""
# A series' roster is as valid as the share of its date's players that the team has in its last one.
PARTS["components"] = f"""
lasts AS (SELECT team, {_NOW} AS last_players FROM rosters QUALIFY row_number() OVER (PARTITION BY team ORDER BY date DESC) = 1),
valid AS (SELECT r.team, r.date, {r4(f"CASE WHEN len({_NOW}) > 0 THEN greatest(0.05::DOUBLE, len(list_intersect({_NOW}, last_players)) / CAST(len({_NOW}) AS DOUBLE)) ELSE 0.5::DOUBLE END")} AS validity FROM rosters r JOIN lasts l ON r.team = l.team),
entries AS (SELECT l.*, coalesce(CASE WHEN side_no = 1 THEN v.validity END, 0.5::DOUBLE) AS validity FROM ledger l LEFT JOIN valid v ON l.team = v.team AND l.date = v.date),
sums AS (SELECT team, count(*) AS series, {total('value * (weight * validity)')} AS value_sum, {total('weight * validity')} AS era_weight, {total('weight')} AS total_weight, {total('(other - 1500.0::DOUBLE) / 400.0::DOUBLE * (weight * validity)')} AS schedule_sum, {total('observed - expected')} AS wins_above, {total('game_rate - p')} AS games_above, max(date) AS last_date FROM entries GROUP BY team),
rates AS (SELECT *, {r4('sqrt(era_weight / (era_weight + 120.0::DOUBLE))', 6)} AS volume, {r4('value_sum / era_weight', 6)} AS resume_rate, {r4('schedule_sum / era_weight', 6)} AS schedule_rate, {r4('era_weight / total_weight', 6)} AS validity FROM sums),
pts AS (SELECT *, {r4('420.0::DOUBLE * resume_rate * volume')} AS resume_points, {r4('90.0::DOUBLE * schedule_rate * volume')} AS schedule_points, {r4('greatest(0.65::DOUBLE - validity, 0.0::DOUBLE) * 20.0::DOUBLE')} AS instability FROM rates),
components AS (SELECT *, {r4('1500.0::DOUBLE + resume_points + schedule_points - instability', 2)} AS score FROM pts)"""
_DESERVED = "sides records series series_sides ledger rosters components"


def ledger(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    series = S.resolve_series(games)
    return D.ledger(series, S.team_records(games).select("team", "rating")), series, games


def valid_entries(spark, sf_dir):
    rows, series, games = ledger(spark, sf_dir)
    rosters = D.rosters_by_date(games)
    now = F.array_compact(F.array(*_ROLES))
    listed = rosters.select("team", "date", now.alias("players"))
    last = listed.groupBy("team").agg(F.max_by("players", "date").alias("last_players"))
    share = F.greatest(F.lit(0.05), F.size(F.array_intersect("players", "last_players")) / F.size("players"))
    valid = listed.join(last, "team").select("team", "date", half_up(F.when(F.size("players") > 0, share).otherwise(0.5), 4).alias("validity"))
    home = series.select("series_id", F.col("team_a").alias("team")).withColumn("home", F.lit(True))
    out = rows.join(valid, ["team", "date"], "left").join(home, ["series_id", "team"], "left")
    return out.withColumn("validity", F.coalesce(F.when(F.col("home"), F.col("validity")), F.lit(0.5))).drop("home")


def components(spark, sf_dir):
    return D.team_components(valid_entries(spark, sf_dir))


@query("m2_series_ledger", "SELECT series_id, team, observed, expected, game_rate, p, weight, value FROM ledger", "sides records series series_sides ledger")
def m2_series_ledger(spark, sf_dir):
    return ledger(spark, sf_dir)[0].select("series_id", "team", "observed", "expected", "game_rate", "p", "weight", "value")


@query("m4_team_components", "SELECT team, series, volume, resume_rate, resume_points, schedule_rate, schedule_points, validity, instability, score FROM components", _DESERVED)
def m4_team_components(spark, sf_dir):
    return components(spark, sf_dir).select("team", "series", "volume", "resume_rate", "resume_points", "schedule_rate", "schedule_points", "validity", "instability", "score")


_UNCERTAIN = r4("greatest(30.0::DOUBLE, least(140.0::DOUBLE, 30.0::DOUBLE + 80.0::DOUBLE * exp(-greatest(era_weight, 0.0::DOUBLE) / 160.0::DOUBLE) + 20.0::DOUBLE * (1.0::DOUBLE - validity) + CASE WHEN idle <= 30 THEN 0.0::DOUBLE WHEN idle <= 60 THEN 5.0::DOUBLE WHEN idle <= 90 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END))")


@query("m5_team_model", f", t AS (SELECT *, (SELECT max(date) FROM series) - last_date AS idle FROM components), u AS (SELECT *, {_UNCERTAIN} AS uncertainty FROM t) SELECT team, score, {r4('wins_above', 2)} AS wins_above, {r4('games_above', 2)} AS games_above, uncertainty, {r4('score - 0.35::DOUBLE * uncertainty', 2)} AS conservative, row_number() OVER (ORDER BY score DESC, u.wins_above DESC, team) AS rank FROM u", _DESERVED)
def m5_team_model(spark, sf_dir):
    rows = components(spark, sf_dir)
    end = S.resolve_series(contest_games(spark, sf_dir)).agg(F.max("date").alias("e"))
    rows = D.ranked(rows).crossJoin(F.broadcast(end)).withColumn("uncertainty", D.uncertainty(F.col("era_weight"), F.col("validity"), F.datediff("e", "last_date")))
    return rows.select("team", "score", half_up(F.col("wins_above"), 2).alias("wins_above"), half_up(F.col("games_above"), 2).alias("games_above"), "uncertainty", D.conservative(F.col("score"), F.col("uncertainty")).alias("conservative"), "rank")


_KINDS = {"worlds-playoffs": "worlds", "msi-bracket": "msi", "major-playoffs": "majorRegion"}


@query(
    "m7_stage_points",
    f""", best AS (SELECT team, season, {case('tier', _KINDS)} AS kind, max(CASE WHEN best_of = 5 AND winner = team THEN 3 WHEN best_of = 5 THEN 2 WHEN best_of = 3 THEN 1 ELSE 0 END) AS stage FROM series_sides WHERE tier IN ('worlds-playoffs', 'msi-bracket', 'major-playoffs') GROUP BY ALL),
p AS (SELECT team, CAST(sum(CASE kind {" ".join(f"WHEN {quoted(k)} THEN {list(v)}[stage + 1]" for k, v in D.STAGES.items())} END) AS BIGINT) AS points FROM best GROUP BY team)
SELECT p.team, points, {r4('greatest(least(points::DOUBLE, abs(resume_points) * 0.15::DOUBLE), -(abs(resume_points) * 0.15::DOUBLE))')} AS counted FROM p JOIN components c ON p.team = c.team""",
    _DESERVED,
)
def m7_stage_points(spark, sf_dir):
    rows = S.sides(S.resolve_series(contest_games(spark, sf_dir))).where(F.col("tier").isin(*_KINDS))
    kind = F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p])[F.col("tier")]
    stage = F.when((F.col("best_of") == 5) & S.won(), 3).when(F.col("best_of") == 5, 2).when(F.col("best_of") == 3, 1).otherwise(0)
    best = rows.groupBy("team", "season", kind.alias("kind")).agg(F.max(stage).alias("stage"))
    points = best.groupBy("team").agg(F.sum(D.stage_points(F.col("kind"), F.col("stage"))).alias("points"))
    out = points.join(components(spark, sf_dir).select("team", "resume_points"), "team")
    return out.select("team", "points", half_up(D.capped(F.col("points").cast("double"), F.col("resume_points")), 4).alias("counted"))


@query(
    "m8_incoming_credit",
    f""", p AS (SELECT season, team_a AS team, league_a AS league, player, role, count(*) AS games, count(*) FILTER (winner = team_a) AS wins, count(*) FILTER (winner = team_a AND tier IN ('worlds-playoffs', 'msi-bracket')) AS abroad FROM games GROUP BY ALL),
seasons AS (SELECT season, team, sum(games) AS team_games FROM p GROUP BY ALL),
news AS (SELECT n.*, b.games AS old_games, b.wins AS old_wins, b.abroad AS old_abroad, b.league AS old_league FROM p n LEFT JOIN p s ON s.team = n.team AND s.player = n.player AND s.season + 1 = n.season
  JOIN (SELECT season, player, sum(games) AS games, sum(wins) AS wins, sum(abroad) AS abroad, min(league) AS league FROM p GROUP BY ALL) b ON b.player = n.player AND b.season + 1 = n.season WHERE s.player IS NULL),
c AS (SELECT season, team, count(*) AS players, {total("CASE role WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN 0.22::DOUBLE WHEN 2 THEN 0.23::DOUBLE WHEN 3 THEN 0.21::DOUBLE ELSE 0.16::DOUBLE END * (0.55::DOUBLE * ((old_wins / CAST(old_games AS DOUBLE) - 0.5::DOUBLE) * 100.0::DOUBLE) + 0.35::DOUBLE * (2 * old_wins - old_games) + 0.1::DOUBLE * old_abroad) * CASE WHEN old_league = league THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END")} AS raw FROM news GROUP BY ALL)
SELECT c.season, c.team, players, {r4('raw', 4)} AS raw, {r4("greatest(-30.0::DOUBLE, least(30.0::DOUBLE, raw * 1.0::DOUBLE * exp(-greatest(s.team_games / 10.0::DOUBLE, 0.0::DOUBLE) / 80.0::DOUBLE)))")} AS credit FROM c JOIN seasons s ON s.season = c.season AND s.team = c.team""",
)
def m8_incoming_credit(spark, sf_dir):
    abroad = F.col("tier").isin("worlds-playoffs", "msi-bracket")
    won = F.col("winner") == F.col("team_a")
    rows = contest_games(spark, sf_dir).groupBy("season", F.col("team_a").alias("team"), F.col("league_a").alias("league"), "player", "role").agg(F.count("*").alias("games"), F.count_if(won).alias("wins"), F.count_if(won & abroad).alias("abroad"))
    seasons = rows.groupBy("season", "team").agg(F.sum("games").alias("team_games"))
    stayed = rows.select((F.col("season") + 1).alias("season"), "team", "player")
    before = rows.groupBy((F.col("season") + 1).alias("season"), "player").agg(F.sum("games").alias("old_games"), F.sum("wins").alias("old_wins"), F.sum("abroad").alias("old_abroad"), F.min("league").alias("old_league"))
    news = rows.join(stayed, ["season", "team", "player"], "left_anti").join(before, ["season", "player"])
    share = F.element_at(F.array(*[F.lit(x) for x in D.ROLE_SHARES]), (F.col("role") + 1).cast("int"))
    asset = D.player_asset((F.col("old_wins") / F.col("old_games") - 0.5) * 100.0, (2 * F.col("old_wins") - F.col("old_games")).cast("double"), F.col("old_abroad").cast("double"))
    fits = F.when(F.col("old_league") == F.col("league"), D.INTEGRATION["sameRoleSameRegion"]).otherwise(D.INTEGRATION["crossRegionImportSameRole"])
    out = news.groupBy("season", "team").agg(F.count("*").alias("players"), D.exact(share * asset * fits).alias("raw")).join(seasons, ["season", "team"])
    return out.select("season", "team", "players", half_up(F.col("raw"), 4).alias("raw"), D.bridge_credit(F.col("raw"), F.col("team_games") / 10.0, F.lit(1.0)).alias("credit"))


_SEED = f"CASE region {' '.join(f'WHEN {quoted(k)} THEN CASE WHEN seed <= {len(v)} THEN {list(v)}[seed] ELSE {v[-1]} - (seed - {len(v)}) * 25 END' for k, v in D.SEEDS.items())} END"
PARTS["seeds"] = f"seeds AS (SELECT *, {_SEED} AS strength FROM (SELECT team, {case('league', REGIONS)} AS region, row_number() OVER (PARTITION BY league ORDER BY rating DESC, team) AS seed FROM records))"


def seeds(spark, sf_dir):
    region = F.create_map(*[F.lit(x) for p in REGIONS.items() for x in p])[F.col("league")]
    seed = F.row_number().over(Window.partitionBy("league").orderBy(F.col("rating").desc(), "team"))
    rows = records(spark, sf_dir).select("team", region.alias("region"), seed.alias("seed"))
    return rows.withColumn("strength", D.seed_strength(F.col("region"), F.col("seed")))


@query("m11_seed_strengths", "SELECT team, region, seed, strength FROM seeds", "sides records seeds")
def m11_seed_strengths(spark, sf_dir):
    return seeds(spark, sf_dir).select("team", "region", F.col("seed").cast("long").alias("seed"), "strength")


@query(
    "m12_region_scores",
    f""", ab AS (SELECT e.*, a.region, {r4("1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (b.strength - a.strength) / 400.0::DOUBLE))", 6)} AS q FROM entries e JOIN seeds a ON e.team = a.team JOIN seeds b ON e.opponent = b.team WHERE e.league <> e.opponent_league AND e.tier IN ('worlds-playoffs', 'msi-bracket')),
sx AS (SELECT *, {expectation('q')} AS seed_expected FROM ab),
g AS (SELECT region, count(*) AS n, {total('weight * validity')} AS w, {total('(0.45::DOUBLE * (observed - 0.5::DOUBLE) + 0.4::DOUBLE * (observed - expected) + 0.15::DOUBLE * (game_rate - p)) * (weight * validity)')} AS value_sum, {total('(observed - seed_expected) * (weight * validity)')} AS seed_sum FROM sx GROUP BY region),
tm AS (SELECT region, score - 1500.0::DOUBLE AS residual, row_number() OVER (PARTITION BY region ORDER BY score DESC, c.team) AS r FROM components c JOIN seeds s ON c.team = s.team),
tops AS (SELECT region, {total('residual').replace('))) AS DOUBLE)', '))) FILTER (r <= 2) AS DOUBLE)')} / count(*) FILTER (r <= 2) AS top_end, {total('residual')} / count(*) AS depth FROM tm WHERE r <= 4 GROUP BY region),
pr AS (SELECT DISTINCT region, 1500.0::DOUBLE AS prior FROM seeds),
j AS (SELECT pr.region, prior, n, top_end, depth, {r4('CASE WHEN coalesce(w, 0) > 0 THEN w / (w + 160.0::DOUBLE) ELSE 0.0::DOUBLE END', 6)} AS connectivity, {r4('CASE WHEN coalesce(w, 0) > 0 THEN value_sum / w ELSE 0.0::DOUBLE END', 6)} AS resume_rate, {r4('CASE WHEN coalesce(w, 0) > 0 THEN seed_sum / w ELSE 0.0::DOUBLE END', 6)} AS seed_rate FROM pr LEFT JOIN g ON pr.region = g.region LEFT JOIN tops t ON pr.region = t.region),
k AS (SELECT *, {r4('1500.0::DOUBLE + 380.0::DOUBLE * resume_rate * connectivity + 90.0::DOUBLE * seed_rate * connectivity + (0.6::DOUBLE * coalesce(top_end, 0.0::DOUBLE) + 0.4::DOUBLE * coalesce(depth, 0.0::DOUBLE)) * least(connectivity, 0.75::DOUBLE)')} AS raw FROM j),
l AS (SELECT *, {r4('connectivity * raw + (1.0::DOUBLE - connectivity) * prior', 2)} AS score FROM k)
SELECT region, coalesce(n, 0) AS series, connectivity, resume_rate, seed_rate, raw, score, row_number() OVER (ORDER BY score DESC, region) AS rank FROM l""",
    _DESERVED + " seeds",
)
def m12_region_scores(spark, sf_dir):
    entries = valid_entries(spark, sf_dir).where(F.col("tier").isin("worlds-playoffs", "msi-bracket") & (F.col("league") != F.col("opponent_league")))
    own = seeds(spark, sf_dir).select("team", "region", "strength")
    rows = entries.join(own, "team").join(own.select(F.col("team").alias("opponent"), F.col("strength").alias("other_strength")), "opponent")
    q = half_up(1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("other_strength") - F.col("strength")) / 400.0)), 6)
    rows = rows.withColumn("q", q).withColumn("seed_expected", D.series_expectation(F.col("q"), F.col("best_of")))
    teams = components(spark, sf_dir).join(own.select("team", "region"), "team").select("region", "team", "score")
    priors = own.select("region").distinct().withColumn("prior", F.lit(1500.0))
    return D.region_scores(rows, teams, priors)


@query(
    "m13_public_comparison",
    f""", b AS (SELECT team, rating, games >= 20 AS eligible, row_number() OVER (ORDER BY games >= 20 DESC, rating DESC, team) AS rank FROM records), x AS (SELECT *, row_number() OVER (ORDER BY score DESC, wins_above DESC, team) AS deserved_rank FROM components)
SELECT b.team, b.rank, deserved_rank, b.rank - deserved_rank AS rank_gap, {r4('score - b.rating', 0)} AS score_gap, {r4('validity', 3)} AS validity, {r4('wins_above', 2)} AS wins_above, CASE WHEN deserved_rank IS NULL THEN 'no-resume' WHEN eligible THEN 'eligible' ELSE 'provisional' END AS eligibility FROM b LEFT JOIN x ON b.team = x.team""",
    _DESERVED,
)
def m13_public_comparison(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("eligible", F.col("games") >= 20)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("eligible").desc(), F.col("rating").desc(), "team")).cast("long"))
    return D.public_comparison(rows, D.ranked(components(spark, sf_dir)))


@query("m14_roster_continuity", "SELECT team, date, retained, synergy, critical, carryover, validity FROM continuity", "rosters continuity")
def m14_roster_continuity(spark, sf_dir):
    return D.with_continuity(D.rosters_by_date(contest_games(spark, sf_dir))).select("team", "date", "retained", "synergy", "critical", "carryover", "validity")


@query("m15_substitutes", f", s AS (SELECT team_a AS team, season, player, count(DISTINCT series_id) AS series, count(*) AS games FROM games GROUP BY ALL), t AS (SELECT *, {r4('games / CAST(sum(games) OVER (PARTITION BY team, season) AS DOUBLE)')} AS share FROM s) SELECT *, series >= 3 OR share >= 0.2 AS era FROM t")
def m15_substitutes(spark, sf_dir):
    return D.substitutes(contest_games(spark, sf_dir))


# Players.

def _score(name: str, i: int) -> str:
    weight, spread = P.PARTS[name]
    base = case("role_name", {r: float(v[i]) for r, v in P.BASELINES.items()})
    return f"coalesce(least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.5::DOUBLE + ({name} - {base}) / {d(2.0 * spread)})), 0.5::DOUBLE)"


_RAW = r4("least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.38::DOUBLE * CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" + "".join(f" + {d(w)} * {_score(n, i)}" for i, (n, (w, _)) in enumerate(P.PARTS.items())) + "))", 6)
_TOP = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {n} IS NOT NULL THEN {d(w)} * {_score(n, i)} ELSE 0.0::DOUBLE END" for i, (n, (w, _)) in enumerate(P.PARTS.items()))])
_LOW = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {n} IS NOT NULL THEN {d(w)} ELSE 0.0::DOUBLE END" for n, (w, _) in P.PARTS.items())])
PARTS["lines"] = f"""
told AS (SELECT g.*, {list(_ROLES)}[role + 1] AS role_name, winner = team_a AS won, {r4('CAST(kills AS DOUBLE) / CAST(sum(CAST(kills AS DECIMAL(18,2))) OVER (PARTITION BY series_id) AS DOUBLE)', 6)} AS damage_share, {r4('CAST(gold AS DOUBLE) / CAST(sum(CAST(gold AS DECIMAL(18,2))) OVER (PARTITION BY series_id) AS DOUBLE)', 6)} AS gold_share,
  {r4('(CAST(kills AS DOUBLE) + CAST(best_of AS DOUBLE)) / greatest(CAST(game_number * 4 AS DOUBLE), 1.0::DOUBLE)', 6)} AS kda, CASE WHEN side_a IS NOT NULL THEN game_number * 0.5::DOUBLE END AS vspm FROM games g),
stat_lines AS (SELECT *, {_RAW} AS raw, {r4(f'CASE WHEN {_LOW} > 0 THEN ({_TOP}) / ({_LOW}) END', 6)} AS no_win FROM told)"""
PARTS["pairs"] = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id, role ORDER BY game_number) AS number FROM stat_lines),
pairs AS (SELECT a.*, b.player AS opponent_player, b.no_win AS opponent_no_win, b.league_a AS opponent_league, b.side_a AS opponent_side, b.game_number AS opponent_game, {r4('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + (a.raw - b.raw) / 2.0::DOUBLE))', 6)} AS performance
  FROM numbered a JOIN numbered b ON a.series_id = b.series_id AND a.role = b.role AND (a.number - 1) // 2 = (b.number - 1) // 2 AND a.number <> b.number)"""


def player_lines(spark, sf_dir, games=None):
    """Lines of players out of games: shares of kills and gold in their series, and numbers that may be missing."""
    own = Window.partitionBy("series_id")
    share = lambda c: half_up(F.col(c).cast("double") / F.sum(F.col(c).cast("decimal(18,2)")).over(own).cast("double"), 6)
    games = contest_games(spark, sf_dir) if games is None else games
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("role") + 1).cast("int"))
    rows = games.withColumns({"damage_share": share("kills"), "gold_share": share("gold"), "role": role, "won": F.col("winner") == F.col("team_a"), "deaths": F.col("game_number") * 4, "assists": F.col("best_of").cast("double"), "vspm": F.when(F.col("side_a").isNotNull(), F.col("game_number") * 0.5), "league": F.col("league_a"), "side": F.col("side_a"), "team": F.col("team_a")})
    return P.with_scores(rows.withColumn("kills", F.col("kills").cast("double")))


def player_pairs(spark, sf_dir, lines=None, carried=("player", "league", "side", "raw", "no_win")):
    return P.matchups(player_lines(spark, sf_dir) if lines is None else lines, ["series_id"], ["game_number"], carried)


@query("j26_stat_performance", "SELECT series_id, game_number, player, raw, no_win FROM stat_lines", "lines")
def j26_stat_performance(spark, sf_dir):
    return player_lines(spark, sf_dir).select("series_id", "game_number", "player", "raw", "no_win")


_MEAN6 = lambda x: r4(f"{total(x)} / count({x})")


@query("f12_seven_averages", f"SELECT player, role_name AS role, count(*) AS games, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, {_MEAN6('raw')} AS raw, {_MEAN6('no_win')} AS no_win, {_MEAN6('damage_share')} AS damage_share, {_MEAN6('gold_share')} AS gold_share, {_MEAN6('kda')} AS kda, {_MEAN6('vspm')} AS vspm, {r4('CAST(sum(CAST(gold AS DECIMAL(18,2))) AS DOUBLE) / count(*)', 2)} AS gold FROM stat_lines GROUP BY ALL", "lines")
def f12_seven_averages(spark, sf_dir):
    lines = player_lines(spark, sf_dir).withColumn("kda", half_up(P.kda(F.col("kills"), F.col("assists"), F.col("deaths")), 6))
    average = lambda c: half_up(D.exact(F.col(c)) / F.count(c), 4).alias(c)
    gold = half_up(F.sum(F.col("gold").cast("decimal(18,2)")).cast("double") / F.count("*"), 2).alias("gold")
    return lines.groupBy("player", "role").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), *[average(c) for c in ("raw", "no_win", "damage_share", "gold_share", "kda", "vspm")], gold)


_WEIGHT = f"floor({case('tier', {'worlds-playoffs': 34, 'msi-bracket': 34, 'major-playoffs': 22, 'regional-regular': 14, 'qualifier': 12}, '14')} / 14.0::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
PARTS["player_walk"] = f"""
player_dates AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM pairs)),
player_walk AS (SELECT CAST(0 AS BIGINT) AS i, player, 100.0::DOUBLE AS rating, 100.0::DOUBLE AS frozen FROM (SELECT DISTINCT player FROM pairs)
  UNION ALL SELECT n.i, n.player, {r4('n.rating + coalesce(q.delta, 0)', 1)}, n.rating FROM (SELECT t.i, w.player, w.rating FROM player_walk w JOIN player_dates t ON t.i = w.i + 1) n
  LEFT JOIN (SELECT m.player, sum({r4(f"8.0::DOUBLE * ({_WEIGHT}) * (m.performance - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (b.rating - a.rating) / 80.0::DOUBLE)))", 1)}) AS delta
    FROM player_walk a JOIN player_dates t ON t.i = a.i + 1 JOIN pairs m ON m.date = t.date AND m.player = a.player JOIN player_walk b ON b.player = m.opponent_player GROUP BY m.player) q ON q.player = n.player)"""


@query("l14_player_ratings", f"SELECT w.player, {r4('rating', 1)} AS rating, g.games FROM player_walk w JOIN (SELECT player, count(*) AS games FROM pairs GROUP BY player) g ON g.player = w.player WHERE i = (SELECT max(i) FROM player_walk)", "lines pairs player_walk")
def l14_player_ratings(spark, sf_dir):
    return P.replay_players(player_pairs(spark, sf_dir))[0].select("player", "rating", "games")


@query("j27_published_players", f", e AS (SELECT w.player, w.rating, (SELECT arg_max(league_a, series_id * 10 + game_number) FROM stat_lines l WHERE l.player = w.player) AS league FROM player_walk w WHERE i = (SELECT max(i) FROM player_walk)), b AS (SELECT *, {case('league', LEAGUE_TIERS)} AS tier FROM e), c AS (SELECT *, {r4('least(110.0::DOUBLE, greatest(50.0::DOUBLE, 100.0::DOUBLE + (' + case('tier', T.TIER_PRIORS) + ' - 1500.0::DOUBLE) * 0.2::DOUBLE))', 1)} AS base FROM b) SELECT player, league, base, {r4('base + (rating - base) * ' + case('tier', P.SIGNAL), 1)} AS published FROM c", "lines pairs player_walk")
def j27_published_players(spark, sf_dir):
    lines = player_lines(spark, sf_dir)
    state, _ = P.replay_players(player_pairs(spark, sf_dir, lines))
    league = lines.groupBy("player").agg(F.max_by("league", F.col("series_id") * 10 + F.col("game_number")).alias("league"))
    tier = F.create_map(*[F.lit(x) for p in LEAGUE_TIERS.items() for x in p])[F.col("league")]
    prior = F.create_map(*[F.lit(x) for p in T.TIER_PRIORS.items() for x in p])[F.col("tier")]
    rows = state.join(league, "player").withColumn("tier", tier).withColumn("base", P.league_baseline(prior))
    return rows.select("player", "league", "base", P.published(F.col("rating"), F.col("base"), F.col("tier")).alias("published"))


@query(
    "j28_player_shares",
    f""", e AS (SELECT player, rating FROM player_walk WHERE i = (SELECT max(i) FROM player_walk)), f AS (SELECT player, team_a AS team, role_name AS role, won, row_number() OVER (PARTITION BY player, team_a ORDER BY series_id * 10 + game_number DESC) AS back FROM stat_lines),
g AS (SELECT player, team, role, count(*) FILTER (won) / CAST(count(*) AS DOUBLE) AS form FROM f WHERE back <= 5 GROUP BY ALL),
h AS (SELECT g.*, least(1.45::DOUBLE, greatest(0.7::DOUBLE, 1.0::DOUBLE + 0.12::DOUBLE * least(3.0::DOUBLE, greatest(-3.0::DOUBLE, 0.0::DOUBLE + least(2.0::DOUBLE, greatest(-2.0::DOUBLE, (rating - 100.0::DOUBLE) / 24.0::DOUBLE)) * 0.35::DOUBLE)) + 0.06::DOUBLE * 0.0::DOUBLE + 0.04::DOUBLE * least(3.0::DOUBLE, greatest(-3.0::DOUBLE, (form - 0.5::DOUBLE) * 2.0::DOUBLE)))) AS x FROM g JOIN e ON g.player = e.player),
k AS (SELECT *, CAST({r4(case('role', P.ROLE_SHARES) + ' * x', 6)} AS DECIMAL(18,6)) AS w FROM h)
SELECT team, player, {r4('x', 2)} AS impact, {r4('CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY team) AS DOUBLE)')} AS share FROM k""",
    "lines pairs player_walk",
)
def j28_player_shares(spark, sf_dir):
    lines = player_lines(spark, sf_dir)
    state, _ = P.replay_players(player_pairs(spark, sf_dir, lines))
    back = F.row_number().over(Window.partitionBy("player", "team").orderBy((F.col("series_id") * 10 + F.col("game_number")).desc()))
    form = lines.withColumn("back", back).where("back <= 5").groupBy("player", "team", "role").agg((F.count_if("won") / F.count("*")).alias("form"))
    return P.player_shares(form.join(state.select("player", "rating"), "player"), ["team"]).select("team", "player", "impact", "share")


PARTS["frozen_players"] = "frozen_players AS (SELECT t.date, w.player, w.frozen, w.i FROM player_walk w JOIN player_dates t ON t.i = w.i)"


_EDGES = f"""seen AS (SELECT player, date, coalesce(sum(n) OVER (PARTITION BY player ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS games FROM (SELECT player, date, count(*) AS n FROM pairs GROUP BY ALL)),
r AS (SELECT DISTINCT p.series_id, p.team_a AS team, p.role_name AS role, p.player, f.frozen, s.games, {case('p.league_a', {k: round(min(110.0, max(50.0, 100.0 + (T.TIER_PRIORS[t] - 1500.0) * 0.2)), 1) for k, t in LEAGUE_TIERS.items()})} AS base, {case('p.league_a', {k: P.SIGNAL[t] for k, t in LEAGUE_TIERS.items()})} AS signal FROM pairs p JOIN frozen_players f ON f.date = p.date AND f.player = p.player JOIN seen s ON s.player = p.player AND s.date = p.date),
e AS (SELECT series_id AS game, team, {total("CASE WHEN games >= 1 THEN " + case('role', P.ROLE_SHARES) + " ELSE 0.0::DOUBLE END")} AS coverage, {total("CASE WHEN games >= 1 THEN " + case('role', P.ROLE_SHARES) + " * (frozen - base) * signal ELSE 0.0::DOUBLE END")} AS edge FROM r GROUP BY ALL)"""
_EDGE = f"""SELECT game, team, {r4('coverage')} AS coverage, CASE WHEN coverage >= 0.6 THEN {r4("CASE WHEN abs(2.5::DOUBLE * edge) <= 40.0::DOUBLE THEN 2.5::DOUBLE * edge ELSE sign(2.5::DOUBLE * edge) * least(40.0::DOUBLE + (abs(2.5::DOUBLE * edge) - 40.0::DOUBLE) * 0.4::DOUBLE, 70.0::DOUBLE) END", 1)} ELSE 0.0::DOUBLE END AS edge FROM e"""
PARTS["edges"] = f"{_EDGES}, edges AS ({_EDGE})"


@query("l15_pregame_edges", f", {_EDGES}\n{_EDGE}", "lines pairs player_walk frozen_players")
def l15_pregame_edges(spark, sf_dir):
    return pregame_edges(spark, sf_dir)


def pregame_edges(spark, sf_dir, games=None):
    """Edges of all sides; pairs are written down, as the replay and the edges each read them."""
    pairs = player_pairs(spark, sf_dir, player_lines(spark, sf_dir, games)).select("series_id", "date", "team", "role", "player", "opponent_player", "league", "tier", "performance")
    pairs = write_back(pairs, f"{new_path(spark, 'edges')}/pairs")
    _, frozen = P.replay_players(pairs)
    tier = F.create_map(*[F.lit(x) for p in LEAGUE_TIERS.items() for x in p])[F.col("league")]
    prior = F.create_map(*[F.lit(x) for p in T.TIER_PRIORS.items() for x in p])[tier]
    rows = pairs.select(F.col("series_id").alias("game"), "team", "role", "player", F.unix_date("date").cast("long").alias("period"), P.league_baseline(prior).alias("base"), F.create_map(*[F.lit(x) for p in P.SIGNAL.items() for x in p])[tier].alias("signal")).distinct()
    return P.pregame_edges(rows.join(frozen.select("period", "player", "rating", "games"), ["period", "player"]))


PARTS["controls"] = f"""
views AS (SELECT role_name AS role, league_a AS league, side_a AS side, patch, tier, no_win, series_id, game_number, player, won FROM stat_lines),
m0 AS (SELECT role, {r4(total('no_win') + ' / count(*)', 6)} AS mean FROM views WHERE no_win IS NOT NULL GROUP BY role),
{", ".join(f"m_{c} AS (SELECT role, {c}, {r4(total('no_win') + ' / count(*)', 6)} AS mean FROM views WHERE no_win IS NOT NULL GROUP BY ALL)" for c in ("league", "side", "patch", "tier"))},
controls AS (SELECT v.*, {r4("0.35::DOUBLE * coalesce(m0.mean, coalesce(m0.mean, 0.5::DOUBLE)) + 0.25::DOUBLE * coalesce(m_league.mean, coalesce(m0.mean, 0.5::DOUBLE)) + 0.1::DOUBLE * coalesce(m_side.mean, coalesce(m0.mean, 0.5::DOUBLE)) + 0.15::DOUBLE * coalesce(m_patch.mean, coalesce(m0.mean, 0.5::DOUBLE)) + 0.15::DOUBLE * coalesce(m_tier.mean, coalesce(m0.mean, 0.5::DOUBLE))", 6)} AS expected
  FROM views v LEFT JOIN m0 ON v.role = m0.role {" ".join(f"LEFT JOIN m_{c} ON v.role = m_{c}.role AND v.{c} IS NOT DISTINCT FROM m_{c}.{c}" for c in ("league", "side", "patch", "tier"))})"""


@query(
    "f10_six_controls",
    f"SELECT role, league, side, patch, tier, count(*) AS games, {r4(total('no_win') + ' / count(*)', 6)} AS mean, grouping(role, league, side, patch, tier) AS grouping FROM (SELECT role_name AS role, league_a AS league, side_a AS side, patch, tier, no_win FROM stat_lines WHERE no_win IS NOT NULL) GROUP BY GROUPING SETS ((), (role), (role, league), (role, side), (role, patch), (role, tier))",
    "lines",
)
def f10_six_controls(spark, sf_dir):
    return P.control_means(player_lines(spark, sf_dir))


PARTS["residual_rows"] = f"""
residual_rows AS (SELECT p.series_id, p.game_number, p.player, p.role_name AS role, p.league_a AS league, p.won, {r4(f"(p.no_win - p.opponent_no_win) - ((a.expected - b.expected) + {r4('(1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (y.frozen - x.frozen) / 80.0::DOUBLE)) - 0.5::DOUBLE) * 0.28::DOUBLE', 6)})", 6)} AS residual
  FROM pairs p JOIN controls a ON a.series_id = p.series_id AND a.game_number = p.game_number JOIN controls b ON b.series_id = p.series_id AND b.game_number = p.opponent_game JOIN frozen_players x ON x.date = p.date AND x.player = p.player JOIN frozen_players y ON y.date = p.date AND y.player = p.opponent_player)"""


_RESIDUAL_LINES = ("series_id", "game_number", "date", "player", "role", "league", "side", "patch", "tier", "won", "raw", "no_win")


def residual_rows(spark, sf_dir):
    """Residuals of all lines; lines and pairs are written down, as means, replay and residuals each read them."""
    path = new_path(spark, "residuals")
    lines = write_back(player_lines(spark, sf_dir).select(*_RESIDUAL_LINES), f"{path}/lines")
    pairs = player_pairs(spark, sf_dir, P.with_control(lines), ("player", "raw", "no_win", "expected"))
    pairs = write_back(pairs, f"{path}/pairs")
    _, frozen = P.replay_players(pairs)
    return P.residuals(pairs, frozen)


@query("l17_residuals", "SELECT series_id, game_number, player, residual FROM residual_rows", "lines pairs player_walk frozen_players controls residual_rows")
def l17_residuals(spark, sf_dir):
    return residual_rows(spark, sf_dir).select("series_id", "game_number", "player", "residual")


@query(
    "f14_residual_scores",
    f""", lg AS (SELECT player, league, count(*) AS n FROM residual_rows GROUP BY ALL), ml AS (SELECT player, league AS main_league FROM lg QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, league) = 1),
s AS (SELECT player, role, count(*) AS games, count(*) FILTER (won) AS wins, {r4(total('residual') + ' / count(residual)', 3)} AS residual, count(residual) AS known FROM residual_rows GROUP BY ALL)
SELECT s.player, role, games, wins, residual, {r4('least(160.0::DOUBLE, greatest(40.0::DOUBLE, 100.0::DOUBLE + coalesce(residual, 0.0::DOUBLE) * 100.0::DOUBLE))', 1)} AS score, {r4('100.0::DOUBLE * least(1.0::DOUBLE, games / 60.0::DOUBLE) * (known / CAST(games AS DOUBLE))', 1)} AS confidence, main_league FROM s JOIN ml ON s.player = ml.player""",
    "lines pairs player_walk frozen_players controls residual_rows",
)
def f14_residual_scores(spark, sf_dir):
    return P.residual_scores(residual_rows(spark, sf_dir))


# The whole rating model: an iterative fold, tested against a plain version.


def rated_series(spark, sf_dir, games=None):
    """Series with split and roster continuity."""
    if games is None:
        series = write_back(contest_series(spark, sf_dir), f"{new_path(spark, 'contest')}/series")
        rosters = D.rosters_of_series(series)
        series = series.drop(*[f"last_{i}" for i in range(5)])
    else:
        series, rosters = S.resolve_series(games), D.rosters_by_date(games)
    rosters = D.with_continuity(rosters).select(F.col("team").alias("team_a"), "date", F.when(F.col("synergy") > 0, F.col("synergy")).alias("continuity_a"))
    half = F.when(F.month("date") <= 6, "spring").otherwise("summer")
    return series.join(rosters, ["team_a", "date"], "left").withColumns({"split": half, "continuity_b": F.lit(None).cast("double")})


def model(spark, sf_dir):
    series = write_back(rated_series(spark, sf_dir), f"{new_path(spark, 'rated')}/series")
    return series, R.replay_model(series, LEAGUE_TIERS)


def placement_events(spark, sf_dir, games=None):
    """Entries of the international events, each ending with its last completed series."""
    from .event_queries import staged

    kind = F.when(F.col("instance").startswith("worlds"), "worlds").when(F.col("instance").startswith("msi"), "msi").otherwise("minor")
    done = write_back(staged(spark, sf_dir, games).where("state = 'completed'"), f"{new_path(spark, 'placed')}/series")
    rows = R.after_worlds(done).where("instance is not null")
    return U.placement_entries(rows.withColumns({"event_key": F.col("instance"), "kind": kind}))


def placed_model(spark, sf_dir):
    """The whole model with placements in it and the edges of either side's players as its roster prior."""
    games = stored_games(spark, sf_dir)
    edges = write_back(pregame_edges(spark, sf_dir, games), f"{new_path(spark, 'edges')}/edges").select(F.col("game").alias("series_id"), "team", "edge")
    series = rated_series(spark, sf_dir, games)
    for side in ("a", "b"):
        series = series.join(edges.withColumnsRenamed({"team": f"team_{side}", "edge": f"prior_{side}"}), ["series_id", f"team_{side}"], "left")
    series = write_back(series, f"{new_path(spark, 'rated')}/series")
    return R.replay_placed(series, LEAGUE_TIERS, placement_events(spark, sf_dir, games))


@query("l11_model_placements")
def l11_model_placements(spark, sf_dir):
    """What every event's placements gave each league within the replay, expected by the powers before the event."""
    return placed_model(spark, sf_dir)[3]


@query("p9_prior_predictions")
def p9_prior_predictions(spark, sf_dir):
    """Both sides of every completed series with expected points by the whole model with roster priors and placements."""
    return placed_model(spark, sf_dir)[2].select("series_id", "team", "opponent", "power", "p", "p_team_only", "observed").withColumn("power", half_up(F.col("power"), 3))


@query("l9_model_states")
def l9_model_states(spark, sf_dir):
    """Every team's rating, momentum, uncertainty and roster continuity at the end of the whole model's replay."""
    teams = model(spark, sf_dir)[1][0]
    return teams.select("team", *[half_up(F.col(c), 3).alias(c) for c in ("rating", "momentum", "uncertainty", "continuity")])


@query("l10_league_scores")
def l10_league_scores(spark, sf_dir):
    """Every league's score, its effective rating and its sides abroad at the end of the replay."""
    return model(spark, sf_dir)[1][1].select("league", half_up(F.col("score"), 3).alias("score"), half_up(F.col("effective"), 3).alias("effective"), "abroad")


@query("l6_model_predictions")
def l6_model_predictions(spark, sf_dir):
    """Both sides of every completed series with expected points, by the whole model and by ratings alone."""
    return model(spark, sf_dir)[1][2].select("series_id", "team", "opponent", "p", "p_team_only", "observed")


@query("f20_model_backtest")
def f20_model_backtest(spark, sf_dir):
    """Forecast scores of both variants over all decided series."""
    rows = model(spark, sf_dir)[1][2].where("observed <> 0.5")
    kind = lambda n, c: F.struct(F.lit(n).alias("variant"), F.col(c).alias("p"))
    long = rows.select(F.col("observed").cast("int").alias("y"), F.explode(F.array(kind("whole", "p"), kind("team-only", "p_team_only"))).alias("v")).select("y", "v.*")
    return M.forecast_metrics(long, "variant")


@query("l12_model_standings")
def l12_model_standings(spark, sf_dir):
    """Published standings out of the replayed state: anchor, offsets, relief, nudges, rating and rank."""
    series = rated_series(spark, sf_dir)
    tallies = write_back(R.tallied(series), f"{new_path(spark, 'rated')}/tallies")
    teams, leagues, _ = R.replay_model(series, LEAGUE_TIERS, tallies)
    rows = S.sides(tallies.where("state = 'completed'"))
    total = lambda fits: F.sum(F.when(fits, F.col("n")).otherwise(0))
    record = rows.groupBy("team").agg(F.max_by("league", F.struct("date", "last_id")).alias("league"), total(S.won()).alias("wins"), total(F.col("winner").isNotNull() & ~S.won()).alias("losses"), F.sum("n").alias("matches"))
    record = record.withColumns({"eligible": F.col("matches") >= 20, "basis": F.lit("sourced")})
    return R.standings(teams, leagues, record, tallies)


PARTS["nudged"] = """
able AS (SELECT team, league, rating FROM records WHERE games >= 20),
recent_pairs AS (SELECT *, CASE WHEN winner = team_a THEN team_b ELSE team_a END AS loser FROM series WHERE state = 'completed' AND winner IS NOT NULL AND best_of >= 3 AND (SELECT max(date) FROM series) - date <= 30
  QUALIFY row_number() OVER (PARTITION BY least(team_a, team_b), greatest(team_a, team_b) ORDER BY date DESC, series_id) = 1),
near_pairs AS (SELECT r.winner, r.loser, least(3.0::DOUBLE, (l.rating - w.rating) / 2.0::DOUBLE + 0.8::DOUBLE) AS v FROM recent_pairs r JOIN able w ON w.team = r.winner JOIN able l ON l.team = r.loser WHERE w.league = l.league AND l.rating - w.rating > 0 AND l.rating - w.rating <= 6)"""


@query("l13_nudges", f", e AS (SELECT winner AS team, floor(v * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS v FROM near_pairs UNION ALL SELECT loser, -(floor(v * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE) FROM near_pairs), s AS (SELECT team, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS v FROM e GROUP BY team) SELECT team, {r4('least(3.0::DOUBLE, greatest(-3.0::DOUBLE, v))', 1)} AS nudge FROM s", "sides records series nudged")
def l13_nudges(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    rows = S.team_records(games).select("team", "league", "rating", "games").withColumns({"uncertainty": F.lit(40.0), "basis": F.lit("sourced")})
    return R.nudges(S.resolve_series(games), rows)


@query(
    "j23_published_offsets",
    f""", w AS (SELECT r.team, r.league, rating, wins, games - wins AS losses, games FROM records r), l AS (SELECT *, {case('league', {k: T.TIER_PRIORS[t] for k, t in LEAGUE_TIERS.items()})} AS league_score FROM w), n AS (SELECT *, floor(games / 50) AS matches, rating - 1500.0::DOUBLE AS offset_ FROM l)
SELECT team, {r4('CASE WHEN offset_ * 20 <= 70.0::DOUBLE THEN offset_ * 20 ELSE 70.0::DOUBLE + (offset_ * 20 - 70.0::DOUBLE) * 0.3::DOUBLE END', 3)} AS stable, {r4('1500.0::DOUBLE + (league_score - 1500.0::DOUBLE) * (0.35::DOUBLE + (1.0::DOUBLE - 0.35::DOUBLE) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, matches / 12.0::DOUBLE)))', 3)} AS anchor,
  {r4('CASE WHEN offset_ <= 0 OR games < 12 OR wins / CAST(games AS DOUBLE) >= 0.5 THEN offset_ WHEN wins / CAST(games AS DOUBLE) <= 0.35 THEN ' + r4('offset_ * 0.25::DOUBLE', 1) + ' ELSE ' + r4('offset_ * (0.25::DOUBLE + (1.0::DOUBLE - 0.25::DOUBLE) * (wins / CAST(games AS DOUBLE) - 0.35::DOUBLE) / (0.5::DOUBLE - 0.35::DOUBLE))', 1) + ' END', 3)} AS roster,
  CASE WHEN games >= 20 AND abs(offset_ * 20) >= 15 AND wins <> losses AND sign(wins - losses) = sign(offset_) AND league_score <> 1500 AND sign(league_score - 1500.0::DOUBLE) <> sign(offset_) THEN {r4('sign(offset_) * least(20.0::DOUBLE, abs(league_score - 1500.0::DOUBLE) * 0.35::DOUBLE)', 1)} ELSE 0.0::DOUBLE END AS relief FROM n""",
    "sides records",
)
def j23_published_offsets(spark, sf_dir):
    league = F.create_map(*[F.lit(x) for k, t in LEAGUE_TIERS.items() for x in (k, T.TIER_PRIORS[t])])[F.col("league")]
    rows = records(spark, sf_dir).withColumns({"league_score": league, "losses": F.col("games") - F.col("wins"), "matches": F.floor(F.col("games") / 50), "offset": F.col("rating") - 1500.0})
    wide = F.col("offset") * 20
    relief = R.anchor_relief(F.col("league_score"), 1500.0 + wide, F.col("wins"), F.col("losses"), F.lit(40.0), F.lit("sourced"))
    return rows.select("team", half_up(R.soft_capped(wide), 3).alias("stable"), half_up(R.league_anchor(F.col("league_score"), F.col("matches")), 3).alias("anchor"), half_up(R.roster_prior(F.col("offset"), F.col("wins"), F.col("losses")), 3).alias("roster"), relief.alias("relief"))


@query(
    "l7_segments",
    """, sd AS (SELECT series_id, team, patch, lag(patch) OVER (PARTITION BY team ORDER BY date, series_id) AS before FROM series_sides), ch AS (SELECT series_id, bool_or(before IS NOT NULL AND before <> patch) AS moved FROM sd GROUP BY series_id),
sk AS (SELECT series_id, bool_and(side_a IS NOT NULL) AS known FROM games GROUP BY series_id)
SELECT s.series_id, array_to_string(list_filter([CASE WHEN best_of = 1 THEN 'bo1' END, CASE WHEN best_of >= 3 THEN 'bo3-bo5' END, CASE WHEN tier IN ('worlds-playoffs', 'msi-bracket') THEN 'international' END, CASE WHEN league_a <> league_b THEN 'cross-region' END, CASE WHEN known THEN 'side-known' END, CASE WHEN moved THEN 'patch-transition' END], lambda x: x IS NOT NULL), ',') AS segments FROM series s JOIN ch ON s.series_id = ch.series_id JOIN sk ON s.series_id = sk.series_id""",
    "series series_sides",
)
def l7_segments(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    series = S.resolve_series(games)
    before = F.lag("patch").over(Window.partitionBy("team").orderBy("date", "series_id"))
    moved = S.sides(series).withColumn("before", before).groupBy("series_id").agg(F.bool_or(F.coalesce(F.col("before") != F.col("patch"), F.lit(False))).alias("moved"))
    known = games.groupBy("series_id").agg(F.bool_and(F.col("side_a").isNotNull()).alias("known"))
    tags = F.array(F.when(F.col("best_of") == 1, "bo1"), F.when(F.col("best_of") >= 3, "bo3-bo5"), F.when(F.col("tier").isin(*R.INTERNATIONAL), "international"), F.when(F.col("league_a") != F.col("league_b"), "cross-region"), F.when(F.col("known"), "side-known"), F.when(F.col("moved"), "patch-transition"))
    return series.join(moved, "series_id").join(known, "series_id").select("series_id", F.array_join(F.array_compact(tags), ",").alias("segments"))


@query("j17_worlds_discount", "SELECT s.series_id, CASE WHEN tier NOT IN ('worlds-playoffs', 'worlds-main') AND date > e.d THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM series s LEFT JOIN (SELECT year(date) AS y, max(date) AS d FROM series WHERE tier = 'worlds-playoffs' GROUP BY 1) e ON e.y = year(s.date)", "series")
def j17_worlds_discount(spark, sf_dir):
    return R.after_worlds(S.resolve_series(contest_games(spark, sf_dir))).select("series_id", "multiplier")


# Players of fixed rosters: of each nation's suppliers the first of every role.
_IMPACT_SQL = "least(1.45::DOUBLE, greatest(0.7::DOUBLE, 1.0::DOUBLE + 0.12::DOUBLE * least(3.0::DOUBLE, greatest(-3.0::DOUBLE, {o} + least(2.0::DOUBLE, greatest(-2.0::DOUBLE, ({r} - 100.0::DOUBLE) / 24.0::DOUBLE)) * 0.35::DOUBLE)) + 0.06::DOUBLE * {a} + 0.04::DOUBLE * least(3.0::DOUBLE, greatest(-3.0::DOUBLE, 0.0::DOUBLE + {f}))))"
_RAW_SQL = f"q.b[{{k}}] * {_IMPACT_SQL.format(o='q.o[{k}]', r='s.r[{k}]', a='q.a[{k}]', f='x.form')} * q.v[{{k}}] * q.c[{{k}}]"
_DELTA_SQL = r4(f"x.points * (({_RAW_SQL.format(k='k')}) / list_sum(list_transform(range(1, len(s.r) + 1), lambda j: {_RAW_SQL.format(k='j')})) / 0.2::DOUBLE)", 1)
PARTS["fixed_rosters"] = f"""
fixed AS (SELECT n_name AS team, ['top', 'jungle', 'mid', 'bot', 'support'][s_suppkey % 5 + 1] AS role, min(s_suppkey) AS player FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
players AS (SELECT team, list(player ORDER BY player) AS p, list({case('role', P.ROLE_SHARES)} ORDER BY player) AS b, list(CAST(player % 7 AS DOUBLE) / 2.0::DOUBLE - 1.5::DOUBLE ORDER BY player) AS o, list(CASE WHEN player % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(player % 5 AS DOUBLE) - 2.0::DOUBLE END ORDER BY player) AS a, list(1.0::DOUBLE - CAST(player % 4 AS DOUBLE) / 10.0::DOUBLE ORDER BY player) AS v, list(greatest(0.5::DOUBLE, CAST(player % 11 AS DOUBLE) / 10.0::DOUBLE) ORDER BY player) AS c FROM fixed GROUP BY team),
scored_sides AS (SELECT team, date, series_id, game_number, winner = team AS won, {r4("CASE WHEN winner = team THEN 1.6::DOUBLE ELSE -1.1::DOUBLE END * (" + case('tier', {'worlds-playoffs': 34, 'msi-bracket': 34, 'major-playoffs': 22, 'regional-regular': 14, 'qualifier': 12}, '14') + " / 14.0::DOUBLE) + 5.0::DOUBLE * least(0.25::DOUBLE, greatest(-0.25::DOUBLE, CASE side_no WHEN 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((CAST(kills AS DOUBLE) - 25.0::DOUBLE) / greatest(CAST(kills AS DOUBLE) + 25.0::DOUBLE, 1.0::DOUBLE) * 0.14::DOUBLE + (CAST(gold AS DOUBLE) - 38000.0::DOUBLE) / greatest(CAST(gold AS DOUBLE) + 38000.0::DOUBLE, 1.0::DOUBLE) * 0.72::DOUBLE)))", 6)} AS points FROM sides),
formed AS (SELECT *, row_number() OVER w AS i, {r4('coalesce((avg(CAST(won AS INTEGER)) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - 0.5::DOUBLE) * 2.0::DOUBLE, 0.0::DOUBLE)', 6)} AS form FROM scored_sides WINDOW w AS (PARTITION BY team ORDER BY date, series_id, game_number)),
games_of AS (SELECT team, count(*) AS games, list(struct_pack(points := points, form := form, r := CAST([] AS DOUBLE[]), d := CAST([] AS DOUBLE[])) ORDER BY i) AS g FROM formed GROUP BY team),
shared AS (SELECT q.team, q.p, f.games, list_reduce(list_prepend(struct_pack(points := 0.0::DOUBLE, form := 0.0::DOUBLE, r := list_transform(q.p, lambda x: 100.0::DOUBLE), d := list_transform(q.p, lambda x: 0.0::DOUBLE)), f.g), lambda s, x: struct_pack(points := x.points, form := x.form, r := list_transform(range(1, len(s.r) + 1), lambda k: {r4(f"s.r[k] + {_DELTA_SQL}", 1)}), d := list_transform(range(1, len(s.r) + 1), lambda k: {_DELTA_SQL}))) AS e FROM players q JOIN games_of f ON f.team = q.team)"""


@query("l16_static_players", ", flat AS (SELECT team, unnest(p) AS player, unnest(e.r) AS rating, unnest(e.d) AS delta, games FROM shared) SELECT team, player, rating, delta, games, row_number() OVER (ORDER BY rating DESC, team, player) AS rank FROM flat", "sides fixed_rosters")
def l16_static_players(spark, sf_dir):
    """Ratings of the players of fixed rosters, after all games of their teams."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    role = F.array(*[F.lit(r) for r in P.ROLE_SHARES])[(F.col("s_suppkey") % 5).cast("int")]
    first = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("team", role.alias("role")).agg(F.min("s_suppkey").alias("player"))
    p = F.col("player")
    rosters = first.select("team", "player", "role", (p % 7 / 2.0 - 1.5).alias("objectives"), F.when(p % 3 != 0, (p % 5).cast("double") - 2.0).alias("awards"), F.lit(None).cast("double").alias("recent"), (1.0 - p % 4 / 10.0).alias("availability"), (p % 11 / 10.0).alias("certainty"))
    games = contest_games(spark, sf_dir).select(F.concat_ws("-", "series_id", "game_number").alias("game_key"), "date", "series_id", "game_number", "team_a", "team_b", "winner", "tier", F.col("kills").alias("kills_a"), F.lit(25).alias("kills_b"), F.col("gold").alias("gold_a"), F.lit(38000).alias("gold_b"), F.lit(0).alias("objectives_a"), F.lit(0).alias("objectives_b"))
    return static_rosters.static_players(games, rosters)[0].select("team", "player", "rating", "delta", "games", "rank")
