"""Boards, headlines and labels of every season, and the histories that are published with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import ratings as R
from ..functions.rounding import half_up
from ..operators import board as B
from ..operators import directories as D
from ..operators import history as H
from ..operators import metrics as M
from ..operators import publish as P
from ..operators import series as S
from ..operators.storage import new_path
from ..sources.contest import contest_games
from .analysis_queries import METRICS, mean, predictions, r4
from .history_queries import points, records
from .registry import PARTS, query

_POWER = "CAST(floor(greatest(1000.0::DOUBLE, least(3000.0::DOUBLE, 1800.0::DOUBLE + (rating - 1500.0::DOUBLE) * 3.25::DOUBLE)) + 0.5::DOUBLE) AS BIGINT)"
PARTS["season_board"] = f"""
season_rates AS (SELECT season, team, min(league) AS league, count(*) AS games, count(*) FILTER (winner = team) AS wins, max(date) AS last_date,
  {r4('1500.0::DOUBLE + 400.0::DOUBLE * ((count(*) FILTER (winner = team) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) - 0.5::DOUBLE)', 1)} AS rating FROM sides GROUP BY season, team),
season_board AS (SELECT *, {_POWER} AS power, games >= 20 AS eligible, row_number() OVER (PARTITION BY season ORDER BY games >= 20 DESC, rating DESC, team) AS rank FROM season_rates)"""
PARTS["tiered"] = """
own_tiers AS (SELECT *, CASE WHEN power >= 2250 OR leader - power <= 50 THEN 0 WHEN leader - power <= 225 THEN 1 WHEN leader - power <= 400 THEN 2 ELSE 3 END AS own FROM (SELECT *, max(power) OVER (PARTITION BY season) AS leader FROM season_board)),
tier_walk AS (SELECT season, team, rank, power, own AS no FROM own_tiers WHERE rank = 1
  UNION ALL SELECT b.season, b.team, b.rank, b.power, CASE WHEN b.own > w.no AND greatest(w.power - b.power, 0) < 35 THEN w.no ELSE b.own END FROM tier_walk w JOIN own_tiers b ON b.season = w.season AND b.rank = w.rank + 1),
tiered AS (SELECT season, team, rank, power, ['S', 'A', 'B', 'C'][no + 1] AS tier FROM tier_walk)"""


def board(spark, sf_dir):
    return B.season_board(contest_games(spark, sf_dir))


def tiered(spark, sf_dir):
    return B.tiers(board(spark, sf_dir), ["season"])


@query("g18_board_tiers", "SELECT season, team, rank, power, tier FROM tiered", "sides season_board tiered")
def g18_board_tiers(spark, sf_dir):
    return tiered(spark, sf_dir).select("season", "team", "rank", "power", "tier")


@query("g19_tier_bands", "SELECT season, tier, min(power) AS floor, max(power) AS ceiling, count(*) AS teams, greatest(max(max(power)) OVER (PARTITION BY season) - min(power), 0) AS drop_from_leader FROM tiered GROUP BY season, tier", "sides season_board tiered")
def g19_tier_bands(spark, sf_dir):
    return B.tier_bands(tiered(spark, sf_dir), ["season"])


@query("g17_tier_pages", "SELECT season, tier, (min(rank) - 1) // 5 + 1 AS page FROM tiered GROUP BY ALL", "sides season_board tiered")
def g17_tier_pages(spark, sf_dir):
    return B.tier_pages(tiered(spark, sf_dir), ["season"], 5)


@query(
    "h1_board_sorts",
    " UNION ALL ".join(f"SELECT season, team, '{s}' AS sort, {str(d).lower()} AS descending, row_number() OVER (PARTITION BY season ORDER BY eligible DESC, {B.SORTS[s][0]} {'DESC' if d else 'ASC'}, rank, team) AS position FROM season_board" for s in B.SORTS for d in (False, True)),
    "sides season_board",
)
def h1_board_sorts(spark, sf_dir):
    rows = board(spark, sf_dir)
    each = [B.sort_board(rows, ["season"], s, d).select("season", "team", F.lit(s).alias("sort"), F.lit(d).alias("descending"), "position") for s in B.SORTS for d in (False, True)]
    return reduce(DataFrame.union, each)


@query("h2_board_pages", " UNION ALL ".join(f"SELECT season, team, CAST({n} AS INTEGER) AS size, (rank - 1) // {n} + 1 AS page FROM season_board" for n in B.SIZES), "sides season_board")
def h2_board_pages(spark, sf_dir):
    rows = board(spark, sf_dir)
    return reduce(DataFrame.union, [B.paged(rows, n).select("season", "team", F.lit(n).alias("size"), "page") for n in B.SIZES])


@query("h4_podium", "SELECT season, rank AS place, team, tier FROM tiered WHERE rank <= 3", "sides season_board tiered")
def h4_podium(spark, sf_dir):
    return B.podium(tiered(spark, sf_dir), ["season"]).select("season", "place", "team", "tier")


PARTS["moved"] = f"moved AS (SELECT a.*, b.rank AS previous_rank, b.rank - a.rank AS moved, {r4('a.rating - b.rating', 1)} AS rating_delta FROM season_board a LEFT JOIN season_board b ON b.team = a.team AND b.season + 1 = a.season)"


@query("h5_movers", ", k AS (SELECT *, CASE WHEN rating_delta > 0 THEN 'riser' WHEN rating_delta < 0 THEN 'faller' END AS kind FROM moved) SELECT season, kind, team, rank, previous_rank, moved, rating_delta FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season, kind ORDER BY abs(rating_delta) DESC, abs(coalesce(moved, 0)) DESC, rank, team) = 1", "sides season_board moved")
def h5_movers(spark, sf_dir):
    return B.movers(B.with_movement(board(spark, sf_dir)), ["season"])


PARTS["chances"] = "chances AS (SELECT season, series_id, date, winner AS team, CASE WHEN winner = team_a THEN team_b ELSE team_a END AS opponent, CASE WHEN winner = team_a THEN p ELSE 1.0::DOUBLE - p END AS p FROM predictions)"


def chances(spark, sf_dir):
    """A row for each game won, with the winner's chance before it."""
    first = F.col("winner") == F.col("team_a")
    return predictions(spark, sf_dir).select("season", "series_id", "date", F.col("winner").alias("team"), F.when(first, F.col("team_b")).otherwise(F.col("team_a")).alias("opponent"), F.when(first, F.col("p")).otherwise(1.0 - F.col("p")).alias("p"))


@query("h6_upset_headlines", f"SELECT season, team, opponent, date, p, {r4('(1.0::DOUBLE - p) * 100.0::DOUBLE', 1)} AS score, team || ' beat ' || opponent || ' with a ' || CAST(CAST(floor(p * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '% pre-match chance' AS headline FROM chances WHERE p < 0.5 QUALIFY row_number() OVER (PARTITION BY season ORDER BY p, date DESC, team, opponent, series_id) = 1", "sides records predictions chances")
def h6_upset_headlines(spark, sf_dir):
    return B.upset_headlines(chances(spark, sf_dir), ["season"]).select("season", "team", "opponent", "date", "p", "score", "headline")


@query(
    "h7_best_regions",
    f""", r AS (SELECT season, league, {r4('CAST(sum(power) AS DOUBLE) / count(*)', 2)} AS mean_power, {r4('CAST(sum(wins) AS DOUBLE) / CAST(sum(games) AS DOUBLE)')} AS win_rate FROM season_board GROUP BY ALL),
a AS (SELECT season, league AS strongest, mean_power FROM r QUALIFY row_number() OVER (PARTITION BY season ORDER BY mean_power DESC, league) = 1), b AS (SELECT season, league AS best_record, win_rate FROM r QUALIFY row_number() OVER (PARTITION BY season ORDER BY win_rate DESC, league) = 1)
SELECT a.season, strongest, mean_power, best_record, win_rate FROM a JOIN b ON a.season = b.season""",
    "sides season_board",
)
def h7_best_regions(spark, sf_dir):
    rows = board(spark, sf_dir).groupBy("season", "league").agg(half_up(F.sum("power").cast("double") / F.count("*"), 2).alias("mean_power"), half_up(F.sum("wins").cast("double") / F.sum("games").cast("double"), 4).alias("win_rate"))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("v"), "league"))
    out = rows.groupBy("season").agg(best("mean_power").alias("a"), best("win_rate").alias("b"))
    return out.select("season", F.col("a.league").alias("strongest"), (-F.col("a.v")).alias("mean_power"), F.col("b.league").alias("best_record"), (-F.col("b.v")).alias("win_rate"))


@query("h10_heat", ", e AS (SELECT *, min(rating) OVER (PARTITION BY season) AS low, max(rating) OVER (PARTITION BY season) AS high FROM season_board) SELECT season, team, CAST(CASE WHEN high <= low THEN 3 ELSE least(6, greatest(1, ceil((rating - low) / (high - low) * 6))) END AS BIGINT) AS heat, CAST(CASE WHEN high <= low THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(2.0::DOUBLE, floor((rating - low) / (high - low) * 100.0::DOUBLE + 0.5::DOUBLE))) END AS BIGINT) AS percent FROM e", "sides season_board")
def h10_heat(spark, sf_dir):
    return B.with_heat(board(spark, sf_dir), ["season"], "rating").select("season", "team", "heat", "percent")


_BASIS = "CASE league WHEN 'ASIA' THEN 'sourced' WHEN 'EUROPE' THEN 'assumed-continuous' ELSE 'unknown' END"
PARTS["sure"] = f"""
ended AS (SELECT max(last_date) AS e FROM season_board),
sure AS (SELECT season, team, games, eligible, 140.0::DOUBLE - least(games, 100) AS uncertainty, CAST(least(99.0::DOUBLE, floor((0.4::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, games / 20.0::DOUBLE)) + 0.25::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - (e - last_date) / 120.0::DOUBLE))
  + 0.25::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (140.0::DOUBLE - (140.0::DOUBLE - least(games, 100))) / 105.0::DOUBLE)) + 0.1::DOUBLE * CASE {_BASIS} WHEN 'sourced' THEN 1.0::DOUBLE WHEN 'assumed-continuous' THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END)
  * CASE WHEN eligible THEN 1.0::DOUBLE WHEN e - last_date > 90 THEN 0.55::DOUBLE ELSE 0.72::DOUBLE END * 100.0::DOUBLE + 0.5::DOUBLE)) AS BIGINT) AS confidence FROM season_board, ended)"""


def sure(spark, sf_dir):
    rows = board(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last_date").alias("e")))).withColumns({"idle": F.datediff("e", "last_date"), "uncertainty": 140.0 - F.least(F.col("games"), F.lit(100))})
    basis = F.when(F.col("league") == "ASIA", "sourced").when(F.col("league") == "EUROPE", "assumed-continuous").otherwise("unknown")
    return rows.withColumn("confidence", B.confidence(F.col("games"), F.col("idle"), F.col("uncertainty"), basis, F.col("eligible"), F.col("idle") > 90))


@query("j29_confidence", "SELECT season, team, confidence FROM sure", "sides season_board sure")
def j29_confidence(spark, sf_dir):
    return sure(spark, sf_dir).select("season", "team", "confidence")


@query("j35_spicy_takes", ", s AS (SELECT season, team, CAST(least(100.0::DOUBLE, greatest(0.0::DOUBLE, floor(confidence - uncertainty * 0.35::DOUBLE + least(games, 5) * 3 + CASE WHEN eligible THEN 10 ELSE -15 END + 0.5::DOUBLE))) AS BIGINT) AS score FROM sure) SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS band FROM s", "sides season_board sure")
def j35_spicy_takes(spark, sf_dir):
    score = B.spicy_score(F.col("confidence"), F.col("uncertainty"), F.col("games"), F.col("eligible"))
    return sure(spark, sf_dir).select("season", "team", score.alias("score")).withColumn("band", B.spicy_band(F.col("score")))


@query("j36_gap_labels", f"SELECT season, team, {r4('1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -((leader - power) / 3.25::DOUBLE) / 360.0::DOUBLE))')} AS leader_chance, CASE WHEN moved > 0 THEN 'Resume ahead' WHEN moved < 0 THEN 'Power ahead' ELSE 'Aligned' END AS label, coalesce(abs(moved) >= 5 OR abs(rating_delta) >= 100, false) AS large FROM (SELECT *, max(power) OVER (PARTITION BY season) AS leader FROM moved)", "sides season_board moved")
def j36_gap_labels(spark, sf_dir):
    rows = B.with_movement(board(spark, sf_dir))
    leader = rows.groupBy("season").agg(F.max("power").alias("leader"))
    gap = B.resume_gap(F.col("moved"), F.col("rating_delta"))
    return rows.join(leader, "season").select("season", "team", B.gap_probability(F.col("leader") - F.col("power")).alias("leader_chance"), gap.label.alias("label"), F.coalesce(gap.large, F.lit(False)).alias("large"))


@query("j37_outcome_labels", ", both_ AS (SELECT season, p, true AS won FROM chances UNION ALL SELECT season, 1.0::DOUBLE - p, false FROM chances), l AS (SELECT season, CASE WHEN won AND p < 0.4 THEN 'Upset' WHEN NOT won AND p > 0.6 THEN 'Miss' END AS label FROM both_) SELECT season, coalesce(label, 'none') AS label, count(*) AS sides FROM l GROUP BY ALL", "sides records predictions chances")
def j37_outcome_labels(spark, sf_dir):
    sides = F.explode(F.array(F.struct(F.col("p").alias("p"), F.lit(True).alias("won")), F.struct((1.0 - F.col("p")).alias("p"), F.lit(False).alias("won"))))
    rows = chances(spark, sf_dir).select("season", sides.alias("s")).select("season", "s.*")
    label = F.coalesce(B.outcome_label(F.col("won"), F.col("p")), F.lit("none"))
    return rows.groupBy("season", label.alias("label")).agg(F.count("*").alias("sides"))


@query("j38_signed_moves", "SELECT season, team, CASE WHEN rating_delta IS NULL OR rating_delta = 0 THEN '0' WHEN rating_delta > 0 THEN '+' || CAST(CAST(floor(rating_delta + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(rating_delta + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END AS delta FROM moved", "sides season_board moved")
def j38_signed_moves(spark, sf_dir):
    return B.with_movement(board(spark, sf_dir)).select("season", "team", B.signed(F.col("rating_delta")).alias("delta"))


@query("p18_flair", "SELECT b.season, b.team, b.power, t.tier, CASE WHEN t.rank <= 3 THEN t.rank END AS place, m.moved FROM season_board b JOIN tiered t ON b.season = t.season AND b.team = t.team JOIN moved m ON m.season = b.season AND m.team = b.team", "sides season_board tiered moved")
def p18_flair(spark, sf_dir):
    rows = B.tiers(B.with_movement(board(spark, sf_dir)), ["season"])
    return rows.select("season", "team", "power", "tier", F.when(F.col("rank") <= 3, F.col("rank")).alias("place"), "moved")


@query("p41_comparison", " UNION ALL ".join(f"SELECT season, team, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {m} = (SELECT max({m}) FROM season_board) AS best FROM season_board" for m in ("rating", "wins", "power")), "sides season_board")
def p41_comparison(spark, sf_dir):
    return D.unpivoted(board(spark, sf_dir), ["season", "team"], ["rating", "wins", "power"])


# Histories as they are published.

PARTS["matches"] = """
deltas AS (SELECT *, CASE WHEN won THEN 10 ELSE -10 END AS delta FROM points),
matches AS (SELECT team, series_id, min(seq) AS first_seq, max(date) AS date, arg_max(score, seq) AS score, CAST(sum(delta) AS BIGINT) AS delta, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, arg_max(opponent, seq) AS opponent, arg_max(game_number, seq) FILTER (delta <> 0) AS deciding_game FROM deltas GROUP BY team, series_id)"""


def matches(spark, sf_dir):
    return D.match_points(points(spark, sf_dir).withColumn("delta", F.when(F.col("won"), 10).otherwise(-10)))


@query("b9_match_points", "SELECT team, series_id, date, score, delta, wins, losses FROM matches QUALIFY count(*) OVER (PARTITION BY team) >= 2", "sides points matches")
def b9_match_points(spark, sf_dir):
    return D.plotted(matches(spark, sf_dir)).select("team", "series_id", "date", "score", "delta", "wins", "losses")


@query("b6_recent_matches", "SELECT team, series_id, row_number() OVER (PARTITION BY team ORDER BY first_seq DESC) AS back, opponent, score - lag(score) OVER (PARTITION BY team ORDER BY first_seq) AS change FROM matches QUALIFY row_number() OVER (PARTITION BY team ORDER BY first_seq DESC) <= 25", "sides points matches")
def b6_recent_matches(spark, sf_dir):
    return D.recent(matches(spark, sf_dir)).select("team", "series_id", "back", "opponent", "change")


@query("h8_recent_lists", "SELECT team, series_id, row_number() OVER (PARTITION BY team ORDER BY first_seq DESC) AS back FROM matches QUALIFY row_number() OVER (PARTITION BY team ORDER BY first_seq DESC) <= 5", "sides points matches")
def h8_recent_lists(spark, sf_dir):
    return D.recent(matches(spark, sf_dir), most=5).select("team", "series_id", "back")


@query("b10_current_rows", ", l AS (SELECT team, max(first_seq) + 1 AS seq, max(date) AS date, arg_max(score, first_seq) AS score FROM matches GROUP BY team) SELECT team, first_seq AS seq, date, score, false AS current FROM matches UNION ALL SELECT team, seq, (SELECT max(date) FROM matches), score, true FROM l", "sides points matches")
def b10_current_rows(spark, sf_dir):
    rows = matches(spark, sf_dir).withColumnRenamed("first_seq", "seq")
    standings = rows.groupBy("team").agg(F.max_by("score", "seq").alias("score"))
    return D.with_current(rows, standings, F.lit(rows.agg(F.max("date")).first()[0]))


@query("b11_deciding_games", "SELECT team, series_id, deciding_game FROM matches", "sides points matches")
def b11_deciding_games(spark, sf_dir):
    return matches(spark, sf_dir).select("team", "series_id", "deciding_game")


@query("b13_series_impact", "SELECT team, opponent, count(*) AS series, CAST(sum(delta) AS BIGINT) AS delta FROM matches GROUP BY ALL", "sides points matches")
def b13_series_impact(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("team", "opponent").agg(F.count("*").alias("series"), F.sum("delta").alias("delta"))


@query("d10_match_records", "SELECT team, series_id, CASE WHEN wins > losses THEN 'W' WHEN wins < losses THEN 'L' ELSE 'T' END AS result, wins <> losses AS resolved, CAST(CASE WHEN wins = 1 AND losses = 1 THEN 2 WHEN greatest(wins, losses) <= 1 THEN 1 WHEN greatest(wins, losses) = 2 THEN 3 ELSE 5 END AS BIGINT) AS best_of FROM matches", "sides points matches")
def d10_match_records(spark, sf_dir):
    return matches(spark, sf_dir).select("team", "series_id", "result", "resolved", "best_of")


@query("d9_first_seen", ", g AS (SELECT season, tier, min(series_id) AS first, count(*) AS rows FROM games GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY first, season, tier) AS group_no FROM g")
def d9_first_seen(spark, sf_dir):
    return D.first_seen(contest_games(spark, sf_dir), ["season", "tier"], "series_id")


@query("d11_provenance", ", o AS (SELECT team_a, team_b, series_id * 10 + game_number AS ord, patch, tier FROM games), f AS (SELECT team_a, team_b, tier, min(ord) AS ord FROM o GROUP BY ALL) SELECT o.team_a, o.team_b, arg_max(patch, o.ord) AS source, any_value(i.items) AS items FROM o JOIN (SELECT team_a, team_b, string_agg(tier, ',' ORDER BY ord) AS items FROM f GROUP BY ALL) i ON o.team_a = i.team_a AND o.team_b = i.team_b GROUP BY o.team_a, o.team_b")
def d11_provenance(spark, sf_dir):
    rows = contest_games(spark, sf_dir).withColumn("at", F.col("series_id") * 10 + F.col("game_number"))
    out = D.provenance(rows, ["team_a", "team_b"], "at", "patch", "tier")
    return out.select("team_a", "team_b", "source", F.array_join("items", ",").alias("items"))


@query("d6_game_order", "SELECT series_id, game_number, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN tier <> 'qualifier' THEN game_number % 2 END NULLS LAST, game_number) AS game_no FROM games")
def d6_game_order(spark, sf_dir):
    ids = F.concat(F.lit("game-"), F.col("series_id").cast("string"), F.lit("-"), F.col("game_number").cast("string"), F.lit("x"))
    rows = contest_games(spark, sf_dir).withColumns({"id": ids, "at": F.when(F.col("tier") != "qualifier", F.col("game_number") % 2)})
    return D.game_order(rows, "id").select("series_id", "game_number", "game_no")


@query("c10_scope_teams", "SELECT season, tier, team, count(*) AS games FROM sides GROUP BY ALL", "sides")
def c10_scope_teams(spark, sf_dir):
    return S.sides(contest_games(spark, sf_dir)).groupBy("season", "tier", "team").agg(F.count("*").alias("games"))


@query(
    "c11_scoped_standings",
    """, p AS (SELECT tier AS scope, team, seq, won, date FROM points), f AS (SELECT scope, team, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY seq) AS form FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY scope, team ORDER BY seq DESC) <= 5) GROUP BY ALL),
s AS (SELECT scope, team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, max(date) AS last_date FROM p GROUP BY ALL)
SELECT s.*, f.form, r.rating, row_number() OVER (PARTITION BY s.scope ORDER BY r.rating DESC, s.team) AS rank FROM s JOIN f ON s.scope = f.scope AND s.team = f.team JOIN records r ON s.team = r.team""",
    "sides records points",
)
def c11_scoped_standings(spark, sf_dir):
    rows = points(spark, sf_dir)
    keys = S.resolve_series(contest_games(spark, sf_dir)).select(F.col("tier").alias("scope"), "series_id")
    return D.scoped_standings(rows, keys, records(spark, sf_dir).select("team", "rating")).select("scope", "team", "wins", "losses", "last_date", "form", "rating", "rank")


@query("c12_league_history", "SELECT league, date, series_id, team, tier FROM series_sides WHERE tier IN ('worlds-playoffs', 'msi-bracket') AND league <> opponent_league", "series series_sides")
def c12_league_history(spark, sf_dir):
    history = S.sides(S.resolve_series(contest_games(spark, sf_dir)))
    key = ["league", "opponent_league", "date", "series_id", "team", "opponent", "tier"]
    scope = history.where(F.col("tier").isin("worlds-playoffs", "msi-bracket") & (F.col("league") != F.col("opponent_league"))).select(*key)
    return history.join(scope, key, "left_semi").select("league", "date", "series_id", "team", "tier")


@query("c19_player_fallback", ", s AS (SELECT team_a AS team, player, count(*) AS games FROM games WHERE tier = 'worlds-playoffs' AND best_of = 5 AND game_number >= 4 GROUP BY ALL), e AS (SELECT team_a AS team, player, count(*) AS games FROM games GROUP BY ALL) SELECT *, 'scoped' AS scope FROM s UNION ALL SELECT *, 'all' FROM e WHERE team NOT IN (SELECT team FROM s)")
def c19_player_fallback(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    count = lambda rows: rows.groupBy(F.col("team_a").alias("team"), "player").agg(F.count("*").alias("games"))
    return D.with_fallback(count(games.where("tier = 'worlds-playoffs' and best_of = 5 and game_number >= 4")), count(games))


@query(
    "g21_movement_shards",
    """, m AS (SELECT p.tier AS instance, p.team, p.date, min(p.seq) AS seq, arg_max(p.score, p.seq) AS score, arg_min(p.score - CASE WHEN p.won THEN 10 ELSE -10 END, p.seq) AS before FROM points p GROUP BY p.tier, p.team, p.date, p.series_id),
s AS (SELECT instance, team, min(date) AS date, CAST(-1 AS BIGINT) AS seq, arg_min(before, seq) AS score FROM m GROUP BY ALL), u AS (SELECT instance, team, date, seq, score, 'match' AS kind FROM m UNION ALL SELECT *, 'start' FROM s)
SELECT *, row_number() OVER (PARTITION BY instance, team, date ORDER BY seq) - 1 AS minute FROM u""",
    "sides points",
)
def g21_movement_shards(spark, sf_dir):
    rows = points(spark, sf_dir).withColumn("before", F.col("score") - F.when(F.col("won"), 10).otherwise(-10))
    each = rows.groupBy(F.col("tier").alias("instance"), "team", "date", "series_id").agg(F.min("seq").alias("seq"), F.max_by("score", "seq").alias("last"), F.min_by("before", "seq").alias("before"))
    each = each.withColumnRenamed("last", "score")
    return D.movement_shards(each, each.select("instance", "team"))


@query(
    "g9_component_changes",
    """, h AS (SELECT team, seq, CAST(score AS DOUBLE) AS stable, CAST(count(*) FILTER (won) OVER (PARTITION BY team ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS momentum FROM points),
c AS (SELECT team, seq, 'stable' AS component, stable - lag(stable) OVER w AS change FROM h WINDOW w AS (PARTITION BY team ORDER BY seq) UNION ALL SELECT team, seq, 'momentum', momentum - lag(momentum) OVER w FROM h WINDOW w AS (PARTITION BY team ORDER BY seq))
SELECT * FROM c WHERE abs(change) >= 0.05""",
    "sides points",
)
def g9_component_changes(spark, sf_dir):
    last = Window.partitionBy("team").orderBy("seq").rowsBetween(-4, 0)
    rows = points(spark, sf_dir).select("team", "seq", F.col("score").cast("double").alias("stable"), F.count_if("won").over(last).cast("double").alias("momentum"))
    return D.component_changes(rows, ["stable", "momentum"])


@query("b8_history_shards", "SELECT season, count(*) AS rows, count(DISTINCT team) AS teams FROM points GROUP BY season", "sides points")
def b8_history_shards(spark, sf_dir):
    path = new_path(spark, "history")
    P.publish(points(spark, sf_dir).select("team", "seq", "date", "score", "season"), path, ["season"])
    return spark.read.parquet(path).groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("rows"), F.countDistinct("team").alias("teams"))


_PART = lambda i: f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)"


@query("b18_semantic_digests", f""", h AS (SELECT season, sha256(CAST(json_object('date', date, 'series_id', series_id, 'winner', winner) AS VARCHAR)) AS h FROM series)
SELECT season, sha256({" || ':' || ".join(_PART(i) for i in range(4))}) AS digest, count(*) AS rows FROM h GROUP BY season""", "series")
def b18_semantic_digests(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("season", "series_id", "winner", F.col("date").cast("string").alias("date"), F.current_timestamp().alias("generated_at"))
    return P.semantic_digest(rows, ["season"])


@query("b19_semantic_diff", "SELECT season, tier, CASE WHEN count(*) FILTER (winner IS NULL) = count(*) THEN 'missing' ELSE 'differs' END AS what FROM series GROUP BY ALL HAVING count(*) FILTER (winner IS NULL) > 0", "series")
def b19_semantic_diff(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("season", "tier", "series_id", "winner")
    return P.semantic_diff(P.semantic_digest(rows, ["season", "tier"]), P.semantic_digest(rows.where("winner is not null"), ["season", "tier"]), ["season", "tier"])


@query("b5_scope_manifest", f", m AS (SELECT season, count(*) AS teams, sum(games) AS games, max(last_date) AS through, {r4('max(rating)', 1)} AS top FROM season_board GROUP BY season) SELECT season, 'scopes/' || season || '.json' AS path, teams, CAST(games AS BIGINT) AS games, through, top FROM m", "sides season_board")
def b5_scope_manifest(spark, sf_dir):
    rows = board(spark, sf_dir).groupBy("season").agg(F.count("*").alias("teams"), F.sum("games").alias("games"), F.max("last_date").alias("through"), half_up(F.max("rating"), 1).alias("top"))
    return rows.withColumn("path", F.concat(F.lit("scopes/"), F.col("season").cast("string"), F.lit(".json")))


@query("b14_player_directory", ", t AS (SELECT player, role, team_a AS team, count(*) AS n FROM games GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY player) AS games, count(*) OVER (PARTITION BY player) AS teams, row_number() OVER (PARTITION BY player ORDER BY n DESC, team) AS r FROM t) SELECT player, role, team, n AS team_games, CAST(games AS BIGINT) AS games, teams FROM s WHERE r = 1 AND games >= 20", "")
def b14_player_directory(spark, sf_dir):
    rows = contest_games(spark, sf_dir).groupBy("player", "role", F.col("team_a").alias("team")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("player")
    rows = rows.withColumns({"games": F.sum("n").over(own), "teams": F.count("*").over(own), "r": F.row_number().over(own.orderBy(F.col("n").desc(), "team"))})
    return rows.where("r = 1 and games >= 20").select("player", "role", "team", F.col("n").alias("team_games"), "games", "teams")


@query("b15_team_directory", ", d AS (SELECT team, league, upper(left(team, 3)) AS code, lower(regexp_replace(team, '[^A-Za-z0-9]', '', 'g')) AS key FROM records) SELECT team, league, code, key, array_to_string(list_sort(list_distinct([lower(code), key, lower(team)])), '|') AS aliases FROM d", "sides records")
def b15_team_directory(spark, sf_dir):
    rows = records(spark, sf_dir).select("team", "league", F.upper(F.substring("team", 1, 3)).alias("code"), N.name_key(F.col("team")).alias("key"))
    aliases = F.array_join(F.array_sort(F.array_distinct(F.array(F.lower("code"), "key", F.lower("team")))), "|")
    return rows.withColumn("aliases", aliases)


@query("b20_official_ids", ", k AS (SELECT date, least(team_a, team_b) AS first_team, greatest(team_a, team_b) AS second_team, count(DISTINCT series_id) AS ids, min(series_id) AS id FROM series GROUP BY ALL) SELECT date, first_team, second_team, CASE WHEN ids = 1 THEN id END AS official_id, CASE WHEN ids = 1 THEN 'exact' ELSE 'unresolved' END AS basis FROM k", "series")
def b20_official_ids(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).groupBy("date", F.least("team_a", "team_b").alias("first_team"), F.greatest("team_a", "team_b").alias("second_team")).agg(F.countDistinct("series_id").alias("ids"), F.min("series_id").alias("id"))
    one = F.col("ids") == 1
    return rows.select("date", "first_team", "second_team", F.when(one, F.col("id")).alias("official_id"), F.when(one, "exact").otherwise("unresolved").alias("basis"))


@query("b21_published_components", f"SELECT season, team, power AS league_anchor, {r4('(rating - 1500.0::DOUBLE) * 3.25::DOUBLE', 1)} AS stable_offset, {r4('1500.0::DOUBLE + (power - 1800.0::DOUBLE) / 3.25::DOUBLE', 4)} AS internal FROM season_board", "sides season_board")
def b21_published_components(spark, sf_dir):
    return board(spark, sf_dir).select("season", "team", F.col("power").alias("league_anchor"), half_up((F.col("rating") - 1500.0) * 3.25, 1).alias("stable_offset"), half_up(R.internal_rating(F.col("power").cast("double")), 4).alias("internal"))


@query("b23_team_receipts", ", e AS (SELECT max(last_date) AS e FROM season_board), d AS (SELECT season, team, season || '|' || team || '|' || rank || '|' || power || '|' || strftime(last_date, '%Y-%m-%d') AS document, e - last_date AS idle FROM season_board, e) SELECT season, team, left(sha256(document), 12) AS share_hash, idle AS stale_days, idle > 30 AS stale FROM d", "sides season_board")
def b23_team_receipts(spark, sf_dir):
    rows = board(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last_date").alias("e"))))
    document = F.concat_ws("|", F.col("season").cast("string"), "team", F.col("rank").cast("string"), F.col("power").cast("string"), F.date_format("last_date", "yyyy-MM-dd"))
    idle = F.datediff("e", "last_date").cast("long")
    return rows.select("season", "team", F.substring(F.sha2(document, 256), 1, 12).alias("share_hash"), idle.alias("stale_days"), (idle > 30).alias("stale"))


# Aggregates by region, player and variant.


@query("f5_region_scores", f"SELECT season, league, {r4('CAST(sum(power) AS DOUBLE) / count(*)', 1)} AS score FROM (SELECT * FROM season_board QUALIFY row_number() OVER (PARTITION BY season, league ORDER BY power DESC, team) <= 2) GROUP BY ALL", "sides season_board")
def f5_region_scores(spark, sf_dir):
    top = F.row_number().over(Window.partitionBy("season", "league").orderBy(F.col("power").desc(), "team"))
    return board(spark, sf_dir).withColumn("r", top).where("r <= 2").groupBy("season", "league").agg(half_up(F.sum("power").cast("double") / F.count("*"), 1).alias("score"))


@query("f7_region_context", "SELECT league, date, count(*) AS games, count(*) FILTER (winner = team) AS wins, count(DISTINCT team) AS teams, count(*) FILTER (league <> opponent_league) AS abroad FROM sides GROUP BY ALL", "sides")
def f7_region_context(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir))
    return rows.groupBy("league", "date").agg(F.count("*").alias("games"), F.count_if(S.won()).alias("wins"), F.countDistinct("team").alias("teams"), F.count_if(F.col("league") != F.col("opponent_league")).alias("abroad"))


@query(
    "f6_region_history_weighted",
    f""", d AS (SELECT league, date, count(*) AS n, CAST(sum(CASE WHEN winner = team THEN 1 ELSE -1 END) AS BIGINT) AS v FROM sides WHERE league <> opponent_league GROUP BY ALL),
c AS (SELECT league, date, CAST(sum(n) OVER w AS BIGINT) AS abroad, CAST(1500 + 10 * sum(v) OVER w AS BIGINT) AS score FROM d WINDOW w AS (PARTITION BY league ORDER BY date ROWS UNBOUNDED PRECEDING)),
spine AS (SELECT a.date, b.league FROM (SELECT DISTINCT date FROM c) a CROSS JOIN (SELECT DISTINCT league FROM c) b),
filled AS (SELECT s.date, s.league, last_value(abroad IGNORE NULLS) OVER w AS abroad, last_value(score IGNORE NULLS) OVER w AS score FROM spine s LEFT JOIN c ON s.date = c.date AND s.league = c.league WINDOW w AS (PARTITION BY s.league ORDER BY s.date)),
r AS (SELECT date, CASE WHEN league IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE 'WEST' END AS region, CAST(sum(abroad) AS BIGINT) AS weight, {r4('CAST(sum(abroad * score) AS DOUBLE) / CAST(sum(abroad) AS DOUBLE)', 1)} AS score FROM filled WHERE score IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, region) AS rank FROM r""",
    "sides",
)
def f6_region_history_weighted(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir)).where("league <> opponent_league")
    days = rows.groupBy("league", "date").agg(F.count("*").alias("n"), F.sum(F.when(S.won(), 1).otherwise(-1)).alias("v"))
    so_far = Window.partitionBy("league").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = days.select("league", "date", F.sum("n").over(so_far).alias("abroad"), (1500 + 10 * F.sum("v").over(so_far)).alias("score"))
    spine = known.select("date").distinct().crossJoin(F.broadcast(known.select("league").distinct()))
    filled = spine.join(known, ["league", "date"], "left").withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("abroad", "score")}).where("score is not null")
    region = F.when(F.col("league").isin("ASIA", "MIDDLE EAST"), "EAST").otherwise("WEST")
    out = filled.groupBy("date", region.alias("region")).agg(F.sum("abroad").alias("weight"), half_up(F.sum(F.col("abroad") * F.col("score")).cast("double") / F.sum("abroad").cast("double"), 1).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "region")).cast("long"))


@query(
    "f36_region_trend",
    """, leagues AS (SELECT team, min(league) AS league FROM points GROUP BY team), spine AS (SELECT d.date, l.team, l.league FROM (SELECT DISTINCT date FROM closes) d CROSS JOIN leagues l),
f AS (SELECT s.league, s.date, last_value(c.score IGNORE NULLS) OVER w AS score, last_value(c.date IGNORE NULLS) OVER w AS played FROM spine s LEFT JOIN closes c ON s.team = c.team AND s.date = c.date WINDOW w AS (PARTITION BY s.team ORDER BY s.date))
SELECT league, date, count(*) AS active, CAST(sum(score) AS BIGINT) AS total FROM f WHERE date - played <= 30 GROUP BY ALL HAVING count(*) >= 2""",
    "sides points closes",
)
def f36_region_trend(spark, sf_dir):
    return H.region_trend(points(spark, sf_dir))


@query(
    "p37_trend_events",
    """, leagues AS (SELECT team, min(league) AS league FROM points GROUP BY team), spine AS (SELECT d.date, l.team, l.league FROM (SELECT DISTINCT date FROM closes) d CROSS JOIN leagues l),
f AS (SELECT s.league, s.date, last_value(c.score IGNORE NULLS) OVER w AS score, last_value(c.date IGNORE NULLS) OVER w AS played FROM spine s LEFT JOIN closes c ON s.team = c.team AND s.date = c.date WINDOW w AS (PARTITION BY s.team ORDER BY s.date)),
t AS (SELECT league, date, floor(CAST(sum(score) AS DOUBLE) / count(*) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS trend FROM f WHERE date - played <= 30 GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT *, floor((trend - lag(trend) OVER (PARTITION BY league ORDER BY date)) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS change FROM t) SELECT * FROM c WHERE abs(change) >= 0.5""",
    "sides points closes",
)
def p37_trend_events(spark, sf_dir):
    rows = H.region_trend(points(spark, sf_dir)).select("league", "date", half_up(F.col("total").cast("double") / F.col("active"), 1).alias("trend"))
    change = half_up(F.col("trend") - F.lag("trend").over(Window.partitionBy("league").orderBy("date")), 1)
    return rows.withColumn("change", change).where(F.abs("change") >= 0.5)


@query(
    "f3_league_strength",
    f""", x AS (SELECT league, opponent_league, p, won, other FROM (SELECT g.league_a AS league, g.league_b AS opponent_league, g.p, g.y = 1 AS won, b.rating AS other FROM predictions g JOIN records b ON g.team_b = b.team UNION ALL SELECT g.league_b, g.league_a, 1.0::DOUBLE - g.p, g.y = 0, a.rating FROM predictions g JOIN records a ON g.team_a = a.team) WHERE league <> opponent_league),
s AS (SELECT league, count(*) AS games, count(*) FILTER (won) AS wins, {r4('CAST(sum(CAST(round(p, 4) AS DECIMAL(18,4))) AS DOUBLE)', 2)} AS expected, {r4('CAST(sum(CAST(other AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 1)} AS opponent_mean FROM x GROUP BY league)
SELECT *, {r4('wins - expected', 2)} AS over_expected, {r4('games / (games + 8.0::DOUBLE)')} AS connectivity FROM s""",
    "sides records predictions",
)
def f3_league_strength(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("team_a", "team_b", "league_a", "league_b", "p", "y", "rating_a", "rating_b").where("league_a <> league_b")
    side = lambda x, o, p, won: F.struct(F.col(f"league_{x}").alias("league"), p.alias("p"), won.alias("won"), F.col(f"rating_{o}").alias("other"))
    long = rows.select(F.explode(F.array(side("a", "b", F.col("p"), F.col("y") == 1), side("b", "a", 1.0 - F.col("p"), F.col("y") == 0))).alias("s")).select("s.*")
    out = long.groupBy("league").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), half_up(F.sum(F.round("p", 4).cast("decimal(18,4)")).cast("double"), 2).alias("expected"), half_up(F.sum(F.col("other").cast("decimal(18,1)")).cast("double") / F.count("*"), 1).alias("opponent_mean"))
    return out.withColumns({"over_expected": half_up(F.col("wins") - F.col("expected"), 2), "connectivity": half_up(F.col("games") / (F.col("games") + 8.0), 4)})


@query("f11_means_with_missing", f"SELECT role, {r4('CAST(sum(CAST(kills AS DECIMAL(18,2))) FILTER (side_a IS NOT NULL) AS DOUBLE) / count(side_a)', 3)} AS mean_kills, count(side_a) AS known, count(*) - count(side_a) AS missing FROM games GROUP BY role")
def f11_means_with_missing(spark, sf_dir):
    kills = F.when(F.col("side_a").isNotNull(), F.col("kills").cast("decimal(18,2)"))
    return contest_games(spark, sf_dir).groupBy("role").agg(half_up(F.sum(kills).cast("double") / F.count("side_a"), 3).alias("mean_kills"), F.count("side_a").alias("known"), (F.count("*") - F.count("side_a")).alias("missing"))


_RATES = """, days AS (SELECT team, date, count(*) AS n, count(*) FILTER (won) AS w FROM points GROUP BY ALL), rates AS (SELECT team, date, coalesce(sum(n) OVER e, 0) AS n, coalesce(sum(w) OVER e, 0) AS w FROM days WINDOW e AS (PARTITION BY team ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT g.p, g.y, g.league_a <> g.league_b AS abroad, (a.w + 1.0::DOUBLE) / (a.n + 2.0::DOUBLE) AS ra, (b.w + 1.0::DOUBLE) / (b.n + 2.0::DOUBLE) AS rb FROM predictions g JOIN rates a ON a.team = g.team_a AND a.date = g.date JOIN rates b ON b.team = g.team_b AND b.date = g.date)"""
_VARIANTS = ", variants AS (SELECT 'model' AS variant, abroad, p, y FROM v UNION ALL SELECT 'coin-flip', abroad, 0.5::DOUBLE, y FROM v UNION ALL SELECT 'win-rate', abroad, ra / (ra + rb), y FROM v UNION ALL SELECT 'shrunken', abroad, 0.5::DOUBLE + (p - 0.5::DOUBLE) * 0.5::DOUBLE, y FROM v)"


def variants(spark, sf_dir):
    rates = H.rates_before(points(spark, sf_dir)).withColumn("rate", (F.col("wins_before") + 1.0) / (F.col("games_before") + 2.0)).select("team", "date", "rate")
    rows = predictions(spark, sf_dir).join(rates.withColumnsRenamed({"team": "team_a", "rate": "ra"}), ["team_a", "date"]).join(rates.withColumnsRenamed({"team": "team_b", "rate": "rb"}), ["team_b", "date"])
    kind = lambda n, p: F.struct(F.lit(n).alias("variant"), p.alias("p"))
    each = F.array(kind("model", F.col("p")), kind("coin-flip", F.lit(0.5)), kind("win-rate", F.col("ra") / (F.col("ra") + F.col("rb"))), kind("shrunken", 0.5 + (F.col("p") - 0.5) * 0.5))
    return rows.select((F.col("league_a") != F.col("league_b")).alias("abroad"), "y", F.explode(each).alias("v")).select("abroad", "y", "v.*")


@query("f18_baselines_all", f"{_RATES}{_VARIANTS} SELECT variant, abroad, {METRICS} FROM variants GROUP BY variant, abroad", "sides records points predictions")
def f18_baselines_all(spark, sf_dir):
    return M.forecast_metrics(variants(spark, sf_dir), "variant", "abroad")


@query("f19_shadow_deltas", f"{_RATES}{_VARIANTS}, m AS (SELECT variant, {mean('(p - y) * (p - y)')} AS brier FROM variants GROUP BY variant) SELECT variant, {r4('(SELECT brier FROM m WHERE variant = ' + chr(39) + 'model' + chr(39) + ') - brier')} AS brier_gain FROM m WHERE variant <> 'model'", "sides records points predictions")
def f19_shadow_deltas(spark, sf_dir):
    scores = M.forecast_metrics(variants(spark, sf_dir), "variant").select("variant", "brier")
    base = scores.where("variant = 'model'").select(F.col("brier").alias("base"))
    return scores.where("variant <> 'model'").crossJoin(F.broadcast(base)).select("variant", half_up(F.col("base") - F.col("brier"), 4).alias("brier_gain"))


@query("p4_credited_teams", ", n AS (SELECT player, season, team_a AS team, count(*) AS c, max(series_id * 10 + game_number) AS ord FROM games GROUP BY ALL) SELECT player, CAST(season AS VARCHAR) AS scope, team FROM n QUALIFY row_number() OVER (PARTITION BY player, season ORDER BY c DESC, team) = 1 UNION ALL SELECT player, 'All', arg_max(team, ord) FROM n GROUP BY player")
def p4_credited_teams(spark, sf_dir):
    rows = contest_games(spark, sf_dir).groupBy("player", "season", F.col("team_a").alias("team")).agg(F.count("*").alias("c"), F.max(F.col("series_id") * 10 + F.col("game_number")).alias("at"))
    main = rows.groupBy("player", "season").agg(F.min(F.struct((-F.col("c")).alias("c"), "team")).alias("m")).select("player", F.col("season").cast("string").alias("scope"), "m.team")
    return main.union(rows.groupBy("player").agg(F.max_by("team", "at").alias("team")).select("player", F.lit("All"), "team"))


@query("f27_top_clusters", ", n AS (SELECT season, player, team_a AS team, count(*) FILTER (winner = team_a) AS wins FROM games GROUP BY ALL), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY season ORDER BY wins DESC, player, team) <= 5) SELECT season, team, count(*) AS players FROM t GROUP BY ALL HAVING count(*) > 1")
def f27_top_clusters(spark, sf_dir):
    rows = contest_games(spark, sf_dir).groupBy("season", "player", F.col("team_a").alias("team")).agg(F.count_if(F.col("winner") == F.col("team_a")).alias("wins"))
    top = F.row_number().over(Window.partitionBy("season").orderBy(F.col("wins").desc(), "player", "team"))
    return rows.withColumn("r", top).where("r <= 5").groupBy("season", "team").agg(F.count("*").alias("players")).where("players > 1")


@query("e21_team_players", ", n AS (SELECT team_a AS team, role, player, count(*) AS games, count(*) FILTER (winner = team_a) AS wins FROM games GROUP BY ALL) SELECT team, role, player, row_number() OVER (PARTITION BY team ORDER BY role, wins DESC, games DESC, player) AS place FROM n")
def e21_team_players(spark, sf_dir):
    rows = contest_games(spark, sf_dir).groupBy(F.col("team_a").alias("team"), "role", "player").agg(F.count("*").alias("games"), F.count_if(F.col("winner") == F.col("team_a")).alias("wins"))
    order = Window.partitionBy("team").orderBy("role", F.col("wins").desc(), F.col("games").desc(), "player")
    return rows.select("team", "role", "player", F.row_number().over(order).cast("long").alias("place"))


@query(
    "g2_ranks_after_games",
    """, g AS (SELECT DISTINCT date, series_id, game_number FROM points), spine AS (SELECT g.*, t.team FROM g CROSS JOIN (SELECT DISTINCT team FROM points) t),
f AS (SELECT s.*, p.score IS NOT NULL AS plays, last_value(p.score IGNORE NULLS) OVER (PARTITION BY s.team ORDER BY s.date, s.series_id, s.game_number) AS score FROM spine s LEFT JOIN points p ON p.team = s.team AND p.series_id = s.series_id AND p.game_number = s.game_number),
r AS (SELECT *, row_number() OVER (PARTITION BY date, series_id, game_number ORDER BY score DESC, team) AS rank FROM f WHERE score IS NOT NULL) SELECT date, series_id, game_number, team, score, rank FROM r WHERE plays""",
    "sides points",
)
def g2_ranks_after_games(spark, sf_dir):
    return H.ranks_after_games(points(spark, sf_dir))


@query("k11_checkpoint_digests", "SELECT season, count(*) AS rows, sha256(string_agg(team || '|' || games || '|' || wins || '|' || power, chr(10) ORDER BY team)) AS digest FROM season_board GROUP BY season", "sides season_board")
def k11_checkpoint_digests(spark, sf_dir):
    """Digests of every season's state, each season read back by its digest first."""
    from ..operators import incremental as I
    from ..operators.storage import write_back

    path = new_path(spark, "checkpoints")
    state = write_back(board(spark, sf_dir).select("season", "team", "games", "wins", "power"), path)
    digests = I.checkpoint_digests(state, "season", "team", ["games", "wins", "power"])
    for r in digests.collect():  # a row a season
        I.read_checkpoint(state, "season", r["season"], "team", ["games", "wins", "power"], r["digest"])
    return digests


@query("p36_chart_points", "SELECT team, seq, epoch_ms(date) AS millis, CASE WHEN won THEN 'Won against ' ELSE 'Lost to ' END || opponent AS influence FROM points", "sides points")
def p36_chart_points(spark, sf_dir):
    text = F.concat(F.when(F.col("won"), "Won against ").otherwise("Lost to "), "opponent")
    return points(spark, sf_dir).select("team", "seq", F.unix_millis(F.col("date").cast("timestamp")).alias("millis"), text.alias("influence"))


@query("p40_recent_results", "SELECT team, string_agg(CASE WHEN wins > losses THEN 'W' WHEN wins < losses THEN 'L' ELSE 'T' END, '' ORDER BY first_seq) AS results FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY team ORDER BY first_seq DESC) <= 10) GROUP BY team", "sides points matches")
def p40_recent_results(spark, sf_dir):
    last = D.recent(matches(spark, sf_dir), most=10)
    return last.groupBy("team").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "result"))), lambda x: x.result), "").alias("results"))


@query("d3_two_team_groups", ", g AS (SELECT date, tier, count(DISTINCT t) AS teams, count(DISTINCT series_id) AS series FROM (SELECT date, tier, series_id, unnest([team_a, team_b]) AS t FROM games) GROUP BY ALL) SELECT date, tier, teams, series, CASE WHEN teams = 2 THEN 'accepted' ELSE 'rejected' END AS verdict FROM g")
def d3_two_team_groups(spark, sf_dir):
    rows = contest_games(spark, sf_dir).select("date", "tier", "series_id", F.explode(F.array("team_a", "team_b")).alias("t"))
    out = rows.groupBy("date", "tier").agg(F.countDistinct("t").alias("teams"), F.countDistinct("series_id").alias("series"))
    return out.withColumn("verdict", F.when(F.col("teams") == 2, "accepted").otherwise("rejected"))


@query("d4_format_basis", """, o AS (SELECT date, least(team_a, team_b) AS x, greatest(team_a, team_b) AS y, count(*) AS n FROM series GROUP BY ALL), d AS (SELECT series_id, max(best_of) AS declared FROM games GROUP BY series_id)
SELECT s.series_id, CASE WHEN o.n = 1 THEN 'official' WHEN s.best_of = d.declared THEN 'provider' ELSE 'score' END AS basis, s.best_of FROM series s JOIN o ON s.date = o.date AND o.x = least(s.team_a, s.team_b) AND o.y = greatest(s.team_a, s.team_b) JOIN d ON d.series_id = s.series_id""", "series")
def d4_format_basis(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    rows = S.resolve_series(games)
    pair = Window.partitionBy("date", F.least("team_a", "team_b"), F.greatest("team_a", "team_b"))
    declared = games.groupBy("series_id").agg(F.max("best_of").alias("declared"))
    rows = rows.withColumn("n", F.count("*").over(pair)).join(declared, "series_id")
    return rows.select("series_id", F.when(F.col("n") == 1, "official").when(F.col("best_of") == F.col("declared"), "provider").otherwise("score").alias("basis"), "best_of")
