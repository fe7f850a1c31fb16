"""Players, rosters, publication and the tables between."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import eras
from ..operators import players as P
from ..operators import publish as B
from ..operators import reconcile as X
from ..operators import series as S
from ..operators import site
from ..operators.storage import new_path, write_back
from ..sources.contest import ROLES, contest_games, table
from .analysis_queries import r4
from .registry import PARTS, query

PARTS["performances"] = f"""
role_means AS (SELECT role, {r4('CAST(sum(CAST(kills AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS mean_kills, {r4('CAST(sum(CAST(gold AS DECIMAL(18,2))) AS DOUBLE) / count(*)')} AS mean_gold FROM games GROUP BY role),
performances AS (SELECT g.*, {r4('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * (kills / mean_kills - 1.0::DOUBLE) + 0.25::DOUBLE * (gold / mean_gold - 1.0::DOUBLE)))')} AS score FROM games g JOIN role_means m ON g.role = m.role)"""
_MEAN = r4("CAST(sum(CAST(score AS DECIMAL(18,4))) AS DOUBLE) / count(*)")


@query("j26_performance", "SELECT series_id, game_number, player, score FROM performances", "performances")
def j26_performance(spark, sf_dir):
    return P.performance(contest_games(spark, sf_dir)).select("series_id", "game_number", "player", "score")


@query("f12_player_diagnostics", f"SELECT player, role, count(*) AS games, count(*) FILTER (winner = team_a) AS wins, {_MEAN} AS score, max(score) AS best, min(score) AS worst FROM performances GROUP BY player, role", "performances")
def f12_player_diagnostics(spark, sf_dir):
    return P.diagnostics(contest_games(spark, sf_dir))


@query("f26_role_power", f", d AS (SELECT player, role, count(*) AS games, {_MEAN} AS score FROM performances GROUP BY player, role HAVING count(*) >= 20) SELECT player, role, games, score, row_number() OVER (PARTITION BY role ORDER BY score DESC, player) AS rank FROM d", "performances")
def f26_role_power(spark, sf_dir):
    return P.role_power(contest_games(spark, sf_dir)).select("player", "role", "games", "score", "rank")


@query("m9_contribution_shares", f", raw AS (SELECT team_a AS team, player, sum(CAST(score AS DECIMAL(18,4))) AS raw FROM performances GROUP BY ALL) SELECT team, player, {r4('CAST(raw AS DOUBLE) / CAST(sum(raw) OVER (PARTITION BY team) AS DOUBLE)')} AS share FROM raw", "performances")
def m9_contribution_shares(spark, sf_dir):
    return P.contribution_shares(contest_games(spark, sf_dir))


@query(
    "m16_resume_credit",
    """, c AS (SELECT player, season, CAST(sum(CASE WHEN winner = team_a THEN 1 ELSE -1 END) AS BIGINT) AS season_credit, CAST(coalesce(sum(CASE WHEN winner = team_a THEN 1 ELSE -1 END) FILTER (tier IN ('worlds-playoffs', 'msi-bracket')), 0) AS BIGINT) AS international_credit FROM games GROUP BY ALL)
SELECT *, CAST(sum(season_credit) OVER (PARTITION BY player ORDER BY season) AS BIGINT) AS career_credit FROM c""",
)
def m16_resume_credit(spark, sf_dir):
    return P.resume_credit(contest_games(spark, sf_dir))


@query(
    "e12_roster_continuity",
    f""", r AS (SELECT team_a AS team, date, list_sort(list_distinct(list(player))) AS players FROM games GROUP BY ALL), b AS (SELECT *, lag(players) OVER (PARTITION BY team ORDER BY date) AS before FROM r)
SELECT team, date, len(players) AS players, CASE WHEN before IS NOT NULL THEN {r4('len(list_intersect(players, before)) / len(players)')} END AS continuity FROM b""",
)
def e12_roster_continuity(spark, sf_dir):
    return P.roster_continuity(contest_games(spark, sf_dir))


@query(
    "e11_latest_roster",
    """, sided AS (SELECT team, date, series_id, game_number, role, player FROM sides), newest AS (SELECT team, arg_max(series_id, struct_pack(d := date, s := series_id)) AS series_id FROM sided GROUP BY team),
held AS (SELECT s.team, s.series_id, s.date, s.role, arg_max(s.player, s.game_number) AS player FROM sided s JOIN newest n ON n.team = s.team AND n.series_id = s.series_id GROUP BY ALL)
SELECT team, series_id, min(date) AS date, string_agg(['top', 'jungle', 'mid', 'bot', 'support'][role + 1] || ':' || player, ',' ORDER BY role) AS roster FROM held GROUP BY ALL""",
    "sides",
)
def e11_latest_roster(spark, sf_dir):
    """Each team's players by role in its last series, of a role the last to play."""
    rows = S.sides(contest_games(spark, sf_dir))
    newest = rows.groupBy("team").agg(F.max_by("series_id", F.struct("date", "series_id")).alias("series_id"))
    held = rows.join(newest, ["team", "series_id"], "left_semi").groupBy("team", "series_id", "date", "role").agg(F.max_by("player", "game_number").alias("player"))
    names = F.array(*[F.lit(r) for r in ROLES])
    listed = F.array_sort(F.collect_list(F.struct("role", "player")))  # five roles at most
    return held.groupBy("team", "series_id").agg(F.min("date").alias("date"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", names[x.role.cast("int")], x.player.cast("string"))), ",").alias("roster"))


@query("e15_semi_anti", "SELECT team, count(*) AS games FROM sides WHERE opponent IN (SELECT team FROM sides GROUP BY team HAVING count(*) FILTER (winner = team) * 2 > count(*)) GROUP BY team", "sides")
def e15_semi_anti(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir))
    strong = rows.groupBy("team").agg(F.count_if(S.won()).alias("w"), F.count("*").alias("n")).where("w * 2 > n").select(F.col("team").alias("opponent"))
    return rows.join(strong, "opponent", "left_semi").groupBy("team").agg(F.count("*").alias("games"))


@query(
    "e16_tournament_games",
    """, spans AS (SELECT season, tier, min(date) AS starts, min(date) + 60 AS ends FROM games GROUP BY ALL)
SELECT s.season, s.tier, count(*) AS games, count(DISTINCT g.team_a) AS teams FROM spans s JOIN games g ON g.tier = s.tier AND g.date BETWEEN s.starts AND s.ends GROUP BY ALL""",
)
def e16_tournament_games(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    spans = games.groupBy("season", "tier").agg(F.min("date").alias("starts")).select(F.col("season").alias("of"), "tier", "starts", F.date_add("starts", 60).alias("ends"))
    return eras.overlap_join(games.select("tier", "date", "team_a"), spans, ("date", "date"), ("starts", "ends"), ("tier",)).groupBy(F.col("of").alias("season"), "tier").agg(F.count("*").alias("games"), F.countDistinct("team_a").alias("teams"))


_E20 = """, names AS (SELECT lower(n_name) AS name, n_nationkey, n_name FROM nation UNION SELECT CAST(n_nationkey AS VARCHAR), n_nationkey, n_name FROM nation),
asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN lower(n_name) WHEN 2 THEN upper(n_name) ELSE substr(n_name, 1, 2) || lower(substr(n_name, 3)) END AS spelled FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a.c_custkey, a.spelled, arg_max(n_name, n_nationkey) AS nation FROM asked a JOIN names ON lower(a.spelled) = name GROUP BY ALL"""


@query("e20_dimension_lookup", _E20)
@query("e20_dimension_lookup_all", _E20)
def e20_dimension_lookup_all(spark, sf_dir):
    """Customers' nations found by name, in any case, or by code."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    name, turn = F.col("nation"), F.col("c_custkey") % 4
    mixed = F.concat(F.substring(name, 1, 2), F.lower(F.substring(name, 3, 100)))
    spelled = F.when(turn == 0, F.col("n_nationkey").cast("string")).when(turn == 1, F.lower(name)).when(turn == 2, F.upper(name)).otherwise(mixed)
    asked = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spelled.alias("spelled"))
    return X.dimension_lookup(asked, "spelled", nation, ["nation", "n_nationkey"], ["n_nationkey"]).select("c_custkey", "spelled", "nation")


@query("f28_international_counts", "SELECT league, count(*) FILTER (tier IN ('worlds-playoffs', 'msi-bracket') AND league <> opponent_league) AS international, count(*) AS games FROM sides GROUP BY league", "sides")
def f28_international_counts(spark, sf_dir):
    abroad = F.col("tier").isin("worlds-playoffs", "msi-bracket") & (F.col("league") != F.col("opponent_league"))
    return S.sides(contest_games(spark, sf_dir)).groupBy("league").agg(F.count_if(abroad).alias("international"), F.count("*").alias("games"))


@query("f32_stage_points", ", best AS (SELECT season, league, team, max(CASE tier WHEN 'worlds-playoffs' THEN 5 WHEN 'msi-bracket' THEN 3 ELSE 0 END) AS p FROM sides WHERE winner = team GROUP BY ALL) SELECT season, league, CAST(sum(p) AS BIGINT) AS points, count(*) AS teams FROM best GROUP BY ALL", "sides")
def f32_stage_points(spark, sf_dir):
    points = F.when(F.col("tier") == "worlds-playoffs", 5).when(F.col("tier") == "msi-bracket", 3).otherwise(0)
    best = S.sides(contest_games(spark, sf_dir)).where(S.won()).groupBy("season", "league", "team").agg(F.max(points).alias("p"))
    return best.groupBy("season", "league").agg(F.sum("p").alias("points"), F.count("*").alias("teams"))


@query("f35_tier_weights", "SELECT best_of, tier, games FROM (SELECT best_of, tier, count(*) AS games FROM games GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY best_of ORDER BY games DESC, tier) = 1")
def f35_tier_weights(spark, sf_dir):
    counts = contest_games(spark, sf_dir).groupBy("best_of", "tier").agg(F.count("*").alias("games"))
    return X.first_of(counts, ["best_of"], [F.col("games").desc(), "tier"])


@query("b4_scope_bytes", "SELECT season, count(*) AS rows, CAST(sum(length(team_a) + length(team_b) + length(winner)) AS BIGINT) AS bytes FROM games GROUP BY season")
def b4_scope_bytes(spark, sf_dir):
    size = F.octet_length("team_a") + F.octet_length("team_b") + F.octet_length("winner")
    return contest_games(spark, sf_dir).groupBy("season").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


@query("b7_appearances", "SELECT team, tier, count(DISTINCT season) AS seasons, max(date) AS latest, arg_max(series_id, struct_pack(d := date, s := series_id)) AS latest_series FROM sides GROUP BY ALL", "sides")
def b7_appearances(spark, sf_dir):
    return S.sides(contest_games(spark, sf_dir)).groupBy("team", "tier").agg(F.countDistinct("season").alias("seasons"), F.max("date").alias("latest"), F.max_by("series_id", F.struct("date", "series_id")).alias("latest_series"))


@query("b12_match_pages", "SELECT season, page, count(*) AS series, min(date) AS first_date, max(date) AS last_date FROM (SELECT season, date, (row_number() OVER (PARTITION BY season ORDER BY date, series_id) - 1) // 25 + 1 AS page FROM series) GROUP BY ALL", "series")
def b12_match_pages(spark, sf_dir):
    paged = B.pages(S.resolve_series(contest_games(spark, sf_dir)), ["season"], ["date", "series_id"])
    return paged.groupBy("season", "page").agg(F.count("*").alias("series"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("k8_game_ledger", "SELECT series_id, game_number, sha256(concat_ws('|', strftime(date, '%Y-%m-%d'), tier, winner)) AS digest FROM games")
def k8_game_ledger(spark, sf_dir):
    return X.ledger(contest_games(spark, sf_dir).select("series_id", "game_number", "date", "tier", "winner"), ["series_id", "game_number"])


#: Games of a later import that differ from those of the first: some have another winner, and some are gone.
_IMPORTS = """, changed AS (SELECT * FROM games WHERE series_id % 1000 = 7 OR series_id % 1500 = 39)"""


def changed_games(spark, sf_dir):
    """(games, those that two imports' ledgers differ in)."""
    games = contest_games(spark, sf_dir)
    key = ["series_id", "game_number"]
    other = F.when(F.col("winner") == F.col("team_a"), F.col("team_b")).otherwise(F.col("team_a"))
    later = games.where("series_id % 1500 <> 39").withColumn("winner", F.when(F.col("series_id") % 1000 == 7, other).otherwise(F.col("winner")))
    ledger = lambda df: X.ledger(df.select(*key, "date", "tier", "winner"), key)
    return games, games.join(X.ledger_diff(ledger(games), ledger(later), key).select(*key), key, "left_semi")


@query("k10_predecessor", _IMPORTS + " SELECT (SELECT min(date) FROM changed) AS changed, (SELECT max(date) FROM games WHERE date < (SELECT min(date) FROM changed)) AS boundary")
def k10_predecessor(spark, sf_dir):
    """The first date that two imports differ on, and the last date before it."""
    games, changed = changed_games(spark, sf_dir)
    first = changed.agg(F.min("date").alias("changed"))
    return games.select("date").join(F.broadcast(first), F.col("date") < F.col("changed"), "right").groupBy("changed").agg(F.max("date").alias("boundary"))


@query("k17_affected_scopes", _IMPORTS + " SELECT DISTINCT unnest(['all', 'season', 'tier', 'league', 'league']) AS kind, unnest(['all', CAST(season AS VARCHAR), tier, league_a, league_b]) AS value FROM changed")
def k17_affected_scopes(spark, sf_dir):
    """The scopes that the games which two imports differ in touch."""
    return B.affected_scopes(changed_games(spark, sf_dir)[1])


@query("k5_first_events", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def k5_first_events(spark, sf_dir):
    return X.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("d8_event_sessions", "SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT user_id, ts, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY ALL")
def d8_event_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 1 hour"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("gap", gap).withColumn("session", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# A site of boards, built twice: all games but those of the last 400 days, then those as well.
_BOARDS = """, boards AS (SELECT season || '-' || tier AS doc_key, team, count(*) AS games, count(*) FILTER (winner = team) AS wins FROM sides GROUP BY ALL), late AS (SELECT DISTINCT season || '-' || tier AS doc_key FROM sides WHERE date > (SELECT max(date) FROM sides) - 400)"""


def built_site(spark, sf_dir):
    """The site after both builds, and the plan of the second, which looks at the documents of late games only."""
    path = new_path(spark, "site")
    rows = S.sides(contest_games(spark, sf_dir)).withColumn("doc_key", F.concat_ws("-", "season", "tier"))
    # Both builds count the same games: they are summed up by date once.
    days = write_back(rows.groupBy("doc_key", "team", "date").agg(F.count("*").alias("games"), F.count_if(S.won()).alias("wins")), f"{path}/days")
    days = days.crossJoin(F.broadcast(days.agg(F.date_sub(F.max("date"), 400).alias("cut"))))

    def boards(df):
        out = df.groupBy("doc_key", "team").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"))
        return site.Artifact("boards", out, {"counts": F.col("wins").between(0, F.col("games")), "team": F.col("team").isNotNull()}, ("team",), 1 << 20)

    made = site.Site(spark, f"{path}/site")
    made.build([boards(days.where("date <= cut"))], "one")
    late = days.where("date > cut").select(F.lit("boards").alias("artifact"), "doc_key").distinct()
    return made, made.build([boards(days)], "two", late)


@query("b1_published_boards", _BOARDS + " SELECT doc_key, team, games, wins FROM boards", "sides")
def b1_published_boards(spark, sf_dir):
    """What readers of the site find after a partial build."""
    return built_site(spark, sf_dir)[0].read("boards", "team string, games long, wins long").select("doc_key", "team", "games", "wins")


@query("b3_write_plan", _BOARDS + " SELECT b.doc_key, CASE WHEN any_value(l.doc_key) IS NULL THEN 'keep' ELSE 'write' END AS action, count(*) AS rows FROM boards b LEFT JOIN late l ON l.doc_key = b.doc_key GROUP BY b.doc_key", "sides")
def b3_write_plan(spark, sf_dir):
    """Which documents the partial build wrote and which it took over."""
    return built_site(spark, sf_dir)[1].select("doc_key", "action", "rows")
