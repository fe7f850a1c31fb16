"""Events by name: leagues, tiers, regions, tournaments and what hangs on them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import taxonomy as T
from ..functions.rounding import half_up
from ..operators import series as S
from ..operators import tournaments as U
from ..operators.storage import new_path, write_back
from ..sources.contest import contest_games, stored_games
from .analysis_queries import r4
from .history_queries import records
from .registry import PARTS, query

#: What the contest's leagues and events are called in texts.
CODES = {"AFRICA": "LFL", "AMERICA": "LCS", "ASIA": "LCK", "EUROPE": "LEC", "MIDDLE EAST": "Arabian League"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(subject: str, values: dict, default: str = "NULL") -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else repr(v) + ('::DOUBLE' if isinstance(v, float) else '')}" for k, v in values.items()) + f" ELSE {default} END"


def rules(subject: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, {quoted(p)}, 'i') THEN {quoted(v)}" for v, p in pairs) + f" ELSE {default} END"


def listed(names) -> str:
    return "(" + ", ".join(map(quoted, names)) + ")"


def named_series(spark, sf_dir, games=None):
    """Every series with the name of its event, whether it is playoffs, and a phase."""
    code = S.resolve_series(contest_games(spark, sf_dir) if games is None else games).withColumn("code", F.create_map(*[F.lit(x) for p in CODES.items() for x in p])[F.col("league_a")])
    season = F.col("season").cast("string")
    month = F.month("date")
    minor = F.when(month <= 3, F.concat(F.lit("EWC "), season, F.lit(" Online Qualifiers"))).when(month <= 6, F.concat(F.lit("Road to MSI "), season)).when(month <= 9, F.concat(F.lit("KeSPA Cup "), season)).otherwise(F.concat(F.lit("Clash Series "), season))
    event = (
        F.when(F.col("tier") == "worlds-playoffs", F.when(month <= 6, F.concat(F.lit("Worlds "), season)).otherwise(F.concat(F.lit("World Championship "), season)))
        .when(F.col("tier") == "msi-bracket", F.when(month <= 6, F.concat(F.lit("MSI "), season)).otherwise(F.concat(F.lit("Mid-Season Invitational "), season)))
        .when(F.col("tier") == "major-playoffs", F.concat_ws(" ", "code", season, F.lit("Playoffs")))
        .when(F.col("tier") == "regional-regular", F.concat_ws(" ", "code", F.when(month <= 6, "Spring").otherwise("Academy Summer"), season))
        .otherwise(minor)
    )
    phase = F.when(F.col("best_of") == 5, "Semifinals").when(F.col("best_of") == 3, "Quarterfinals").otherwise("Groups")
    return code.withColumns({"event": event, "playoffs": (F.col("tier") == "major-playoffs") | (F.col("best_of") == 5), "phase": phase})


PARTS["named"] = f"""
named AS (SELECT *, (tier = 'major-playoffs' OR best_of = 5) AS playoffs, CASE best_of WHEN 5 THEN 'Semifinals' WHEN 3 THEN 'Quarterfinals' ELSE 'Groups' END AS phase,
  CASE tier WHEN 'worlds-playoffs' THEN CASE WHEN month(date) <= 6 THEN 'Worlds ' ELSE 'World Championship ' END || season WHEN 'msi-bracket' THEN CASE WHEN month(date) <= 6 THEN 'MSI ' ELSE 'Mid-Season Invitational ' END || season
  WHEN 'major-playoffs' THEN code || ' ' || season || ' Playoffs' WHEN 'regional-regular' THEN code || CASE WHEN month(date) <= 6 THEN ' Spring ' ELSE ' Academy Summer ' END || season
  ELSE CASE WHEN month(date) <= 3 THEN 'EWC ' || season || ' Online Qualifiers' WHEN month(date) <= 6 THEN 'Road to MSI ' || season WHEN month(date) <= 9 THEN 'KeSPA Cup ' || season ELSE 'Clash Series ' || season END END AS event
  FROM (SELECT *, {case('league_a', CODES)} AS code FROM series))"""
_EXPLICIT = f"regexp_extract(upper(trim(event)), {quoted(T.LEADING_LEAGUE)}, 1)"
_LEAGUE = f"CASE WHEN {_EXPLICIT} <> '' THEN {_EXPLICIT} ELSE {rules('event', T.LEAGUE_RULES, quoted('Unknown'))} END"
PARTS["leagued"] = f"leagued AS (SELECT *, {_LEAGUE} AS league FROM named)"
_TEXT = "lower(league || ' ' || event)"
_TIER = f"CASE WHEN contains({_TEXT}, 'road to msi') AND upper(league) NOT IN {listed(T.INTERNATIONAL_LEAGUES)} THEN 'major-playoffs' " + " ".join(f"WHEN regexp_matches({_TEXT}, {quoted(p)}) THEN CASE WHEN playoffs THEN {quoted(a)} ELSE {quoted(b)} END" for p, a, b in T.TIER_RULES) + " WHEN playoffs THEN 'major-playoffs' ELSE 'regional-regular' END"


def league_tier_sql(x: str) -> str:
    own = f"upper(trim({x}))"
    return f"CASE WHEN {own} IN ('', 'UNKNOWN') THEN 'unknown' " + " ".join(f"WHEN {own} IN {listed(v)} THEN {quoted(t)}" for t, v in T.LEAGUES_BY_TIER.items()) + f" WHEN regexp_matches({x}, {quoted(T.EMERGING_WORDS)}, 'i') THEN 'emerging' ELSE 'unknown' END"


def region_sql(x: str) -> str:
    own = f"upper(trim({x}))"
    return "CASE " + " ".join(f"WHEN {own} IN {listed(c)} THEN {quoted(r)}" for r, c in T.REGION_CODES) + " " + " ".join(f"WHEN regexp_matches({own}, {quoted('|'.join(p))}) THEN {quoted(r)}" for r, p in T.REGION_PARTS) + " ELSE 'International' END"


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(event, {quoted(p)}, 'i')" + (f" AND NOT regexp_matches(event, {quoted(w)}, 'i')" if w else "") + f" THEN {quoted(f)}" for f, p, w in T.FAMILIES) + " END"
_SEASON = r"coalesce(nullif(regexp_extract(event, '\b(20\d{2})\b', 1), ''), CASE WHEN regexp_full_match(CAST(season AS VARCHAR), '20\d{2}') THEN CAST(season AS VARCHAR) END)"
PARTS["staged"] = f"staged AS (SELECT *, {_FAMILY} || ':' || CAST(season AS VARCHAR) AS instance FROM named)"


def leagued(spark, sf_dir):
    return named_series(spark, sf_dir).withColumn("league", T.league_of_event(F.col("event")))


def staged(spark, sf_dir, games=None):
    """Series with the family and season of their tournament (seasons here are of any century)."""
    family = T.tournament_family(F.col("event"))
    return named_series(spark, sf_dir, games).withColumn("instance", F.when(family.isNotNull(), F.concat_ws(":", family, F.col("season").cast("string"))))


@query("j4_event_league", "SELECT series_id, event, league FROM leagued", "series named leagued")
def j4_event_league(spark, sf_dir):
    return leagued(spark, sf_dir).select("series_id", "event", "league")


@query("j5_event_tier", f"SELECT series_id, event, {_TIER} AS event_tier, {case(_TIER, T.TIER_RANKS)} AS tier_rank FROM leagued", "series named leagued")
def j5_event_tier(spark, sf_dir):
    tier = T.event_tier(F.col("event"), F.col("league"), F.col("playoffs"))
    return leagued(spark, sf_dir).select("series_id", "event", tier.alias("event_tier")).withColumn("tier_rank", T.tier_rank(F.col("event_tier")))


@query("j6_event_phase", "SELECT series_id, CASE " + " ".join(f"WHEN regexp_matches(lower(event || ' ' || phase), {quoted(p)}) THEN {quoted(v)}" for v, p in N.PHASE_WORDS) + " ELSE 'Regular season' END AS event_phase FROM named", "series named")
def j6_event_phase(spark, sf_dir):
    return named_series(spark, sf_dir).select("series_id", N.event_phase(F.concat_ws(" ", "event", "phase")).alias("event_phase"))


@query("j7_league_regions", f"SELECT DISTINCT league, {region_sql('league')} AS region, CASE WHEN upper(trim(league)) IN {listed(T.FEEDERS)} OR {region_sql('league')} IN {listed(T.FEEDER_REGIONS)} THEN 'LCP' ELSE {region_sql('league')} END AS current_region FROM leagued", "series named leagued")
def j7_league_regions(spark, sf_dir):
    region = T.region_of_league(F.col("league"))
    return leagued(spark, sf_dir).select("league").distinct().select("league", region.alias("region"), T.current_region(F.col("league"), region).alias("current_region"))


@query(
    "j8_home_leagues",
    f""", asked AS (SELECT series_id, CASE WHEN tier = 'major-playoffs' THEN code END AS explicit_home, CASE WHEN tier = 'regional-regular' THEN ' ' || code || ' ' ELSE ' ' END AS explicit, CASE WHEN tier = 'worlds-playoffs' THEN NULL ELSE league END AS competition, code AS identity FROM leagued),
homes AS (SELECT *, coalesce(nullif(trim(explicit_home), ''), nullif(trim(explicit), ''), CASE WHEN upper(trim(coalesce(nullif(trim(competition), ''), 'Unknown'))) <> 'UNKNOWN' THEN coalesce(nullif(trim(competition), ''), 'Unknown') ELSE coalesce(nullif(trim(identity), ''), 'Unknown') END) AS home FROM asked)
SELECT series_id, home, CASE WHEN upper(trim(home)) = 'UNKNOWN' THEN 'International' ELSE {region_sql('home')} END AS region FROM homes""",
    "series named leagued",
)
def j8_home_leagues(spark, sf_dir):
    rows = leagued(spark, sf_dir)
    home = T.home_league(F.when(F.col("tier") == "major-playoffs", F.col("code")), F.when(F.col("tier") == "regional-regular", F.concat(F.lit(" "), "code", F.lit(" "))).otherwise(" "), F.when(F.col("tier") != "worlds-playoffs", F.col("league")), F.col("code"))
    rows = rows.select("series_id", home.alias("home"))
    none = F.lit(None).cast("string")
    return rows.withColumn("region", T.side_region(none, F.col("home"), none, none))


@query("j9_league_scores", f""", base AS (SELECT l.league, count(*) AS series, count(*) FILTER (league_a <> league_b) AS abroad, {r4('CAST(sum(CAST(a.rating AS DECIMAL(18,1))) AS DOUBLE) / count(*)', 2)} AS raw FROM leagued l JOIN records a ON l.team_a = a.team GROUP BY l.league),
priors AS (SELECT *, {league_tier_sql('league')} AS league_tier FROM base), p AS (SELECT *, {case('league_tier', T.TIER_PRIORS)} AS prior FROM priors)
SELECT league, series, abroad, league_tier, prior, {r4("least(prior + abroad / (abroad + 8.0::DOUBLE) * (raw - prior), " + case('league_tier', T.TIER_CAPS, "'inf'::DOUBLE") + ")", 2)} AS effective FROM p""", "sides records series named leagued")
def j9_league_scores(spark, sf_dir):
    rated = records(spark, sf_dir).select(F.col("team").alias("team_a"), "rating")
    rows = leagued(spark, sf_dir).join(rated, "team_a").groupBy("league").agg(F.count("*").alias("series"), F.count_if(F.col("league_a") != F.col("league_b")).alias("abroad"), half_up(F.sum(F.col("rating").cast("decimal(18,1)")).cast("double") / F.count("*"), 2).alias("raw"))
    league = F.col("league")
    return rows.select("league", "series", "abroad", T.league_tier(league).alias("league_tier"), T.league_prior(league).alias("prior"), half_up(T.effective_league_rating(league, F.col("raw"), F.col("abroad")), 2).alias("effective"))


@query("j10_tournaments", f"SELECT series_id, event, {_FAMILY} AS family, {_SEASON} AS tournament_season, {_FAMILY} || ':' || {_SEASON} AS tournament FROM named", "series named")
def j10_tournaments(spark, sf_dir):
    event, season = F.col("event"), F.col("season")
    return named_series(spark, sf_dir).select("series_id", "event", T.tournament_family(event).alias("family"), T.tournament_season(event, season).alias("tournament_season"), T.tournament_id(event, season).alias("tournament"))


@query("c2_rated_teams", f"SELECT team_a AS team, count(*) AS series FROM leagued WHERE upper(trim(league)) IN {listed(T.RATED)} GROUP BY team_a", "series named leagued")
def c2_rated_teams(spark, sf_dir):
    return leagued(spark, sf_dir).where(T.is_rated_league(F.col("league"))).groupBy(F.col("team_a").alias("team")).agg(F.count("*").alias("series"))


@query("c18_development_teams", rf", named_teams AS (SELECT DISTINCT team_a || CASE tier WHEN 'qualifier' THEN ' Academy' WHEN 'regional-regular' THEN ' Challengers' WHEN 'msi-bracket' THEN ' Academics' ELSE '' END AS name FROM games) SELECT name, regexp_matches(name, {quoted(T.DEVELOPMENT)}, 'i') AS development FROM named_teams")
def c18_development_teams(spark, sf_dir):
    suffix = F.when(F.col("tier") == "qualifier", " Academy").when(F.col("tier") == "regional-regular", " Challengers").when(F.col("tier") == "msi-bracket", " Academics").otherwise("")
    rows = contest_games(spark, sf_dir).select(F.concat("team_a", suffix).alias("name")).distinct()
    return rows.withColumn("development", T.is_development_team(F.col("name")))


@query("c16_tournament_teams", "SELECT instance, team, count(*) AS matches FROM (SELECT instance, unnest([team_a, team_b]) AS team FROM staged WHERE instance IS NOT NULL) GROUP BY ALL", "series named staged")
def c16_tournament_teams(spark, sf_dir):
    return U.participants(staged(spark, sf_dir))


@query("c20_overlapping_events", """, spans AS (SELECT instance, min(date) AS "start", max(date) AS "end" FROM staged WHERE instance IS NOT NULL GROUP BY instance), q AS (SELECT quantile_disc(date, 0.25) AS a, quantile_disc(date, 0.5) AS b FROM series)
SELECT instance, "start", "end" FROM spans, q WHERE "start" <= b AND "end" >= a""", "series named staged")
def c20_overlapping_events(spark, sf_dir):
    rows = staged(spark, sf_dir)
    spans = rows.where("instance is not null").groupBy("instance").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    # The window is the second quarter of all dates by rank.
    a, b = rows.agg(F.percentile_approx(F.unix_date("date"), [0.25, 0.5], 1_000_000)).first()[0]
    day = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), F.lit(d))
    return U.overlapping(spans, day(a), day(b))


@query("e18_tournament_standings", """, entries AS (SELECT instance, team, count(*) AS matches FROM (SELECT instance, unnest([team_a, team_b]) AS team FROM staged WHERE instance IS NOT NULL) GROUP BY ALL),
board AS (SELECT team, rating, row_number() OVER (ORDER BY rating DESC, team) AS overall_rank FROM records)
SELECT instance, e.team, matches, overall_rank, rating, row_number() OVER (PARTITION BY instance ORDER BY overall_rank, e.team) AS rank FROM entries e JOIN board b ON e.team = b.team""", "sides records series named staged")
def e18_tournament_standings(spark, sf_dir):
    board = records(spark, sf_dir).select("team", "rating", F.row_number().over(Window.orderBy(F.col("rating").desc(), "team")).cast("long").alias("rank"))
    return U.project_standings(board, U.participants(staged(spark, sf_dir))).select("instance", "team", "matches", "overall_rank", "rating", "rank")


@query("f23_unresolved_events", """, r AS (SELECT event, team_a AS team, count(*) AS n FROM leagued WHERE league = 'Unknown' GROUP BY ALL), k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event) AS BIGINT) AS sides, count(*) OVER (PARTITION BY event) AS teams, row_number() OVER (PARTITION BY event ORDER BY n DESC, team) AS r FROM r)
SELECT event, max(sides) AS sides, max(teams) AS teams, string_agg(team, ',' ORDER BY r) AS samples FROM k WHERE r <= 5 GROUP BY event ORDER BY 2 DESC, 1 LIMIT 12""", "series named leagued")
def f23_unresolved_events(spark, sf_dir):
    return U.unresolved(leagued(spark, sf_dir).select("event", "league", F.col("team_a").alias("team")))


@query("f24_league_histogram", "SELECT league, count(*) AS series FROM leagued GROUP BY league", "series named leagued")
def f24_league_histogram(spark, sf_dir):
    return leagued(spark, sf_dir).groupBy("league").agg(F.count("*").alias("series"))


@query(
    "f30_profile_merge",
    f""", seen AS (SELECT team_a AS team, league, {league_tier_sql('league')} AS league_tier, max(date) AS last_date FROM leagued GROUP BY ALL),
scored AS (SELECT team, league, {case('league_tier', T.PROFILE_SCORES)} AS score, last_date, 1 AS source FROM seen UNION ALL SELECT team, {case('league', CODES)} AS league, 3, last_date, 0 FROM records)
SELECT team, league, score FROM scored QUALIFY row_number() OVER (PARTITION BY team ORDER BY score DESC, source, last_date DESC, league) = 1""",
    "sides records series named leagued",
)
def f30_profile_merge(spark, sf_dir):
    score = lambda c: F.create_map(*[F.lit(x) for p in T.PROFILE_SCORES.items() for x in p])[T.league_tier(c)]
    seen = leagued(spark, sf_dir).groupBy(F.col("team_a").alias("team"), "league").agg(F.max("date").alias("last_date"))
    seen = seen.select("team", "league", score(F.col("league")).alias("score"), "last_date", F.lit(1).alias("source"))
    code = F.create_map(*[F.lit(x) for p in CODES.items() for x in p])[F.col("league")]
    own = records(spark, sf_dir).select("team", code.alias("league"), F.lit(3).alias("score"), "last_date", F.lit(0).alias("source"))
    best = F.row_number().over(Window.partitionBy("team").orderBy(F.col("score").desc(), "source", F.col("last_date").desc(), "league"))
    return seen.union(own).withColumn("r", best).where("r = 1").select("team", "league", "score")


@query("p32_league_profiles", f"SELECT DISTINCT league, {case(league_tier_sql('league'), T.PROFILE_SCORES)} AS profile_score, upper(trim(league)) IN {listed(T.RATED)} AS rated FROM leagued", "series named leagued")
def p32_league_profiles(spark, sf_dir):
    score = F.create_map(*[F.lit(x) for p in T.PROFILE_SCORES.items() for x in p])[T.league_tier(F.col("league"))]
    return leagued(spark, sf_dir).select("league").distinct().select("league", score.alias("profile_score"), T.is_rated_league(F.col("league")).alias("rated"))


@query("p34_filter_options", "SELECT 'All' AS option, count(*) AS series FROM staged UNION ALL SELECT 'international', count(*) FILTER (instance IS NOT NULL) FROM staged UNION ALL SELECT 'tournament:' || instance, count(*) FROM staged WHERE instance IS NOT NULL GROUP BY instance", "series named staged")
def p34_filter_options(spark, sf_dir):
    instance = F.col("instance")
    options = F.array(F.lit("All"), F.when(instance.isNotNull(), "international"), F.when(instance.isNotNull(), F.concat(F.lit("tournament:"), instance)))
    return staged(spark, sf_dir).select(F.explode(F.array_compact(options)).alias("option")).groupBy("option").agg(F.count("*").alias("series"))


@query("p35_region_leagues", f", r AS (SELECT DISTINCT {region_sql('league')} AS region, league FROM leagued) SELECT region, string_agg(league, ', ' ORDER BY league) AS leagues FROM r GROUP BY region", "series named leagued")
def p35_region_leagues(spark, sf_dir):
    rows = leagued(spark, sf_dir).select("league").distinct().withColumn("region", T.region_of_league(F.col("league")))
    return rows.groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("league")), ", ").alias("leagues"))


_MAIN = f"tier <> 'qualifier' AND NOT regexp_matches(event || ' ' || phase, {quoted(T.NOT_MAIN)}, 'i')"


@query(
    "k19_lifecycles",
    f""", rated AS (SELECT instance, date, series_id FROM staged WHERE instance IS NOT NULL AND state = 'completed' AND {_MAIN}),
plan AS (SELECT instance, date, series_id, state = 'completed' AS completed FROM staged WHERE instance IS NOT NULL), ended AS (SELECT min(date) AS first, max(date) AS last FROM series),
p AS (SELECT instance, min(date) AS s0, max(date) AS s1, bool_and(completed) AS all_done, max(date) FILTER (completed) AS last_done, count(*) FILTER (completed) AS done FROM plan GROUP BY instance),
r AS (SELECT r.instance, r.date, r.series_id FROM rated r JOIN p ON r.instance = p.instance, ended e WHERE NOT (p.s0 - e.first >= 7 AND r.date < p.s0)),
m AS (SELECT instance, count(*) AS missing FROM (SELECT instance, series_id FROM plan WHERE completed EXCEPT SELECT instance, series_id FROM r) GROUP BY instance),
s AS (SELECT instance, min(date) AS "start", max(date) AS rated_through FROM r GROUP BY instance),
o AS (SELECT s.*, p.s1, p.all_done, p.last_done, p.done, m.missing, e.last, CASE WHEN all_done THEN 'completed' WHEN p.s1 >= e.last THEN 'ongoing' ELSE 'unknown' END AS status FROM s JOIN p ON s.instance = p.instance LEFT JOIN m ON s.instance = m.instance, ended e)
SELECT instance, status, "start", CASE status WHEN 'completed' THEN s1 WHEN 'ongoing' THEN last ELSE rated_through END AS boundary, rated_through, s1 AS scheduled_end, coalesce(last_done > rated_through, false) AS data_lag, all_done AND done > 0 AND missing IS NULL AS coverage_complete FROM o""",
    "series named staged",
)
def k19_lifecycles(spark, sf_dir):
    rows = staged(spark, sf_dir)
    rated = rows.where("state = 'completed'").where(T.is_main_event(F.col("event"), F.col("phase"), F.col("tier"))).select("instance", "date", F.col("series_id").alias("match_id"))
    ends = rows.agg(F.min("date").alias("coverage_start"), F.max("date").alias("coverage_end"))
    plan = rows.select("instance", "date", F.col("series_id").alias("match_id"), (F.col("state") == "completed").alias("completed")).crossJoin(F.broadcast(ends)).withColumns({"coverage_end_complete": F.lit(True), "retrieved": F.col("coverage_end")})
    last = ends.first()["coverage_end"]
    return U.lifecycles(rated, plan, F.lit(last))


_PLACED = f""", m AS (SELECT instance AS event_key, CASE WHEN instance LIKE 'worlds%' THEN 'worlds' WHEN instance LIKE 'msi%' THEN 'msi' ELSE 'minor' END AS kind, lower(phase || ' ' || event) AS text, tier, team_a, team_b, league_a, league_b, winner FROM staged WHERE instance IS NOT NULL),
pts AS (SELECT *, regexp_matches(text, {quoted(U.FINAL)}) AND NOT regexp_matches(text, {quoted(U.SEMI)}) AND NOT regexp_matches(text, {quoted(U.QUARTER)}) AS final, CASE WHEN regexp_matches(text, {quoted(U.QUARTER)}) THEN 3 WHEN regexp_matches(text, {quoted(U.SEMI)}) THEN 5 WHEN tier IN ('worlds-playoffs', 'msi-bracket') THEN 3 ELSE 1 END AS each FROM m),
both_ AS (SELECT event_key, kind, team_a AS team, league_a AS league, CASE WHEN final THEN CASE WHEN winner = team_a THEN 11 ELSE 8 END ELSE each END AS points FROM pts UNION ALL SELECT event_key, kind, team_b, league_b, CASE WHEN final THEN CASE WHEN winner = team_b THEN 11 ELSE 8 END ELSE each END FROM pts),
starts AS (SELECT instance AS event_key, min(date) AS s FROM staged WHERE instance IS NOT NULL GROUP BY instance),
earlier AS (SELECT b.event_key, b.team, {r4('1500.0::DOUBLE + 400.0::DOUBLE * ((count(*) FILTER (g.winner = g.team) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) - 0.5::DOUBLE)', 1)} AS power FROM (SELECT DISTINCT event_key, team FROM both_) b JOIN starts USING (event_key) JOIN sides g ON g.team = b.team AND g.date < s GROUP BY ALL),
t AS (SELECT b.event_key, b.team, max(kind) AS kind, max(b.league) AS league, max(points) AS points, coalesce(any_value(r.power), 1500.0::DOUBLE) AS power FROM both_ b LEFT JOIN earlier r ON b.team = r.team AND b.event_key = r.event_key GROUP BY b.event_key, b.team),
w AS (SELECT *, CAST(round(exp((power - max(power) OVER (PARTITION BY event_key)) / 400.0::DOUBLE), 8) AS DECIMAL(20,8)) AS weight FROM t),
x AS (SELECT *, CAST(round(1.0::DOUBLE + CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY event_key) AS DOUBLE) * (CASE kind WHEN 'minor' THEN 8.0::DOUBLE ELSE 11.0::DOUBLE END - 1.0::DOUBLE), 6) AS DECIMAL(20,6)) AS expected FROM w),
g AS (SELECT event_key, league, max(kind) AS kind, CAST(sum(points) AS BIGINT) AS actual, CAST(sum(expected) AS DOUBLE) AS expected, count(DISTINCT team) AS representatives FROM x GROUP BY ALL),
d AS (SELECT *, {r4("greatest(least(CASE kind WHEN 'worlds' THEN 2.0::DOUBLE WHEN 'msi' THEN 1.65::DOUBLE ELSE 1.25::DOUBLE END * (actual - expected) / sqrt(representatives::DOUBLE), CASE kind WHEN 'worlds' THEN 35.0::DOUBLE WHEN 'msi' THEN 25.0::DOUBLE ELSE 18.0::DOUBLE END), -CASE kind WHEN 'worlds' THEN 35.0::DOUBLE WHEN 'msi' THEN 25.0::DOUBLE ELSE 18.0::DOUBLE END)", 1)} AS delta FROM g)"""


@query("l11_placement_residuals", f"""{_PLACED}
SELECT event_key, league, actual, {r4('expected')} AS expected, representatives, CASE WHEN abs(delta) >= 0.05 THEN delta END AS delta FROM d""", "sides series named staged")
def l11_placement_residuals(spark, sf_dir):
    return event_residuals(spark, sf_dir)[0]


def event_residuals(spark, sf_dir):
    """(residuals, events) with the series of all events; games, those series and residuals are written down, as each is read more than once."""
    path = new_path(spark, "residuals")
    games = stored_games(spark, sf_dir)
    kind = F.when(F.col("instance").startswith("worlds"), "worlds").when(F.col("instance").startswith("msi"), "msi").otherwise("minor")
    rows = staged(spark, sf_dir, games).where("instance is not null").withColumns({"event_key": F.col("instance"), "kind": kind, "multiplier": F.lit(1.0)})
    rows = write_back(rows, f"{path}/rows")
    each = rows.select("event_key", "date", F.explode(F.array("team_a", "team_b")).alias("team"))
    start = rows.groupBy("event_key").agg(F.min("date").alias("start"))
    powers = U.powers_before(games, each.join(start, "event_key"))
    return write_back(U.placement_residuals(rows, write_back(powers, f"{path}/powers")), f"{path}/residuals"), rows


_PRIORS = {"AFRICA": 1300.0, "AMERICA": 1450.0, "ASIA": 1500.0, "EUROPE": 1450.0}


@query(
    "p8_placed_scores",
    f"""{_PLACED}, ends AS (SELECT instance AS event_key, max(date) AS "end" FROM staged WHERE instance IS NOT NULL GROUP BY instance), moved AS (SELECT d.league, d.event_key, e."end", d.delta, {case('d.league', _PRIORS, '1250.0::DOUBLE')} AS prior FROM d JOIN ends e USING (event_key) WHERE abs(d.delta) >= 0.05)
SELECT a.league, a.event_key, a."end", a.delta, {r4('a.prior + coalesce(CAST(sum(CAST(b.delta AS DECIMAL(18,1))) FILTER (b."end" < a."end") AS DOUBLE), 0.0::DOUBLE)', 1)} AS before, {r4('a.prior + CAST(sum(CAST(b.delta AS DECIMAL(18,1))) AS DOUBLE)', 1)} AS score FROM moved a JOIN moved b ON b.league = a.league AND b."end" <= a."end" GROUP BY a.league, a.event_key, a."end", a.delta, a.prior""",
    "sides series named staged",
)
def p8_placed_scores(spark, sf_dir):
    """Every league's score before and after each event whose placements move it, from the day that the event ends."""
    residuals, rows = event_residuals(spark, sf_dir)
    ends = rows.groupBy("event_key").agg(F.max("date").alias("end"))
    leagues = residuals.select("league").distinct()
    prior = F.coalesce(F.create_map(*[F.lit(x) for p in _PRIORS.items() for x in p])[F.col("league")], F.lit(1250.0))
    return U.placed_scores(residuals, ends, leagues.select("league", prior.alias("prior")))


@query("f34_representatives", "SELECT instance, league, count(DISTINCT team) AS representatives FROM (SELECT instance, team_a AS team, league_a AS league FROM staged UNION ALL SELECT instance, team_b, league_b FROM staged) WHERE instance IS NOT NULL GROUP BY ALL", "series named staged")
def f34_representatives(spark, sf_dir):
    return S.sides(staged(spark, sf_dir)).where("instance is not null").groupBy("instance", "league").agg(F.countDistinct("team").alias("representatives"))


@query("c4_calendar_seasons", "SELECT season, count(*) AS series, count(*) FILTER (year(date) = season) AS aligned FROM series GROUP BY season", "series")
def c4_calendar_seasons(spark, sf_dir):
    return S.resolve_series(contest_games(spark, sf_dir)).groupBy("season").agg(F.count("*").alias("series"), F.count_if(F.year("date") == F.col("season")).alias("aligned"))


@query("c15_catalog_search", "SELECT series_id, league FROM leagued WHERE (contains(lower(team_a), 'n_1') OR contains(lower(team_b), 'n_1') OR contains(lower(left(team_a, 3)), 'n_1') OR contains(lower(left(team_b, 3)), 'n_1')) AND contains(lower(event), 'cup')", "series named leagued")
def c15_catalog_search(spark, sf_dir):
    from ..operators.directories import catalog_search

    rows = leagued(spark, sf_dir).withColumns({"code_a": F.substring("team_a", 1, 3), "code_b": F.substring("team_b", 1, 3)})
    return catalog_search(rows, text="N_1", event="cup").select("series_id", "league")


@query("c17_power_regions", f", r AS (SELECT league, {region_sql('league')} AS region FROM leagued) SELECT league, region, count(*) AS series, upper(trim(region)) IN {listed(T.RATED)} AS counted FROM r GROUP BY ALL", "series named leagued")
def c17_power_regions(spark, sf_dir):
    rows = leagued(spark, sf_dir).groupBy("league").agg(F.count("*").alias("series")).withColumn("region", T.region_of_league(F.col("league")))
    return rows.select("league", "region", "series", T.is_rated_league(F.col("region")).alias("counted"))


@query("p48_affected_tournaments", "SELECT instance, count(*) AS changes, min(d.date) AS replay_from FROM ledger_diff d JOIN staged s ON d.series_id = s.series_id WHERE instance IS NOT NULL GROUP BY instance", "series named staged ledgers")
def p48_affected_tournaments(spark, sf_dir):
    from .analysis_queries import ledgers

    diff, _ = ledgers(spark, sf_dir)
    rows = staged(spark, sf_dir).where("instance is not null").select("series_id", "instance")
    return diff.join(rows, "series_id").groupBy("instance").agg(F.count("*").alias("changes"), F.min("date").alias("replay_from"))
