"""Imports, reconciliation, text and number functions, and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions import ratings as R
from ..functions import taxonomy as T
from ..functions.rounding import half_up
from ..operators import incremental as I
from ..operators import reconcile as X
from ..operators import series as S
from ..operators.simulation import simulate_bracket
from ..operators.storage import new_path, publish_file, write_back
from ..sources import importers, manifest
from ..sources.contest import contest_games, stored_games, table
from ..streaming import completion
from .analysis_queries import r4
from .event_queries import CODES, _TIER, case, leagued, named_series
from .history_queries import points, records
from .registry import PARTS, query

# Imports: the contest written as files of each source and read back.


#: Rows of one file of an export.
EXPORT_ROWS = 1_000_000


def csv_export(spark, sf_dir, games=None) -> str:
    """The contest's games as a CSV export: two players a side, and team rows but for qualifiers."""
    games = contest_games(spark, sf_dir) if games is None else games
    text = lambda c: F.col(c).cast("string")
    common = games.select(
        F.concat_ws("-", text("series_id"), text("game_number")).alias("gameid"),
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 10:00:00")).alias("date"),
        text("season").alias("year"),
        F.create_map(*[F.lit(x) for p in CODES.items() for x in p])[F.col("league_a")].alias("league"),
        F.when(F.month("date") <= 6, "Spring").otherwise("Summer").alias("split"),
        F.when(F.col("tier") == "major-playoffs", "1").otherwise("0").alias("playoffs"),
        F.concat(F.lit("15."), F.month("date").cast("string"), F.lit(".2")).alias("patch"),
        F.lit('a, "quoted" note').alias("url"),
        text("best_of").alias("bestof"),
        F.concat(F.lit("3"), (F.col("game_number") % 10).cast("string"), F.lit(":05")).alias("gamelength"),
        "team_a",
        "team_b",
        "winner",
        "tier",
        F.floor("kills").cast("long").alias("kills"),
        "game_number",
        "player",
    )

    def row(side, position, kills, player):
        team = F.col("team_a" if side == "Blue" else "team_b")
        total = F.col("kills") if side == "Blue" else F.col("game_number")
        return F.struct(
            F.lit(side).alias("side"),
            F.lit(position).alias("position"),
            F.concat(F.lit(" "), team, F.lit("  ")).alias("teamname"),
            F.when(F.col("winner") == team, "1").otherwise("0").alias("result"),
            kills.cast("string").alias("kills"),
            F.when(F.lit(position == "team"), total.cast("string")).alias("teamkills"),
            (player.cast("string") if player is not None else F.lit(None).cast("string")).alias("playerid"),
            F.lit(position).alias("playername"),
            F.when(F.col("game_number") == 2, "n/a").otherwise((F.col("kills") * 0.5).cast("string")).alias("vspm"),
        )

    first = F.floor(F.col("kills") / 2)
    rows = [row("Blue", "team", F.col("kills"), None), row("Red", "team", F.col("game_number"), None), row("Blue", "top", first, F.col("player")), row("Blue", "mid", F.col("kills") - first, F.col("player") + 1), row("Red", "top", F.col("game_number"), F.col("player") + 2), row("Red", "jng", F.lit(0), None)]
    each = common.select("*", F.explode(F.array(*rows)).alias("r")).where("r.position <> 'team' or tier <> 'qualifier'")
    out = each.select("gameid", "date", "year", "league", "split", "playoffs", "patch", "url", "bestof", "gamelength", "r.*")
    path = new_path(spark, "export")
    # Files of quoted text cannot be split: they are small and compressed, so that neither a task nor a disk holds much of them.
    # At the fastest level: deflating took half of the write at the usual one.
    out.write.option("maxRecordsPerFile", EXPORT_ROWS).option("zlib.compress.level", "BEST_SPEED").csv(path, header=True, escape='"', quoteAll=True, compression="gzip")
    return path


_EVENT = "league || ' ' || split || CASE WHEN playoffs THEN ' Playoffs' ELSE '' END"
PARTS["export"] = f"""
export AS (SELECT g.*, CAST(series_id AS VARCHAR) || '-' || CAST(game_number AS VARCHAR) AS game_id, {case('league_a', CODES)} AS league, CASE WHEN month(date) <= 6 THEN 'Spring' ELSE 'Summer' END AS split, tier = 'major-playoffs' AS playoffs FROM games g),
evented AS (SELECT * EXCLUDE (tier), {_EVENT} AS event FROM export)"""


@query("a1_csv_games", f"SELECT game_id, date, CAST(season AS INTEGER) AS season, event, {_TIER} AS tier, '15.' || month(date) AS patch, team_a, team_b, winner, floor(CAST(kills AS DOUBLE)) AS kills_a, CAST(game_number AS DOUBLE) AS kills_b, CAST(1805 + 60 * game_number AS BIGINT) AS seconds FROM evented", "export")
def a1_csv_games(spark, sf_dir):
    return importers.games(importers.read_rows(spark, csv_export(spark, sf_dir))).select("game_id", "date", "season", "event", "tier", "patch", "team_a", "team_b", "winner", "kills_a", "kills_b", "seconds")


@query("a3_rebuilt_team_rows", "SELECT game_id AS gameid, 'blue' AS side, floor(CAST(kills AS DOUBLE)) AS kills, winner = team_a AS won FROM export WHERE NOT playoffs UNION ALL SELECT game_id, 'red', CAST(game_number AS DOUBLE), winner = team_b FROM export WHERE NOT playoffs", "export")
def a3_rebuilt_team_rows(spark, sf_dir):
    rows = importers.read_rows(spark, csv_export(spark, sf_dir)).where("playoffs = '0' and lower(position) <> 'team'")
    return importers.team_rows(rows).select("gameid", "side", "kills", "won")


@query("a4_csv_rosters", "SELECT game_id, 'blue' AS side, 'partial' AS completeness, 'mid:' || (player + 1) || ',top:' || player AS players FROM export UNION ALL SELECT game_id, 'red', 'partial', 'jungle:name:' || sha256('jng|' || lower(regexp_replace(team_b, '[^A-Za-z0-9]', '', 'g'))) || ',top:' || (player + 2) FROM export", "export")
def a4_csv_rosters(spark, sf_dir):
    rows = importers.rosters(importers.read_rows(spark, csv_export(spark, sf_dir)))
    text = F.array_join(F.transform("players", lambda p: F.concat_ws(":", p.role, p.player_id)), ",")
    return rows.select("game_id", "side", "completeness", text.alias("players"))


@query("a5_player_stats", "SELECT game_id AS gameid, player AS player_id, floor(floor(CAST(kills AS DOUBLE)) / 2) AS kills, CASE WHEN game_number <> 2 THEN floor(CAST(kills AS DOUBLE)) * 0.5::DOUBLE END AS vspm FROM export", "export")
def a5_player_stats(spark, sf_dir):
    rows = importers.read_rows(spark, csv_export(spark, sf_dir)).where("side = 'Blue' and position = 'top'")
    return rows.select("gameid", F.col("playerid").try_cast("long").alias("player_id"), N.number_or_null(F.col("kills")).alias("kills"), N.number_or_null(F.col("vspm")).alias("vspm"))


@query("a15_raw_inventory", "SELECT game_id AS gameid, CASE WHEN tier = 'qualifier' THEN 4 ELSE 6 END AS rows, strftime(date, '%Y-%m-%d') || ' 10:00:00' AS date, league FROM export", "export")
def a15_raw_inventory(spark, sf_dir):
    return importers.inventory(importers.read_rows(spark, csv_export(spark, sf_dir))).select("gameid", "rows", "date", "league")


def wiki_export(spark, sf_dir, games=None) -> str:
    """The contest's games as wiki documents, one a line."""
    games = contest_games(spark, sf_dir) if games is None else games
    code = F.create_map(*[F.lit(x) for p in CODES.items() for x in p])[F.col("league_a")]
    event = F.concat_ws(" ", code, F.when(F.month("date") <= 6, "Spring").otherwise("Summer"))
    text = lambda c: c.cast("string")
    match = F.struct(F.concat_ws("-", text(F.col("series_id")), text(F.col("game_number"))).alias("id"), F.date_format("date", "yyyy-MM-dd").alias("date"), event.alias("event"), F.lit("15.1").alias("patch"), F.col("team_a").alias("teamA"), F.concat(F.lit("  "), F.col("team_b")).alias("teamB"), text(F.col("best_of")).alias("bestOf"), F.col("winner"), text(F.floor("kills")).alias("teamAKills"), F.lit("?").alias("teamBKills"))
    path = new_path(spark, "wiki")
    games.select(F.lit("wiki").alias("source"), F.array(match).alias("matches")).write.json(path, compression="gzip")
    return path


@query("a7_wiki_games", f"SELECT game_id, date, league || ' ' || split AS event, team_a, team_b, winner, floor(CAST(kills AS DOUBLE)) AS kills_a, 0.0::DOUBLE AS kills_b, CASE WHEN best_of IN (1, 2, 3, 5) THEN CAST(best_of AS INTEGER) END AS best_of FROM export", "export")
def a7_wiki_games(spark, sf_dir):
    return importers.wiki_games(spark, wiki_export(spark, sf_dir), whole_files=False).select("game_id", "date", "event", "team_a", "team_b", "winner", "kills_a", "kills_b", "best_of")


@query(
    "a10_manifest_report",
    "SELECT 'csv' AS source, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS repeated_files, count(*) AS rows, count(*) AS dated, min(date) AS first_date, max(date) AS last_date, 'download:warning,rate-limit:error' AS kinds FROM export UNION ALL SELECT 'wiki', 1, 0, count(*), count(*), min(date), max(date), '' FROM export UNION ALL SELECT 'schedule', 0, 0, 0, 0, NULL, NULL, 'freshness:warning'",
    "export",
)
def a10_manifest_report(spark, sf_dir):
    """What loading the sources of a manifest has seen: files, rows, dates and warnings, out of the pass that wrote them."""
    import json

    folder = new_path(spark, "manifest")
    games = stored_games(spark, sf_dir)  # read by both exports
    exported = csv_export(spark, sf_dir, games)
    value = {"files": {"csv": [exported, f"{exported}/../{exported.rsplit('/', 1)[1]}"], "wiki": [f"../{wiki_export(spark, sf_dir, games).rsplit('/', 1)[1]}"], "schedule": []}, "warnings": ["CSV download failed: rate limit", "schedule pages are not fresh"]}
    publish_file(spark, f"{folder}/manifest.json", json.dumps(value))
    report = manifest.load(spark, f"{folder}/manifest.json", whole_files=False).land(f"{folder}/landed")
    kinds = F.array_join(F.array_sort(F.transform("warnings", lambda w: F.concat_ws(":", w.kind, w.severity))), ",")
    return report.select("source", "files", "repeated_files", "rows", "dated", "first_date", "last_date", kinds.alias("kinds"))


@query("a8_schedule", "SELECT CAST(series_id AS VARCHAR) AS match_id, 'b' || series_id AS event_id, CASE state WHEN 'completed' THEN 'completed' ELSE 'inProgress' END AS state, CAST(best_of AS INTEGER) AS best_of, team_a || '|' || team_b AS teams, wins_a || '-' || wins_b AS score FROM series", "series")
def a8_schedule(spark, sf_dir):
    return schedule_rows(spark, sf_dir).select("match_id", "event_id", "state", "best_of", F.array_join(F.transform("teams", lambda t: t["name"]), "|").alias("teams"), F.array_join(F.transform("teams", lambda t: t["wins"].cast("string")), "-").alias("score"))


def schedule_rows(spark, sf_dir):
    """Every series as two events of a schedule, the second a minute later, over three page shapes."""
    path = new_path(spark, "schedule")
    series = write_back(S.resolve_series(contest_games(spark, sf_dir)), f"{path}/series")  # read by each of the three shapes
    team = lambda x: F.struct(F.col(f"team_{x}").alias("id"), F.col(f"team_{x}").alias("name"), F.lower(F.substring(f"team_{x}", 1, 3)).alias("code"), F.struct(F.col(f"wins_{x}").cast("int").alias("gameWins"), F.when(F.col("winner") == F.col(f"team_{x}"), "win").when(F.col("winner").isNotNull(), "loss").alias("outcome")).alias("result"))
    match = F.struct(F.col("series_id").cast("string").alias("id"), F.struct(F.lit("bestOf").alias("type"), F.col("best_of").cast("int").alias("count")).alias("strategy"), F.array(team("a"), team("b")).alias("teams"))
    state = F.when(F.col("state") == "completed", "completed").otherwise("inProgress")
    event = lambda mark, minute, st: F.struct(F.concat(F.lit(mark), F.col("series_id").cast("string")).alias("id"), F.lit("match").alias("type"), st.alias("state"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(f"T10:0{minute}:00Z")).alias("startTime"), F.struct(F.lower("league_a").alias("slug")).alias("league"), match.alias("match"))
    both = F.array(event("a", 0, F.lit("unstarted")), event("b", 1, state))
    month = F.month("date")
    top = series.where(month <= 4).select(both.alias("events"))
    paged = series.where((month > 4) & (month <= 8)).select(F.array(F.struct(both.alias("events"))).alias("schedulePages"))
    deep = series.where(month > 8).select(F.struct(F.struct(both.alias("events")).alias("schedule")).alias("data"))
    for i, part in enumerate((top, paged, deep)):
        part.write.json(f"{path}/{i}", compression="gzip")
    return importers.schedule(spark, [f"{path}/{i}" for i in range(3)], whole_files=False)


@query(
    "a14_ranking_entries",
    "SELECT series_id AS document, t.team, t.rank FROM series, (SELECT unnest([1, 2]) AS k) x, LATERAL (SELECT CASE x.k WHEN 1 THEN team_a ELSE team_b END AS team, CAST(x.k AS BIGINT) AS rank) t WHERE tier <> 'qualifier'",
    "series",
)
def a14_ranking_entries(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    entry = lambda x, i: F.struct(F.col(f"team_{x}").alias("team"), F.lit(i).alias("rank"), F.struct(F.lit("ignored").alias("team"), F.lit(9).alias("rank")).alias("before"))
    both = F.array(entry("a", 1), entry("b", 2))
    text = F.when(F.col("tier") == "qualifier", "not json {").when(F.col("tier") == "worlds-playoffs", F.to_json(F.struct(both.alias("rankings")))).when(F.col("tier") == "msi-bracket", F.to_json(F.struct(F.struct(F.lit(1).alias("v"), F.struct(both.alias("list")).alias("deep")).alias("data")))).otherwise(F.to_json(both))
    return importers.ranked_entries(rows.select(F.col("series_id").alias("document"), text.alias("text")), "text")


@query("a6_player_ids", "SELECT s_suppkey, CASE WHEN s_nationkey = 1 THEN 'id-' || min(s_suppkey) OVER (PARTITION BY lower(s_name)) WHEN s_nationkey % 2 = 0 THEN 'given-' || s_suppkey ELSE 'unresolved:' || sha256(lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '|' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g'))) END AS player_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def a6_player_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    aliases = rows.where("s_nationkey = 1").select(F.concat(F.lit(" "), F.upper("s_name")).alias("alias"), F.concat(F.lit("id-"), F.col("s_suppkey").cast("string")).alias("id"))
    players = rows.select("s_suppkey", F.col("s_name").alias("name"), F.col("n_name").alias("team"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("given-"), F.col("s_suppkey").cast("string"))).otherwise(" ").alias("given"))
    return X.resolved_ids(players, aliases).select("s_suppkey", "player_id")


@query("a9_merged_teams", "SELECT series_id, CASE WHEN tier = 'qualifier' THEN 'd-' || team_a ELSE team_a END AS id, team_a AS name, left(team_a, 6) AS code FROM series UNION ALL SELECT series_id, team_b, team_b, 'x' FROM series", "series")
def a9_merged_teams(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    none = F.lit(None).cast("string")
    schedule = rows.select("series_id", F.when(F.col("tier") != "qualifier", F.col("team_a")).alias("id"), F.col("team_a").alias("name"), none.alias("code")).union(rows.select("series_id", "team_b", "team_b", F.lit("x")))
    details = rows.select("series_id", F.when(F.col("tier") == "qualifier", F.concat(F.lit("d-"), F.col("team_a"))).otherwise(F.col("team_a")).alias("id"), F.lower("team_a").alias("name"), F.substring("team_a", 1, 6).alias("code"))
    return X.merge_teams(schedule, details, "series_id")


@query("a12_unique_events", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1")
def a12_unique_events(spark, sf_dir):
    window = table(spark, sf_dir, "events").where("ts >= '2024-01-02' and ts < '2024-01-20'").withColumn("day", F.to_date("ts"))
    return X.first_of(window, ["user_id", "event_type", "day"], ["event_id"]).select("event_id", "user_id", "event_type")


# Reconciliation.


@query("e4_gap_fill", ", s AS (SELECT series_id, date, least(team_a, team_b) AS x, greatest(team_a, team_b) AS y, coalesce(winner, 'tie') AS w, best_of FROM series), p AS (SELECT * FROM s WHERE best_of = 5) SELECT series_id, false AS filled FROM p UNION ALL SELECT series_id, true FROM s WHERE best_of <> 5 AND (date, x, y, w) NOT IN (SELECT (date, x, y, w) FROM p)", "series")
def e4_gap_fill(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", "date", F.least("team_a", "team_b").alias("first_team"), F.greatest("team_a", "team_b").alias("second_team"), F.coalesce("winner", F.lit("tie")).alias("result"), "best_of")
    return X.gap_fill(rows.where("best_of = 5"), rows.where("best_of <> 5"), ["date", "first_team", "second_team", "result"]).select("series_id", "filled")


@query("e5_enriched_duplicates", f", k AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY date, team_a, team_b ORDER BY series_id) = 1), o AS (SELECT date, team_a, team_b, max(best_of) AS other_best_of, max(struct_pack(k := {case('tier', R.EVENT_K, '14')}, tier := tier)) AS other FROM series WHERE series_id NOT IN (SELECT series_id FROM k) GROUP BY ALL) SELECT k.series_id, greatest(k.best_of, coalesce(other_best_of, k.best_of)) AS best_of, CASE WHEN other.k > {case('k.tier', R.EVENT_K, '14')} THEN other.tier ELSE k.tier END AS tier FROM k LEFT JOIN o ON k.date = o.date AND k.team_a = o.team_a AND k.team_b = o.team_b", "series")
def e5_enriched_duplicates(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    kept = X.first_of(rows, ["date", "team_a", "team_b"], ["series_id"])
    dropped = rows.join(kept.select("series_id"), "series_id", "left_anti")
    return X.enrich_from_duplicates(kept, dropped, ["date", "team_a", "team_b"]).select("series_id", "best_of", "tier")


@query("e6_by_provider", ", g AS (SELECT date, team_a, team_b, game_number, CASE WHEN side_a IS NULL THEN 'wiki' ELSE 'csv' END AS provider, lpad(CAST(series_id AS VARCHAR), 12, '0') || '-' || game_number AS game_id, best_of FROM games), x AS (SELECT *, max(best_of) OVER (PARTITION BY date, team_a, team_b) AS longest FROM g) SELECT date, team_a, team_b, game_number, provider, game_id, longest AS best_of FROM x QUALIFY row_number() OVER (PARTITION BY date, team_a, team_b, game_number ORDER BY CASE provider WHEN 'csv' THEN 1 ELSE 2 END, game_id) = 1")
def e6_by_provider(spark, sf_dir):
    provider = F.when(F.col("side_a").isNull(), "wiki").otherwise("csv")
    ids = F.concat_ws("-", F.lpad(F.col("series_id").cast("string"), 12, "0"), F.col("game_number").cast("string"))
    rows = contest_games(spark, sf_dir).select("date", "team_a", "team_b", "game_number", provider.alias("provider"), ids.alias("game_id"), "best_of")
    return X.by_provider(rows, ["date", "team_a", "team_b"], "game_number", {"csv": 1, "wiki": 2})


@query("e7_official_ids", ", u AS (SELECT date, least(lower(regexp_replace(team_a, '_', '')), lower(regexp_replace(team_b, '_', ''))) AS x, greatest(lower(regexp_replace(team_a, '_', '')), lower(regexp_replace(team_b, '_', ''))) AS y, count(DISTINCT series_id) AS n, min(CAST(series_id AS VARCHAR)) AS id FROM series GROUP BY ALL) SELECT s.series_id, CASE WHEN u.n = 1 THEN u.id END AS official_match_id FROM series s JOIN u ON s.date = u.date AND least(lower(regexp_replace(s.team_a, '_', '')), lower(regexp_replace(s.team_b, '_', ''))) = u.x AND greatest(lower(regexp_replace(s.team_a, '_', '')), lower(regexp_replace(s.team_b, '_', ''))) = u.y", "series")
def e7_official_ids(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", "date", "team_a", "team_b", "best_of")
    return X.enrich_from_schedule(rows, schedule_rows(spark, sf_dir)).select("series_id", "official_match_id")


_OTHER = "SELECT 'b-' || team AS id, CASE WHEN league = 'ASIA' THEN upper(team) WHEN league = 'EUROPE' THEN 'unlike ' || team ELSE NULL END AS name, CASE WHEN league <> 'AFRICA' THEN replace(team, 'NATION_', 'n') END AS code FROM records"


@query("e17_matched_rankings", f", a AS (SELECT team, team AS name, replace(team, 'NATION_', 'N') AS code FROM records), b AS ({_OTHER}), f AS (SELECT a.team, b.id, 0 AS p, 'name' AS how FROM a JOIN b ON lower(a.name) = lower(b.name) UNION ALL SELECT a.team, b.id, 1, 'code' FROM a JOIN b ON lower(a.code) = lower(b.code)), m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY team ORDER BY p, id) = 1), n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, team) = 1) SELECT a.team, n.id, n.how FROM a LEFT JOIN n ON a.team = n.team UNION ALL SELECT NULL, id, NULL FROM b WHERE id NOT IN (SELECT id FROM n)", "sides records")
def e17_matched_rankings(spark, sf_dir):
    left, right = rankings(spark, sf_dir)
    return X.match_rankings(left, right, ["name", "code"], "team", "id")


def rankings(spark, sf_dir):
    rows = records(spark, sf_dir)
    left = rows.select("team", F.col("team").alias("name"), F.replace(F.col("team"), F.lit("NATION_"), F.lit("N")).alias("code"))
    name = F.when(F.col("league") == "ASIA", F.upper("team")).when(F.col("league") == "EUROPE", F.concat(F.lit("unlike "), F.col("team")))
    right = rows.select(F.concat(F.lit("b-"), F.col("team")).alias("id"), name.alias("name"), F.when(F.col("league") != "AFRICA", F.replace(F.col("team"), F.lit("NATION_"), F.lit("n"))).alias("code"))
    return left, right


@query("m18_ranking_flags", ", a AS (SELECT team, row_number() OVER (ORDER BY rating DESC, team) AS rank FROM records), b AS (SELECT team, row_number() OVER (ORDER BY wins DESC, team) AS other_rank FROM records) SELECT a.team, rank, other_rank, rank - other_rank AS delta, abs(rank - other_rank) > CASE WHEN rank <= 2 THEN 1 ELSE 3 END AS outlier FROM a JOIN b ON a.team = b.team", "sides records")
def m18_ranking_flags(spark, sf_dir):
    rows = records(spark, sf_dir)
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "team")).cast("long")  # noqa: E731  a row a team
    both = rows.select("team", rank("rating").alias("rank"), rank("wins").alias("other_rank")).withColumn("delta", F.col("rank") - F.col("other_rank"))
    return both.withColumn("outlier", F.abs("delta") > F.when(F.col("rank") <= 2, 1).otherwise(3))


@query("i1_union_providers", "SELECT provider, count(*) AS games, count(side) AS sides, count(best_of) AS formats FROM (SELECT 'csv' AS provider, side_a AS side, NULL AS best_of FROM games WHERE side_a IS NOT NULL UNION ALL SELECT 'wiki', NULL, best_of FROM games WHERE side_a IS NULL) GROUP BY provider")
def i1_union_providers(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    a = games.where("side_a is not null").select(F.lit("csv").alias("provider"), F.col("side_a").alias("side"))
    b = games.where("side_a is null").select(F.lit("wiki").alias("provider"), "best_of")
    return a.unionByName(b, allowMissingColumns=True).groupBy("provider").agg(F.count("*").alias("games"), F.count("side").alias("sides"), F.count("best_of").alias("formats"))


@query("i2_distinct_entities", "SELECT 'team' AS kind, count(DISTINCT team) AS n FROM sides UNION ALL SELECT 'player', count(DISTINCT player) FROM games UNION ALL SELECT 'patch', count(DISTINCT patch) FROM games UNION ALL SELECT 'date', count(DISTINCT date) FROM games", "sides")
def i2_distinct_entities(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    out = games.agg(F.countDistinct("player").alias("player"), F.countDistinct("patch").alias("patch"), F.countDistinct("date").alias("date")).crossJoin(S.sides(games).agg(F.countDistinct("team").alias("team")))
    return out.unpivot([], ["team", "player", "patch", "date"], "kind", "n")


@query("i4_retained_players", ", p AS (SELECT DISTINCT season, team_a AS team, player FROM games) SELECT a.season, a.team, count(*) AS retained FROM p a JOIN p b ON b.team = a.team AND b.player = a.player AND b.season + 1 = a.season GROUP BY ALL")
def i4_retained_players(spark, sf_dir):
    rows = contest_games(spark, sf_dir).select("season", F.col("team_a").alias("team"), "player")
    return rows.intersect(rows.select((F.col("season") + 1).alias("season"), "team", "player")).groupBy("season", "team").agg(F.count("*").alias("retained"))


@query("i5_manifest_union", "SELECT league, min(date) AS start, max(date) AS \"end\", string_agg(DISTINCT patch, ',' ORDER BY patch) AS files FROM sides GROUP BY league", "sides")
def i5_manifest_union(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir))
    half = lambda cond: rows.where(cond).groupBy("league").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.collect_set("patch").alias("files"))
    a, b = half("month(date) <= 6"), half("month(date) > 6").toDF("league", "start_b", "end_b", "files_b")
    both = a.join(b, "league", "full_outer")
    none = F.array().cast("array<string>")
    files = F.array_union(F.coalesce("files", none), F.coalesce("files_b", none))
    return both.select("league", F.least("start", "start_b").alias("start"), F.greatest("end", "end_b").alias("end"), F.array_join(F.array_sort(files), ",").alias("files"))


@query("i6_obsolete_paths", ", p AS (SELECT DISTINCT season || '/' || patch || '/' || team AS path, season FROM sides) SELECT path FROM p WHERE season < (SELECT max(season) FROM p) AND substr(path, 6) NOT IN (SELECT substr(path, 6) FROM p WHERE season = (SELECT max(season) FROM p))", "sides")
def i6_obsolete_paths(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir)).select("season", F.concat_ws("/", F.col("season").cast("string"), "patch", "team").alias("path"), F.concat_ws("/", "patch", "team").alias("name")).distinct()
    last = rows.agg(F.max("season").alias("last"))
    rows = rows.crossJoin(F.broadcast(last))
    gone = rows.where("season < last").select("name").exceptAll(rows.where("season = last").select("name")).distinct()
    return rows.where("season < last").join(gone, "name", "left_semi").select("path")


# Texts, dates and numbers.

_TEXTS = "SELECT DISTINCT '  ' || p_name || ' &amp; ' || p_brand || chr(10) || p_type || ' ' AS raw FROM part"


@query("j1_clean_names", f"SELECT raw, trim(regexp_replace(replace(raw, '&amp;', '&'), '\\s+', ' ', 'g')) AS name, lower(regexp_replace(replace(raw, '&amp;', '&'), '[^A-Za-z0-9]', '', 'g')) AS key FROM ({_TEXTS})")
def j1_clean_names(spark, sf_dir):
    rows = raw_names(spark, sf_dir)
    return rows.select("raw", N.clean_name(F.col("raw")).alias("name"), N.name_key(F.col("raw")).alias("key"))


def raw_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" &amp; "), "p_brand", F.lit("\n"), "p_type", F.lit(" ")).alias("raw")).distinct()


@query("j2_acronyms", f"SELECT raw, upper(array_to_string(list_transform(string_split(trim(regexp_replace(replace(raw, '&amp;', '&'), '\\s+', ' ', 'g')), ' '), lambda w: left(w, 1)), '')) AS code FROM ({_TEXTS})")
def j2_acronyms(spark, sf_dir):
    return raw_names(spark, sf_dir).select("raw", N.acronym(F.col("raw")).alias("code"))


@query("j3_slugs", f"SELECT raw, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ({_TEXTS})")
def j3_slugs(spark, sf_dir):
    return raw_names(spark, sf_dir).select("raw", N.slug(F.col("raw")).alias("slug"))


@query("j11_split_labels", "SELECT series_id, nullif(regexp_extract(lower(event), '\\b(winter|spring|summer|fall|autumn|split [1-3])\\b', 1), '') AS split FROM leagued", "series named leagued")
def j11_split_labels(spark, sf_dir):
    return leagued(spark, sf_dir).select("series_id", N.split_label(F.col("event")).alias("split"))


@query("j12_patch_buckets", "SELECT patch, count(*) AS games, nullif(regexp_extract(' ' || patch || '.7', '(\\d+\\.\\d+)', 1), '') AS bucket FROM games GROUP BY patch")
def j12_patch_buckets(spark, sf_dir):
    return contest_games(spark, sf_dir).groupBy("patch").agg(F.count("*").alias("games")).withColumn("bucket", N.patch_bucket(F.concat(F.lit(" "), "patch", F.lit(".7"))))


@query("j13_game_seconds", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 60 + p_size WHEN p_size % 3 = 1 THEN CAST(p_size AS BIGINT) END AS seconds FROM part")
def j13_game_seconds(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(":"), F.lpad(size.cast("string"), 2, "0"))).when(size % 3 == 1, size.cast("string")).otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", N.game_seconds(text).alias("seconds"))


@query("j14_dates", "SELECT series_id, CASE WHEN tier <> 'qualifier' THEN date END AS day, CASE WHEN tier <> 'qualifier' THEN year(date) END AS year, CASE WHEN tier <> 'qualifier' THEN date + 1 END AS next_day, CASE WHEN tier <> 'qualifier' THEN DATE '2001-12-31' - date END AS days_left FROM series", "series")
def j14_dates(spark, sf_dir):
    iso = F.date_format("date", "yyyy-MM-dd")
    text = F.when(F.col("tier") == "qualifier", "soon").when(F.col("tier") == "msi-bracket", F.date_format("date", "M/d/yyyy")).when(F.col("tier") == "worlds-playoffs", F.concat(F.lit(" "), iso, F.lit("T23:59:00Z"))).otherwise(F.concat(iso, F.lit(" 00:10:00")))
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", N.day_of(text).alias("day"))
    return rows.select("series_id", "day", F.year("day").cast("long").alias("year"), F.date_add("day", 1).alias("next_day"), F.datediff(F.lit("2001-12-31").cast("date"), "day").cast("long").alias("days_left"))


@query("j15_refresh_windows", ", c AS (SELECT league, max(date) AS covered FROM sides WHERE tier = 'qualifier' GROUP BY league), n AS (SELECT max(date) AS now FROM sides) SELECT league, covered - 2 AS start, now AS \"end\" FROM c, n UNION ALL SELECT 'none', now - 30, now FROM n", "sides")
def j15_refresh_windows(spark, sf_dir):
    rows = S.sides(contest_games(spark, sf_dir))
    now = rows.agg(F.max("date").alias("now"))
    covered = rows.where("tier = 'qualifier'").groupBy("league").agg(F.max("date").alias("covered"))
    covered = covered.unionByName(spark.createDataFrame([("none", None)], "league string, covered date")).crossJoin(F.broadcast(now))
    return covered.select("league", I.refresh_window(F.col("covered"), F.col("now")).alias("w")).select("league", "w.*")


@query("j16_recency_weights", f"SELECT date, count(*) AS games, {r4('0.62::DOUBLE + 0.38::DOUBLE * exp(-((SELECT max(date) FROM games) - date) / 180.0::DOUBLE)', 3)} AS recency, {r4('least(1.0::DOUBLE, greatest(0.0::DOUBLE, (count(*) - 2.0::DOUBLE) / 20.0::DOUBLE))')} AS volume FROM games GROUP BY date")
def j16_recency_weights(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    days = games.groupBy("date").agg(F.count("*").alias("games")).crossJoin(F.broadcast(games.agg(F.max("date").alias("last"))))
    return days.select("date", "games", half_up(0.62 + 0.38 * F.exp(-F.datediff("last", "date") / 180.0), 3).alias("recency"), half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("games") - 2.0) / 20.0)), 4).alias("volume"))


def _game(a: str, b: str) -> str:
    return r4(f"0.5::DOUBLE + ({r4(f'1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (({b}) - ({a})) / 360.0::DOUBLE))')} - 0.5::DOUBLE) * {r4('greatest(0.45::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - sqrt(60.0::DOUBLE * 60.0::DOUBLE + 60.0::DOUBLE * 60.0::DOUBLE) / 620.0::DOUBLE))')}")


_BAND = "sqrt(60.0::DOUBLE * 60.0::DOUBLE + 60.0::DOUBLE * 60.0::DOUBLE) / 2.0::DOUBLE"


@query("j19_matchup_bands", f"SELECT a.team AS team_a, b.team AS team_b, {_game('a.rating', 'b.rating')} AS neutral, {_game('a.rating + 6.0::DOUBLE', 'b.rating - 6.0::DOUBLE')} AS blue, {_game('a.rating - 6.0::DOUBLE', 'b.rating + 6.0::DOUBLE')} AS red, {_game('a.rating - ' + _BAND, 'b.rating + ' + _BAND)} AS low, {_game('a.rating + ' + _BAND, 'b.rating - ' + _BAND)} AS high FROM records a JOIN records b ON a.team <> b.team", "sides records")
def j19_matchup_bands(spark, sf_dir):
    # All pairs of teams are the result asked for; teams are a dimension of fixed size.
    rated = records(spark, sf_dir).select("team", "rating")
    pairs = rated.toDF("team_a", "a").crossJoin(F.broadcast(rated.toDF("team_b", "b"))).where("team_a <> team_b")
    return pairs.select("team_a", "team_b", *[p.alias(n) for n, p in R.matchup_bands(F.col("a"), F.col("b"), F.lit(60.0), F.lit(60.0), side_edge=12.0).items()])


_LIVE = " UNION ALL ".join(f"SELECT team, {a} AS need_a, {b} AS need_b, p FROM chance" for a in (1, 2, 3) for b in (1, 2, 3))


@query("j20_live_states", f", chance AS (SELECT team, {r4('wins / CAST(games AS DOUBLE)')} AS p FROM records), st AS ({_LIVE}) SELECT team, need_a, need_b, {r4('pow(p, need_a) * (1.0::DOUBLE + CASE WHEN need_b > 1 THEN need_a * (1.0::DOUBLE - p) ELSE 0.0::DOUBLE END + CASE WHEN need_b > 2 THEN need_a * (need_a + 1) / 2.0::DOUBLE * pow(1.0::DOUBLE - p, 2) ELSE 0.0::DOUBLE END)')} AS chance FROM st", "sides records")
def j20_live_states(spark, sf_dir):
    rows = records(spark, sf_dir).select("team", half_up(F.col("wins") / F.col("games"), 4).alias("p"))
    states = F.explode(F.array(*[F.struct(F.lit(a).alias("need_a"), F.lit(b).alias("need_b")) for a in (1, 2, 3) for b in (1, 2, 3)]))
    rows = rows.select("team", "p", states.alias("s")).select("team", "p", "s.*")
    return rows.select("team", "need_a", "need_b", R.live_series_probability(F.col("p"), F.col("need_a"), F.col("need_b")).alias("chance"))


@query("j21_multipliers", f"SELECT team, {r4('least(1.75::DOUBLE, greatest(0.75::DOUBLE, 1.0::DOUBLE + (140.0::DOUBLE - least(120, wins) - 50.0::DOUBLE) / 100.0::DOUBLE))')} AS uncertain, {r4('least(1.35::DOUBLE, greatest(1.0::DOUBLE, 1.0::DOUBLE + (1.0::DOUBLE - wins / CAST(games AS DOUBLE)) * 0.5::DOUBLE))')} AS volatile, {r4('greatest(20.0::DOUBLE, 140.0::DOUBLE - least(120, wins) - 5.0::DOUBLE - 8.0::DOUBLE)')} AS next_uncertainty FROM records", "sides records")
def j21_multipliers(spark, sf_dir):
    u = 140.0 - F.least(F.lit(120), F.col("wins"))
    return records(spark, sf_dir).select("team", half_up(R.uncertainty_multiplier(u), 4).alias("uncertain"), half_up(R.volatility_multiplier(F.col("wins") / F.col("games")), 4).alias("volatile"), half_up(R.next_uncertainty(u, F.lit(34.0), F.lit(False)), 4).alias("next_uncertainty"))


_INDEX = r4("least(0.25::DOUBLE, greatest(-0.25::DOUBLE, (ka - kb) / greatest(ka + kb, 1.0::DOUBLE) * 0.14::DOUBLE + (ga - gb) / greatest(ga + gb, 1.0::DOUBLE) * 0.72::DOUBLE + (wins_a - wins_b) / greatest(wins_a + wins_b, 1.0::DOUBLE) * 0.14::DOUBLE))", 6)


@query("j24_execution", f", x AS (SELECT series_id, winner = team_a AS y, CAST(CAST(kills AS DECIMAL(18,2)) AS DOUBLE) AS k, CAST(gold AS DECIMAL(18,2)) AS g FROM games), t AS (SELECT series_id, CAST(coalesce(sum(CAST(k AS DECIMAL(18,2))) FILTER (y), 0) AS DOUBLE) AS ka, CAST(coalesce(sum(CAST(k AS DECIMAL(18,2))) FILTER (NOT y), 0) AS DOUBLE) AS kb, CAST(coalesce(sum(g) FILTER (y), 0) AS DOUBLE) AS ga, CAST(coalesce(sum(g) FILTER (NOT y), 0) AS DOUBLE) AS gb FROM x GROUP BY series_id), i AS (SELECT t.series_id, winner = team_a AS won, {_INDEX} AS execution FROM t JOIN series s ON t.series_id = s.series_id) SELECT series_id, execution, {r4('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.75::DOUBLE * CASE WHEN won THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.25::DOUBLE * (0.5::DOUBLE + execution)))', 6)} AS soft FROM i", "series")
def j24_execution(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    first = F.col("winner") == F.col("team_a")
    pick = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c).cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    rows = games.groupBy("series_id").agg(pick("kills", first).alias("ka"), pick("kills", ~first).alias("kb"), pick("gold", first).alias("ga"), pick("gold", ~first).alias("gb"))
    rows = rows.join(S.resolve_series(games).select("series_id", "wins_a", "wins_b", "winner", "team_a"), "series_id")
    index = R.execution_index(*[F.col(c) for c in ("ka", "kb", "ga", "gb", "wins_a", "wins_b")])
    rows = rows.withColumn("execution", half_up(index, 6))
    return rows.select("series_id", "execution", half_up(R.soft_outcome(F.coalesce(F.col("winner") == F.col("team_a"), F.lit(False)), F.col("execution")), 6).alias("soft"))


@query("j31_sorted_rosters", ", f AS (SELECT series_id, role, player, row_number() OVER (PARTITION BY series_id, role ORDER BY game_number) AS r FROM games) SELECT series_id, string_agg(['top', 'jungle', 'mid', 'bot', 'support'][role + 1] || ':' || player, ',' ORDER BY role) AS roster FROM f WHERE r = 1 GROUP BY series_id")
def j31_sorted_rosters(spark, sf_dir):
    roles = ("top", "jungle", "mid", "bot", "support")
    name = F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("role") + 1).cast("int"))
    rows = contest_games(spark, sf_dir).withColumn("role_name", name)
    # At most five games a series.
    players = rows.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("game_number", F.col("role_name").alias("role"), "player"))), lambda x: F.struct(x.role.alias("role"), x.player.alias("player"))).alias("players"))
    ordered = N.sorted_roles(F.col("players"), list(roles))
    return players.select("series_id", F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p.role, p.player.cast("string"))), ",").alias("roster"))


@query("j32_stable_json", "SELECT series_id, sha256(CAST(json_object('best_of', best_of, 'team_a', team_a, 'winner', winner) AS VARCHAR)) AS digest FROM series", "series")
def j32_stable_json(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    return rows.select("series_id", F.sha2(F.to_json(F.struct(*sorted(("winner", "team_a", "best_of"))), {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("j33_json_paths", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def j33_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("j34_scope_keys", "SELECT DISTINCT season, tier, league_a AS region, season || '__' || tier || '__' || replace(replace(league_a, ' ', '+'), '_', '%5F') AS key, league_a AS decoded FROM games")
def j34_scope_keys(spark, sf_dir):
    rows = contest_games(spark, sf_dir).select("season", "tier", F.col("league_a").alias("region")).distinct()
    rows = rows.withColumn("key", N.scope_key(F.col("season"), F.col("tier"), F.col("region")))
    return rows.withColumn("decoded", F.get(N.scope_parts(F.col("key")), 2))


# Incremental runs.


def inventories(spark, sf_dir):
    """The inventory of all series as it was before the last season, and now: late results change the ones that are undecided."""
    rows = S.resolve_series(contest_games(spark, sf_dir)).withColumn("league", F.col("league_a"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("season").alias("last"))))
    digest = lambda w: F.sha2(F.concat_ws("|", F.col("series_id").cast("string"), F.coalesce(w, F.lit("open"))), 256).alias("digest")
    undecided = F.when(F.col("state") == "completed", F.col("winner"))
    old = rows.where("season < last").select("series_id", "date", "league", digest(undecided))
    return old, rows.select("series_id", "date", "league", digest(F.col("winner"))), rows


_INVENTORY = ", o AS (SELECT series_id, date, league_a AS league, sha256(series_id || '|' || coalesce(CASE WHEN state = 'completed' THEN winner END, 'open')) AS digest FROM series WHERE season < (SELECT max(season) FROM series)), n AS (SELECT series_id, date, league_a AS league, sha256(series_id || '|' || coalesce(winner, 'open')) AS digest FROM series)"


@query("a16_mutations", f"{_INVENTORY} SELECT n.series_id, n.date, n.league, CASE WHEN o.series_id IS NULL THEN 'add' ELSE 'replace' END AS action FROM n LEFT JOIN o ON o.series_id = n.series_id WHERE o.series_id IS NULL OR o.digest <> n.digest", "series")
def a16_mutations(spark, sf_dir):
    old, new, _ = inventories(spark, sf_dir)
    return I.mutations(old, new, ["series_id"], ["date", "league"]).select("series_id", "date", "league", "action")


@query("a17_applied_delta", f"{_INVENTORY} SELECT series_id, digest FROM n", "series")
def a17_applied_delta(spark, sf_dir):
    old, new, _ = inventories(spark, sf_dir)
    changes = I.mutations(old, new, ["series_id"], ["date", "league"])
    if not I.refused(old, changes, ["series_id"]).isEmpty():
        raise ValueError("changes do not fit the inventory")
    fresh = changes.where("action <> 'delete'").select("series_id", "date", "league", F.col("after").alias("digest"))
    return X.apply_changes(old, fresh, changes.where("action = 'delete'"), ["series_id"]).select("series_id", "digest")


@query("a18_rebaseline", "SELECT season, league_a AS league, count(DISTINCT date) AS deltas, count(*) AS rows, count(DISTINCT date) > 32 AS due FROM series GROUP BY ALL", "series")
def a18_rebaseline(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("season", F.col("league_a").alias("league"), F.col("date").alias("delta_no"))
    return I.rebaseline(rows, ["season", "league"])


@query("k7_fingerprint", f"{_INVENTORY}, f AS (SELECT league || '=' || sha256(CAST(count(*) AS VARCHAR) || '|' || CAST(max(series_id) AS VARCHAR)) AS line FROM n GROUP BY league) SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS files FROM f", "series")
def k7_fingerprint(spark, sf_dir):
    _, new, _ = inventories(spark, sf_dir)
    files = new.groupBy(F.col("league").alias("path")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.max("series_id").cast("string")), 256).alias("digest"))
    return I.fingerprint(files)


PARTS["changed"] = "changed AS (SELECT min(date) AS first FROM series WHERE state <> 'completed' AND winner IS NOT NULL AND season < (SELECT max(season) FROM series))"


@query("k12_safe_checkpoint", ", c AS (SELECT max(date) AS boundary, season * 100 + month(date) AS id, count(*) AS series FROM series GROUP BY season * 100 + month(date)) SELECT boundary, sha256(CAST(id AS VARCHAR)) AS digest FROM c, changed WHERE boundary < coalesce(first, DATE '9999-01-01') AND series >= 2 ORDER BY boundary DESC LIMIT 1", "series changed")
def k12_safe_checkpoint(spark, sf_dir):
    _, _, rows = inventories(spark, sf_dir)
    changed = rows.where("state <> 'completed' and winner is not null and season < last").agg(F.min("date").alias("first")).first()["first"]
    number = F.col("season") * 100 + F.month("date")
    catalog = rows.groupBy(number.alias("id")).agg(F.max("date").alias("boundary"), F.count("*").alias("series")).select("boundary", F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("series") >= 2).alias("proven"))
    return I.safe_checkpoint(catalog, F.lit(changed)).select("boundary", "digest")


def _surface(x: str) -> str:
    return f"CASE {x} WHEN 'AFRICA' THEN 'sourced-player' WHEN 'AMERICA' THEN 'dss-team' WHEN 'ASIA' THEN 'dss-region' WHEN 'EUROPE' THEN 'roster-era' END"


@query(
    "k14_proof_bundle",
    f"""{_INVENTORY}, b AS (SELECT {_surface('n.league')} AS surface, n.series_id, n.date, o.digest IS NOT NULL AND o.digest = n.digest AS same FROM n LEFT JOIN o ON o.series_id = n.series_id),
f AS (SELECT surface, min(date) FILTER (NOT same) AS replay_from, count(*) FILTER (NOT same) AS changed, count(*) AS rows FROM b WHERE surface IS NOT NULL GROUP BY surface),
p AS (SELECT f.surface, count(*) AS proven FROM b JOIN f ON b.surface = f.surface WHERE replay_from IS NULL OR b.date < replay_from GROUP BY f.surface)
SELECT f.surface, f.rows, coalesce(p.proven, 0) AS proven, f.changed, f.replay_from, false AS missing FROM f LEFT JOIN p ON f.surface = p.surface UNION ALL SELECT 'player-resume', 0, 0, 0, NULL, true""",
    "series",
)
def k14_proof_bundle(spark, sf_dir):
    old, new, _ = inventories(spark, sf_dir)
    names = {"AFRICA": "sourced-player", "AMERICA": "dss-team", "ASIA": "dss-region", "EUROPE": "roster-era"}
    surface = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("league")]
    pick = lambda df: df.select(surface.alias("surface"), "series_id", "date", "digest")
    return I.proof_bundle(pick(old), pick(new), ["series_id"])


@query("k15_event_contracts", """, e AS (SELECT season, tier AS event, min(date) AS s, max(date) AS t, count(DISTINCT team_a) AS teams FROM series GROUP BY ALL), x AS (SELECT max(season) AS m FROM series), a AS (SELECT event, month(s) * 100 + day(s) AS s, month(t) * 100 + day(t) AS t, teams FROM e, x WHERE season = m - 1), b AS (SELECT event, month(s) * 100 + day(s) AS s, month(t) * 100 + day(t) AS t, teams FROM e, x WHERE season = m)
SELECT coalesce(a.event, b.event) AS event, CASE WHEN a.event IS NULL THEN 'added' WHEN b.event IS NULL THEN 'removed' WHEN a.s <> b.s OR a.t <> b.t THEN 'calendar' ELSE 'structure' END AS what FROM a FULL JOIN b ON a.event = b.event WHERE a.event IS NULL OR b.event IS NULL OR a.s <> b.s OR a.t <> b.t OR a.teams <> b.teams""", "series")
def k15_event_contracts(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    day = lambda c: F.month(c) * 100 + F.dayofmonth(c)
    events = rows.groupBy("season", F.col("tier").alias("event")).agg(F.min("date").alias("s"), F.max("date").alias("t"), F.countDistinct("team_a").alias("teams")).select("season", "event", day("s").alias("start"), day("t").alias("end"), "teams")
    events = events.crossJoin(F.broadcast(rows.agg(F.max("season").alias("last"))))
    return I.contract_diff(events.where("season = last - 1"), events.where("season = last"))


@query("k2_completion_evidence", "SELECT CAST(series_id AS VARCHAR) AS match_id, state = 'completed' AND (winner IS NOT NULL OR greatest(wins_a, wins_b) > best_of // 2 OR wins_a + wins_b >= best_of) AS completed, array_to_string(list_filter([CASE WHEN state <> 'completed' THEN 'not-terminal' END, CASE WHEN NOT (winner IS NOT NULL OR greatest(wins_a, wins_b) > best_of // 2 OR wins_a + wins_b >= best_of) THEN 'no-result' END], lambda x: x IS NOT NULL), ',') AS reasons FROM series", "series")
def k2_completion_evidence(spark, sf_dir):
    return completion.with_evidence(schedule_rows(spark, sf_dir)).select("match_id", "completed", F.array_join("reasons", ",").alias("reasons"))


@query("k4_retry_times", "SELECT event_id, ts + to_minutes(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN 15 WHEN event_id % 7 = 2 THEN 30 WHEN event_id % 7 = 3 THEN 60 WHEN event_id % 7 = 4 THEN 120 ELSE 360 END) AS next_try FROM events")
def k4_retry_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", completion.next_try((F.col("event_id") % 7).cast("int"), F.col("ts").cast("timestamp_ntz")).alias("next_try"))


@query("p30_prefix_faults", ", r AS (SELECT series_id, CASE WHEN tier = 'qualifier' THEN NULL ELSE date END AS date, CASE WHEN best_of = 1 THEN 'bad' ELSE sha256(CAST(series_id AS VARCHAR)) END AS digest FROM series) SELECT series_id, CASE WHEN date IS NULL THEN 'no-date' ELSE 'bad-digest' END AS fault FROM r WHERE date IS NULL OR digest = 'bad'", "series")
def p30_prefix_faults(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", F.when(F.col("tier") != "qualifier", F.col("date")).alias("date"), F.when(F.col("best_of") == 1, "bad").otherwise(F.sha2(F.col("series_id").cast("string"), 256)).alias("digest"))
    return I.prefix_faults(rows, ["series_id"])


@query("p43_document_faults", "SELECT series_id, CASE WHEN tier = 'qualifier' THEN 'not-json' ELSE 'missing:winner' END AS fault FROM series WHERE tier = 'qualifier' OR winner IS NULL", "series")
def p43_document_faults(spark, sf_dir):
    text = F.when(F.col("tier") == "qualifier", "{oops").otherwise(F.to_json(F.struct("team_a", "winner", "best_of")))
    rows = S.resolve_series(contest_games(spark, sf_dir)).select("series_id", text.alias("document"))
    return I.document_faults(rows, "team_a string, winner string, best_of long", "series_id", "document")


@query("p44_index_faults", ", i AS (SELECT season, tier, count(*) AS listed FROM series GROUP BY ALL), s AS (SELECT season, tier, count(*) AS present FROM series WHERE best_of > 1 GROUP BY ALL) SELECT i.season, i.tier, listed, present, CASE WHEN present IS NULL THEN 'no-shard' ELSE 'other-count' END AS what FROM i LEFT JOIN s ON i.season = s.season AND i.tier = s.tier WHERE present IS NULL OR present <> listed", "series")
def p44_index_faults(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    index = rows.groupBy("season", "tier").agg(F.count("*").alias("rows"))
    return I.index_faults(index, rows.where("best_of > 1"), ["season", "tier"])


@query("p47_kept_partitions", ", d AS (SELECT season, player, count(*) AS games FROM games GROUP BY ALL), f AS (SELECT season, player, games * 2 AS games FROM d WHERE season = (SELECT max(season) FROM d)) SELECT * FROM f UNION ALL SELECT * FROM d WHERE season < (SELECT max(season) FROM d)")
def p47_kept_partitions(spark, sf_dir):
    rows = contest_games(spark, sf_dir).groupBy("season", "player").agg(F.count("*").alias("games"))
    last = rows.agg(F.max("season").alias("last"))
    fresh = rows.crossJoin(F.broadcast(last)).where("season = last").select("season", "player", (F.col("games") * 2).alias("games"))
    return I.keep_partitions(rows, fresh, ["season"])


@query("p5_series_order", "SELECT g.series_id, g.game_number, row_number() OVER (PARTITION BY g.date ORDER BY CASE WHEN g.side_a IS NOT NULL THEN g.game_number END NULLS FIRST, g.series_id, g.game_number) AS place, s.state FROM games g JOIN series s ON g.series_id = s.series_id", "series")
def p5_series_order(spark, sf_dir):
    games = contest_games(spark, sf_dir)
    order = Window.partitionBy("date").orderBy(F.when(F.col("side_a").isNotNull(), F.col("game_number")).asc_nulls_first(), "series_id", "game_number")
    rows = games.select("series_id", "game_number", F.row_number().over(order).cast("long").alias("place"))
    return rows.join(S.resolve_series(games).select("series_id", "state"), "series_id")


@query("p10_event_keys", f"SELECT event, count(*) AS series, max({case('tier', T.TIER_RANKS)}) AS strongest FROM (SELECT coalesce(CASE WHEN regexp_matches(event, '\\b(?:msi|mid-season invitational)\\b', 'i') AND NOT regexp_matches(event, '\\broad to msi\\b', 'i') THEN 'msi:' || season WHEN regexp_matches(event, '\\b(?:worlds|wlds|world championship)\\b', 'i') THEN 'worlds:' || season END, season || '~' || event) AS event, tier FROM named) GROUP BY event", "series named")
def p10_event_keys(spark, sf_dir):
    family = T.tournament_family(F.col("event"))
    season = F.col("season").cast("string")
    key = F.coalesce(F.when(family.isNotNull(), F.concat_ws(":", family, season)), F.concat_ws("~", season, "event"))
    return named_series(spark, sf_dir).groupBy(key.alias("event")).agg(F.count("*").alias("series"), F.max(T.tier_rank(F.col("tier"))).alias("strongest"))


@query("p12_league_adjustments", f"SELECT team, {r4('rating + ({0} - 1500.0::DOUBLE) - rating'.format(case('league', {'AFRICA': 1300.0, 'AMERICA': 1450.0, 'ASIA': 1500.0, 'EUROPE': 1450.0, 'MIDDLE EAST': 1375.0})), 0)} AS adjustment, {r4('(rating - 1500.0::DOUBLE) * 3.25::DOUBLE', 4)} AS published_delta, {r4('(rating - 1500.0::DOUBLE) * 3.25::DOUBLE / 3.25::DOUBLE', 4)} AS internal_delta FROM records", "sides records")
def p12_league_adjustments(spark, sf_dir):
    prior = F.create_map(*[F.lit(x) for p in {"AFRICA": 1300.0, "AMERICA": 1450.0, "ASIA": 1500.0, "EUROPE": 1450.0, "MIDDLE EAST": 1375.0}.items() for x in p])[F.col("league")]
    delta = F.col("rating") - 1500.0
    return records(spark, sf_dir).select("team", R.league_adjustment(F.col("rating"), prior).alias("adjustment"), half_up(R.public_delta(delta), 4).alias("published_delta"), half_up(R.internal_delta(R.public_delta(delta)), 4).alias("internal_delta"))


@query("p15_variant_fallbacks", "SELECT series_id, coalesce(CASE WHEN best_of = 5 THEN 0.9::DOUBLE END, CASE WHEN best_of = 3 THEN 0.8::DOUBLE END, 0.5::DOUBLE) AS p, best_of >= 3 AS present, 1.0::DOUBLE AS live, 0.0::DOUBLE AS off FROM series", "series")
def p15_variant_fallbacks(spark, sf_dir):
    variants = F.create_map(F.lit("player"), F.when(F.col("best_of") == 5, 0.9), F.lit("whole"), F.when(F.col("best_of") == 3, 0.8))
    rows = S.resolve_series(contest_games(spark, sf_dir))
    return rows.select("series_id", R.variant_probability(variants, ["player", "whole"], F.lit(0.5)).alias("p"), R.variant_present(variants, ["player", "whole"]).alias("present"), R.feature_weight(F.lit("live"), 1.0).alias("live"), R.feature_weight(F.lit("shadow"), 1.0).alias("off"))


@query("p23_series_teams", "SELECT DISTINCT season, unnest([team_a, team_b]) AS team FROM games")
def p23_series_teams(spark, sf_dir):
    return contest_games(spark, sf_dir).select("season", F.explode(F.array("team_a", "team_b")).alias("team")).distinct()


@query("p33_team_identity", "SELECT team, regexp_replace(team, '_', ' ', 'g') AS shown, lower(left(team, 1)) || regexp_extract(team, '(\\d+)$', 1) AS code FROM records", "sides records")
def p33_team_identity(spark, sf_dir):
    rows = records(spark, sf_dir).select("team")
    identity = rows.select(F.upper("team").alias("name"), F.trim(F.regexp_replace("team", "_", " ")).alias("shown"), F.concat(F.lower(F.substring("team", 1, 1)), F.regexp_extract("team", r"(\d+)$", 1)).alias("code"), F.lit(0).alias("i"))
    return X.dimension_lookup(rows, "team", identity, ["name"], ["i"]).select("team", "shown", "code")


@query("p38_region_series", "SELECT league, date, series_id, wins_a || '-' || wins_b AS score, row_number() OVER (PARTITION BY league ORDER BY date DESC, series_id DESC) AS back FROM (SELECT *, league_a AS league FROM series UNION ALL SELECT *, league_b FROM series WHERE league_b <> league_a) QUALIFY back <= 15", "series")
def p38_region_series(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    each = rows.select(F.explode(F.array_distinct(F.array("league_a", "league_b"))).alias("league"), "date", "series_id", F.concat_ws("-", F.col("wins_a").cast("string"), F.col("wins_b").cast("string")).alias("score"))
    back = F.row_number().over(Window.partitionBy("league").orderBy(F.col("date").desc(), F.col("series_id").desc())).cast("long")
    return each.withColumn("back", back).where("back <= 15")


@query("p39_impact_signs", ", m AS (SELECT team, series_id, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, CAST(sum(CASE WHEN won THEN 10 ELSE -10 END) AS BIGINT) AS delta FROM points GROUP BY ALL) SELECT team, count(*) AS matches, count(*) FILTER (sign(wins - losses) = sign(delta)) AS consistent FROM m GROUP BY team", "sides points")
def p39_impact_signs(spark, sf_dir):
    rows = points(spark, sf_dir).groupBy("team", "series_id").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.sum(F.when(F.col("won"), 10).otherwise(-10)).alias("delta"))
    return rows.groupBy("team").agg(F.count("*").alias("matches"), F.count_if(F.signum((F.col("wins") - F.col("losses")).cast("double")) == F.signum(F.col("delta").cast("double"))).alias("consistent"))


@query("p42_default_scopes", ", s AS (SELECT CAST(season AS VARCHAR) AS scope, count(*) AS series FROM series GROUP BY season UNION ALL SELECT 'All', count(*) FROM series) SELECT scope, series, row_number() OVER (ORDER BY CASE WHEN scope = 'All' THEN 1 ELSE 0 END, scope DESC) AS place FROM s", "series")
def p42_default_scopes(spark, sf_dir):
    rows = S.resolve_series(contest_games(spark, sf_dir))
    scopes = rows.select(F.explode(F.array(F.col("season").cast("string"), F.lit("All"))).alias("scope")).groupBy("scope").agg(F.count("*").alias("series"))
    return scopes.withColumn("place", F.row_number().over(Window.orderBy((F.col("scope") == "All").cast("int"), F.col("scope").desc())).cast("long"))  # a row a season


@query("m17_bracket_odds")
def m17_bracket_odds(spark, sf_dir):
    """Odds of the sixteen best teams in a seeded bracket; draws are pseudo-random, so that SQL has no counterpart."""
    rows = records(spark, sf_dir).select("team", "rating", (F.row_number().over(Window.orderBy(F.col("rating").desc(), "team")) - 1).alias("slot")).where("slot < 16")
    return simulate_bracket(rows, runs=2000)



@query("k3_streamed_completions", "SELECT CAST(series_id AS VARCHAR) AS match_id FROM series WHERE state = 'completed' AND (winner IS NOT NULL OR greatest(wins_a, wins_b) > best_of // 2 OR wins_a + wins_b >= best_of)", "series")
def k3_streamed_completions(spark, sf_dir):
    """Completed matches out of a feed of pages that repeats every one of them, by a stream that runs until the feed is read."""
    pages = schedule_rows(spark, sf_dir).select("match_id", "state", F.col("at").cast("timestamp").alias("at"), "best_of", "teams")
    path = new_path(spark, "feed")
    pages = write_back(pages, f"{path}/rows")  # the schedule is parsed once, not for each repeat
    pages.write.json(f"{path}/pages", compression="gzip")
    pages.write.mode("append").json(f"{path}/pages", compression="gzip")
    found = completion.first_completions(completion.read_feed(spark, f"{path}/pages", pages.schema))
    run = found.select("match_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("match_id string").parquet(f"{path}/out")


@query("k18_shadow_parity", f"SELECT team, {r4('rating', 2)} AS rating, {r4('rating', 2)} AS resumed, true AS same FROM walk WHERE i = (SELECT max(i) FROM walk)", "series series_sides replayed_by_date")
def k18_shadow_parity(spark, sf_dir):
    """Every team's rating by a full replay and by one that resumes after half of the dates, and whether both agree."""
    from ..operators import replay

    series = S.resolve_series(contest_games(spark, sf_dir))
    middle = series.agg(F.percentile_approx(F.unix_date("date"), 0.5, 1_000_000)).first()[0]
    full, _ = replay.replay_by_date(series)
    half, _ = replay.replay_by_date(series.where(F.unix_date("date") <= middle))
    last = series.where(F.unix_date("date") <= middle).agg(F.max(F.unix_date("date"))).first()[0]
    resumed, _ = replay.replay_by_date(series, half, last)
    same = I.parity(full, resumed, ["team"], ["rating", "uncertainty"])
    both = full.select("team", half_up(F.col("rating"), 2).alias("rating")).join(resumed.select("team", half_up(F.col("rating"), 2).alias("resumed")), "team")
    return both.join(same, "team").select("team", "rating", "resumed", "same")
