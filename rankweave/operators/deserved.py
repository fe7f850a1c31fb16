"""Deserved standing: what a team's completed series were worth, by the rosters that it has now, and the same of regions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import expected, lookup
from ..functions.rounding import clamp, half_up
from .series import outcome, sides

#: Weights by event tier and by format.
TIER_WEIGHT = {"worlds-playoffs": 36, "worlds-main": 28, "msi-bracket": 34, "msi-play-in": 24, "major-playoffs": 20, "regional-regular": 12, "minor-international": 18, "qualifier": 8}
FORMAT_WEIGHT = {1: 1.0, 2: 1.05, 3: 1.12, 5: 1.25}
#: Shares of result, of result and of games above expectation in a team's and in a region's series value.
TEAM_MIX, REGION_MIX = (0.5, 0.35, 0.15), (0.45, 0.4, 0.15)
#: Base, scales and priors of the score; the limits of uncertainty; the instability penalty.
BASE, RESUME, SCHEDULE, VOLUME = 1500.0, 420.0, 90.0, 120.0
LEAST_UNCERTAIN, MOST_UNCERTAIN, ERA_WEIGHT, ERA_SCALE, ROSTER_SHARE = 30.0, 140.0, 80.0, 160.0, 20.0
STABLE_FROM, INSTABILITY, CAUTION, STAGE_CAP = 0.65, 20.0, 0.35, 0.15
IDLE_STEPS = ((30, 0.0), (60, 5.0), (90, 10.0))
IDLE_MOST = 20.0
#: Stage points by kind of event and achievement.
STAGES = {"worlds": (6, 8, 10, 14), "msi": (5, 7, 9, 12), "majorRegion": (3, 5, 6, 8), "minorInternational": (3, 4, 5, 6)}
ACHIEVEMENTS = ("qualified", "firstRound", "semifinal", "final")
#: Shares of roles, of an incoming player's offsets, and of how well a move fits; how credit fades.
ROLE_SHARES = (0.18, 0.22, 0.23, 0.21, 0.16)
SKILL, RECORD, ABROAD = 0.55, 0.35, 0.1
INTEGRATION = {"sameRoleSameLeagueSameLanguage": 0.9, "sameRoleSameRegion": 0.8, "crossRegionImportSameRole": 0.7, "emergencySubstitute": 0.55, "offRolePlayer": 0.45}
BRIDGE_SCALE, BRIDGE_CAP = 80.0, 30.0
#: Fixed values of regions: scales, prior of connectivity, depth, and what seeds are expected to be worth.
REGION_RESUME, REGION_SEEDS, REGION_PRIOR, TOP_END, DEPTH, DEPTH_CAP = 380.0, 90.0, 160.0, 0.6, 0.4, 0.75
SEED_STEP = 25
SEEDS = {
    "LCK": (1660, 1625, 1590, 1555, 1525),
    "LPL": (1655, 1620, 1585, 1550, 1520),
    "LEC": (1585, 1550, 1515, 1480, 1450),
    "LCS": (1545, 1510, 1475, 1445, 1415),
    "LCP": (1535, 1505, 1475, 1445, 1415),
    "VCS": (1495, 1465, 1435, 1405, 1375),
    "PCS": (1485, 1455, 1425, 1395, 1365),
    "CBLOL": (1465, 1435, 1405, 1375, 1345),
    "International": (1500,),
}
#: Shares of roster validity, of retained pairs, and of what a roster carries over.
VALIDITY, VALIDITY_LEAST = (0.75, 0.15, 0.1), 0.05
SYNERGY = {"jungle_mid": 0.35, "bot_duo": 0.3, "top_jungle": 0.15, "shotcaller": 0.1, "coach": 0.1}
CRITICAL = {"jungle_mid": 0.4, "bot_duo": 0.3, "top_jungle": 0.15}
PROXY_SUPPORT, PROXY_JUNGLE = 0.1, 0.05
CARRYOVER = (0.2, 0.5, 0.2, 0.1)
PATCH_SIMILARITY = {"none": 1.0, "moderate": 0.85, "major": 0.7, "preseason": 0.55}
SUBSTITUTE_SERIES, SUBSTITUTE_SHARE = 3, 0.2


def exact(value: Column, places: int = 6) -> Column:
    """A sum that does not hang on the order of addition."""
    return F.sum(F.round(value, places).cast(f"decimal(28,{places})")).cast("double")


def series_expectation(p: Column, best_of: Column) -> Column:
    """Expected result of a series from the chance of a game; of two games, the chance itself."""
    def ways(n: int) -> Column:
        return sum(comb(n, w) * F.pow(p, F.lit(w)) * F.pow(1.0 - p, F.lit(n - w)) for w in range(n // 2 + 1, n + 1))

    return half_up(F.when(best_of <= 2, p).when(best_of <= 4, ways(3)).otherwise(ways(5)), 6)


def series_value(mix, observed: Column, expected_: Column, rate: Column, p: Column) -> Column:
    a, b, c = mix
    return a * (observed - 0.5) + b * (observed - expected_) + c * (rate - p)


def ledger(series: DataFrame, ratings: DataFrame) -> DataFrame:
    """Two rows for each completed series: observed and expected results, the rate of games won, weight and value.

    ``ratings`` (team, rating) has a row a team; teams without one are at 1500.
    """
    rows = sides(series.where("state = 'completed'"))
    rows = rows.join(ratings, "team", "left").join(ratings.withColumnsRenamed({"team": "opponent", "rating": "other"}), "opponent", "left")
    rows = rows.withColumns({"rating": F.coalesce("rating", F.lit(BASE)), "other": F.coalesce("other", F.lit(BASE))})
    wins = F.when(F.col("side_no") == 1, F.col("wins_a")).otherwise(F.col("wins_b"))
    rows = rows.withColumns({"observed": outcome(), "game_rate": half_up(wins / (F.col("wins_a") + F.col("wins_b")), 6), "p": half_up(expected(F.col("rating"), F.col("other")), 6)})
    rows = rows.withColumn("expected", series_expectation(F.col("p"), F.col("best_of")))
    weight = half_up(lookup(TIER_WEIGHT, F.col("tier"), 8) * lookup(FORMAT_WEIGHT, F.col("best_of"), 1.25), 4)
    value = half_up(series_value(TEAM_MIX, F.col("observed"), F.col("expected"), F.col("game_rate"), F.col("p")), 6)
    return rows.withColumns({"weight": weight, "value": value}).select("team", "opponent", "league", "opponent_league", "series_id", "date", "tier", "best_of", "observed", "game_rate", "p", "expected", "other", "weight", "value")


def team_components(entries: DataFrame) -> DataFrame:
    """Components and score of each team from ledger rows with ``validity``, the share of the roster that is still there."""
    w = F.col("weight") * F.col("validity")
    sums = entries.groupBy("team").agg(
        F.count("*").alias("series"),
        exact(F.col("value") * w).alias("value_sum"),
        exact(w).alias("era_weight"),
        exact(F.col("weight")).alias("total_weight"),
        exact((F.col("other") - BASE) / 400.0 * w).alias("schedule_sum"),
        exact(F.col("observed") - F.col("expected")).alias("wins_above"),
        exact(F.col("game_rate") - F.col("p")).alias("games_above"),
        F.max("date").alias("last_date"),
    )
    some = F.col("era_weight") > 0
    volume = F.when(some, F.sqrt(F.col("era_weight") / (F.col("era_weight") + VOLUME))).otherwise(0.0)
    rate = lambda c: F.when(some, F.col(c) / F.col("era_weight")).otherwise(0.0)
    out = sums.withColumns({"volume": half_up(volume, 6), "resume_rate": half_up(rate("value_sum"), 6), "schedule_rate": half_up(rate("schedule_sum"), 6), "validity": half_up(F.when(F.col("total_weight") > 0, F.col("era_weight") / F.col("total_weight")).otherwise(0.0), 6)})
    out = out.withColumns({"resume_points": half_up(RESUME * F.col("resume_rate") * F.col("volume"), 4), "schedule_points": half_up(SCHEDULE * F.col("schedule_rate") * F.col("volume"), 4), "instability": half_up(F.greatest(STABLE_FROM - F.col("validity"), F.lit(0.0)) * INSTABILITY, 4)})
    return out.withColumn("score", half_up(BASE + F.col("resume_points") + F.col("schedule_points") - F.col("instability"), 2))


def ranked(teams: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("score").desc(), F.col("wins_above").desc(), "team")  # a row a team
    return teams.withColumn("rank", F.row_number().over(order).cast("long"))


def inactivity(idle: Column) -> Column:
    out = F.lit(IDLE_MOST)
    for days, points in reversed(IDLE_STEPS):
        out = F.when(idle <= days, points).otherwise(out)
    return out


def uncertainty(era_weight: Column, validity: Column, idle: Column) -> Column:
    raw = LEAST_UNCERTAIN + ERA_WEIGHT * F.exp(-F.greatest(era_weight, F.lit(0.0)) / ERA_SCALE) + ROSTER_SHARE * (1.0 - validity) + inactivity(idle)
    return half_up(clamp(raw, LEAST_UNCERTAIN, MOST_UNCERTAIN), 4)


def conservative(score: Column, uncertain: Column) -> Column:
    return half_up(score - CAUTION * uncertain, 2)


def stage_points(kind: Column, achievement: Column) -> Column:
    """Points of an achievement (0 to 3, in the order of ACHIEVEMENTS) at a kind of event."""
    out = F.lit(None).cast("int")
    for name, points in STAGES.items():
        out = F.when(kind == name, F.get(F.array(*[F.lit(p) for p in points]), achievement)).otherwise(out)
    return out


def capped(points: Column, resume: Column, share: float = STAGE_CAP) -> Column:
    """Stage points within a share of the resume's; none where there is no resume."""
    cap = F.abs(resume) * share
    return F.greatest(F.least(points, cap), -cap)


def player_asset(skill: Column, record: Column, abroad: Column) -> Column:
    return SKILL * skill + RECORD * record + ABROAD * abroad


def bridge_credit(raw: Column, era_weight: Column, integration: Column) -> Column:
    """What incoming players add to a team, less the more it has played with them."""
    return half_up(clamp(raw * integration * F.exp(-F.greatest(era_weight, F.lit(0.0)) / BRIDGE_SCALE), -BRIDGE_CAP, BRIDGE_CAP), 4)


def seed_strength(region: Column, seed: Column) -> Column:
    """What a region's n-th seed is worth; beyond the list, a step less for each seed; null for no seed."""
    out = F.lit(None).cast("int")
    for name, values in SEEDS.items():
        listed = F.get(F.array(*[F.lit(v) for v in values]), seed - 1)
        beyond = values[-1] - (seed - len(values)) * SEED_STEP
        out = F.when(region == name, F.when(seed <= len(values), listed).otherwise(beyond)).otherwise(out)
    return F.when(seed >= 1, out)


def region_scores(entries: DataFrame, teams: DataFrame, priors: DataFrame) -> DataFrame:
    """Score of each region from ledger rows of series abroad (region, validity, seed_expected) and its teams (region, score).

    A region's resume and seeds count by how much it has played abroad; the rest is its prior (region, prior).
    """
    w = F.col("weight") * F.col("validity")
    value = series_value(REGION_MIX, F.col("observed"), F.col("expected"), F.col("game_rate"), F.col("p"))
    sums = entries.groupBy("region").agg(F.count("*").alias("series"), exact(w).alias("w"), exact(value * w).alias("value_sum"), exact(F.coalesce(F.col("observed") - F.col("seed_expected"), F.lit(0.0)) * w).alias("seed_sum"), exact(F.col("observed") - F.col("expected")).alias("wins_above"))
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.col("score").desc(), "team"))
    residual = F.col("score") - BASE
    top = teams.withColumn("r", best).where("r <= 4").groupBy("region").agg((exact(F.when(F.col("r") <= 2, residual)) / F.count_if(F.col("r") <= 2)).alias("top_end"), (exact(residual) / F.count("*")).alias("depth"))
    out = priors.join(sums, "region", "left").join(top, "region", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = zero("w") > 0
    out = out.withColumns({"connectivity": half_up(F.when(some, F.col("w") / (F.col("w") + REGION_PRIOR)).otherwise(0.0), 6), "resume_rate": half_up(F.when(some, F.col("value_sum") / F.col("w")).otherwise(0.0), 6), "seed_rate": half_up(F.when(some, F.col("seed_sum") / F.col("w")).otherwise(0.0), 6)})
    depth = (TOP_END * zero("top_end") + DEPTH * zero("depth")) * F.least(F.col("connectivity"), F.lit(DEPTH_CAP))
    raw = BASE + REGION_RESUME * F.col("resume_rate") * F.col("connectivity") + REGION_SEEDS * F.col("seed_rate") * F.col("connectivity") + depth
    score = half_up(F.col("connectivity") * half_up(raw, 4) + (1.0 - F.col("connectivity")) * F.col("prior"), 2)
    out = out.withColumns({"raw": half_up(raw, 4), "score": score})
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "region")).cast("long")).select("region", F.coalesce("series", F.lit(0)).alias("series"), "connectivity", "resume_rate", "seed_rate", "raw", "score", "rank")


ROLE_NAMES = ("top", "jungle", "mid", "bot", "support")


def rosters_by_date(games: DataFrame) -> DataFrame:
    """The last player of each role that a team (team_a) fielded on a date, and those of its date before."""
    at = F.struct("series_id", "game_number")
    now = [F.max_by(F.when(F.col("role") == i, F.col("player")), F.when(F.col("role") == i, at)).alias(r) for i, r in enumerate(ROLE_NAMES)]
    return _with_before(games.groupBy(F.col("team_a").alias("team"), "date").agg(*now))


def rosters_of_series(series: DataFrame) -> DataFrame:
    """``rosters_by_date`` from series that have the last player of each role, ``last_0`` to ``last_4`` (null: none)."""
    now = [F.max_by(f"last_{i}", F.when(F.col(f"last_{i}").isNotNull(), F.col("series_id"))).alias(r) for i, r in enumerate(ROLE_NAMES)]
    return _with_before(series.groupBy(F.col("team_a").alias("team"), "date").agg(*now))


def _with_before(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("team").orderBy("date")
    return rows.withColumns({f"{r}_before": F.lag(r).over(w) for r in ROLE_NAMES})


def with_continuity(rosters: DataFrame) -> DataFrame:
    """``rosters`` with what each kept from the one before: retained contribution, synergy, critical pairs, carryover and validity."""
    same = {r: F.coalesce(F.col(r) == F.col(f"{r}_before"), F.lit(False)) for r in ROLE_NAMES}
    pairs = {"jungle_mid": same["jungle"] & same["mid"], "bot_duo": same["bot"] & same["support"], "top_jungle": same["top"] & same["jungle"]}
    one = lambda b: F.when(b, 1.0).otherwise(0.0)
    now = F.array_compact(F.array(*ROLE_NAMES))
    before = F.array_compact(F.array(*[f"{r}_before" for r in ROLE_NAMES]))
    full = (F.size(now) == 5) & (F.size(before) == 5)
    retained = sum(ROLE_SHARES[i] * one(F.array_contains(now, F.col(f"{r}_before"))) for i, r in enumerate(ROLE_NAMES))
    counted = F.when(F.size(before) > 0, F.size(F.array_intersect(now, before)) / F.size(before)).otherwise(0.0)
    critical = sum(CRITICAL[k] * one(pairs[k]) for k in CRITICAL) + PROXY_SUPPORT * one(same["support"]) + PROXY_JUNGLE * one(same["jungle"])
    # Nobody is named as the caller here, so synergy is the share of players kept.
    out = rosters.withColumns({"retained": half_up(F.when(full, F.coalesce(retained, F.lit(0.0))).otherwise(0.0), 4), "synergy": half_up(counted, 4), "critical": half_up(critical, 4)})
    a, b, c, d = CARRYOVER
    x, y, z = VALIDITY
    carry = a * 1.0 + b * F.col("retained") + c * F.col("synergy") + d * F.col("critical")
    valid = F.greatest(F.least(x * F.col("retained") + y * F.col("synergy") + z * 1.0, F.lit(1.0)), F.lit(VALIDITY_LEAST))
    return out.withColumns({"carryover": half_up(carry, 4), "validity": half_up(valid, 4)})


def substitutes(games: DataFrame) -> DataFrame:
    """Players of each team and season, and whether they begin a new roster era: by series played or share of games."""
    rows = games.groupBy(F.col("team_a").alias("team"), "season", "player").agg(F.countDistinct("series_id").alias("series"), F.count("*").alias("games"))
    share = half_up(F.col("games") / F.sum("games").over(Window.partitionBy("team", "season")), 4)
    return rows.withColumn("share", share).withColumn("era", (F.col("series") >= SUBSTITUTE_SERIES) | (F.col("share") >= SUBSTITUTE_SHARE))


def public_comparison(standings: DataFrame, teams: DataFrame) -> DataFrame:
    """Standings (team, rank, rating, eligible) beside deserved ones (team, rank, score, validity): gaps of ranks and points, and how a team stands."""
    other = teams.select("team", F.col("rank").alias("deserved_rank"), "score", "validity", "wins_above")
    rows = standings.join(other, "team", "left")
    label = F.when(F.col("deserved_rank").isNull(), "no-resume").when(F.col("eligible"), "eligible").otherwise("provisional")
    return rows.select("team", "rank", "deserved_rank", (F.col("rank") - F.col("deserved_rank")).alias("rank_gap"), half_up(F.col("score") - F.col("rating")).alias("score_gap"), half_up(F.col("validity"), 3).alias("validity"), half_up(F.col("wins_above"), 2).alias("wins_above"), label.alias("eligibility"))
