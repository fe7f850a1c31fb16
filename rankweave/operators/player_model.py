"""Players by their numbers: performance against role baselines, ratings against the same role, residuals, edges and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import event_weight, lookup
from ..functions.rounding import clamp, half_up
from .deserved import exact
from .storage import new_path, write_back

#: Weights of a performance's parts, spreads of its numbers, and role baselines (damage share, gold share, KDA, vision a minute).
WIN, PARTS = 0.38, {"damage_share": (0.2, 0.12), "gold_share": (0.18, 0.1), "kda": (0.14, 4.0), "vspm": (0.1, 1.8)}
BASELINES = {
    "top": (0.23, 0.21, 3.0, 0.9),
    "jungle": (0.16, 0.18, 3.4, 1.2),
    "mid": (0.25, 0.22, 3.6, 1.0),
    "bot": (0.28, 0.25, 3.8, 0.8),
    "support": (0.08, 0.13, 3.2, 2.4),
}
#: Fixed values of ratings: start, K, scale; of leagues' baselines: anchor, slope and limits; of how much a league's signal counts.
START, K, SCALE = 100.0, 8.0, 80.0
ANCHOR, SLOPE, LOWEST, HIGHEST = 1500.0, 0.2, 50.0, 110.0
SIGNAL = {"tier-one": 1.0, "tier-two": 0.9, "tier-three": 0.65, "emerging": 0.35, "unknown": 0.25}
#: Fixed values of edges before a game: slope, soft cap, cap, share beyond it, and least coverage.
EDGE, SOFT, HARD, BEYOND, COVERAGE = 2.5, 40.0, 70.0, 0.4, 0.6
ROLE_SHARES = {"top": 0.18, "jungle": 0.22, "mid": 0.22, "bot": 0.2, "support": 0.18}
#: Fixed values of an impact: weights of objectives, awards and form, and its limits.
IMPACT, IMPACT_LOW, IMPACT_HIGH = (0.12, 0.06, 0.04), 0.7, 1.45
#: Fixed values of residuals: weights of control means, of the opponent's strength, and the score's scale and limits.
CONTROLS = {"role": 0.35, "role_league": 0.25, "role_side": 0.1, "role_patch": 0.15, "role_tier": 0.15}
PROXY, RESIDUAL_SCALE, RESIDUAL_LOW, RESIDUAL_HIGH, RESIDUAL_GAMES = 0.28, 100.0, 40.0, 160.0, 60
#: Dates, and about as many rows, that one step of the replay folds; a date is never divided.
DATES, ROWS = 256, 2_000_000


def baseline(role: Column, i: int) -> Column:
    return lookup({r: v[i] for r, v in BASELINES.items()}, role, None)


def kda(kills: Column, assists: Column, deaths: Column) -> Column:
    return (kills + assists) / F.greatest(deaths.cast("double"), F.lit(1.0))


def stat_score(value: Column, base: Column, spread: float) -> Column:
    """0.05 to 0.95 by how a number stands to its baseline; 0.5 for none."""
    return F.coalesce(clamp(0.5 + (value - base) / (2.0 * spread), 0.05, 0.95), F.lit(0.5))


def raw_performance(won: Column, stats: dict[str, Column], role: Column) -> Column:
    """A game's performance, 0 to 1: the win and four numbers against their role's baselines."""
    total = WIN * F.when(won, 1.0).otherwise(0.0)
    for i, (name, (weight, spread)) in enumerate(PARTS.items()):
        total = total + weight * stat_score(stats[name], baseline(role, i), spread)
    return half_up(clamp(total, 0.0, 1.0), 6)


def no_win_score(stats: dict[str, Column], role: Column) -> Column:
    """The numbers alone; those that are missing do not count, and null is for none at all."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for i, (name, (weight, spread)) in enumerate(PARTS.items()):
        known = stats[name].isNotNull()
        total = total + F.when(known, weight * stat_score(stats[name], baseline(role, i), spread)).otherwise(0.0)
        weights = weights + F.when(known, weight).otherwise(0.0)
    return half_up(F.when(weights > 0, total / weights), 6)


def with_scores(lines: DataFrame) -> DataFrame:
    """``lines`` (won, role, kills, assists, deaths and the shares) with ``raw`` and ``no_win``."""
    stats = {"damage_share": F.col("damage_share"), "gold_share": F.col("gold_share"), "kda": half_up(kda(F.col("kills"), F.col("assists"), F.col("deaths")), 6), "vspm": F.col("vspm")}
    return lines.withColumns({"raw": raw_performance(F.col("won"), stats, F.col("role")), "no_win": no_win_score(stats, F.col("role"))})


def matchups(lines: DataFrame, key: list[str], order: list[str], carried: tuple[str, ...] = ("player", "league", "side", "raw", "no_win")) -> DataFrame:
    """Scored lines beside their opponent of the same role, with its ``carried`` columns: of each key and role, the first with the second, the third with the fourth."""
    # The opponent is the row after or before in one window: lines are exchanged and sorted once.
    turn = Window.partitionBy(*key, "role").orderBy(*order)
    known = F.lit(True)
    for c in (*key, "role"):
        known = known & F.col(c).isNotNull()
    rows = lines.where(known).withColumn("number", F.row_number().over(turn)).withColumns({"pair": F.floor((F.col("number") - 1) / 2), "first": F.col("number") % 2 == 1})
    one = F.struct(*[F.col(c).alias(f"opponent_{c}") for c in carried])
    rows = rows.withColumns({"after": F.lead(one).over(turn), "prior": F.lag(one).over(turn)}).withColumn("other", F.when(F.col("first"), F.col("after")).otherwise(F.col("prior")))
    out = rows.where("other is not null").select("*", "other.*").drop("after", "prior", "other")
    return out.withColumn("performance", half_up(clamp(0.5 + (F.col("raw") - F.col("opponent_raw")) / 2.0, 0.0, 1.0), 6))


def fold_roles(dates: list[int]):
    """The fold of ``dates`` (days since 1970) for the players of one role: ratings as they were when each date began."""

    def fold(state, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        place = lambda x: np.floor(x * 10.0 + 0.5) / 10.0
        known = state.column("player").combine_chunks() if state.num_rows else pa.array([], pa.int64())
        names = pc.unique(pa.concat_arrays([known, *(rows.column(c).combine_chunks() for c in ("player", "opponent_player"))]))
        rating, games = np.full(len(names), START), np.zeros(len(names), "int64")
        if state.num_rows:
            at = pc.index_in(known, value_set=names).to_numpy()
            rating[at], games[at] = state.column("rating").to_numpy(), state.column("games").to_numpy()
        rows = rows.sort_by("period")
        own, other = (pc.index_in(rows.column(c), value_set=names).to_numpy() for c in ("player", "opponent_player"))
        performance, weight = rows.column("performance").to_numpy(), rows.column("weight").to_numpy()
        edges = np.searchsorted(rows.column("period").to_numpy(), [*dates, dates[-1] + 1])
        found = []
        for i, date in enumerate(dates):
            now = slice(edges[i], edges[i + 1])
            a, b = own[now], other[now]
            if not len(a):
                continue
            playing = np.unique(a)
            found.append((np.full(len(playing), date), playing, rating[playing].copy(), games[playing].copy()))
            expected = 1.0 / (1.0 + np.power(10.0, (rating[b] - rating[a]) / SCALE))
            delta = place(K * weight[now] * (performance[now] - expected))
            rating = place(rating + np.bincount(a, delta, len(names)))
            games = games + np.bincount(a, minlength=len(names))
        period, at, r, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"))
        role = (rows if rows.num_rows else state).column("role")[0]
        every = np.arange(len(names))
        return pa.table(
            {
                "role": pa.array([role.as_py()] * (len(at) + len(names)), pa.string()),
                "period": pa.concat_arrays([pa.array(period, pa.int64()), pa.nulls(len(names), pa.int64())]),
                "player": names.take(pa.array(np.concatenate([at, every]))),
                "rating": pa.array(np.concatenate([r, rating])),
                "games": pa.array(np.concatenate([n, games])),
            }
        )

    return fold


def score_date(state: DataFrame, part: DataFrame) -> DataFrame:
    """What ``fold_roles`` gives for the rows of one date, by joins and sums: no task holds a role, however many games the date has.

    Deltas are whole tenths, so their sum does not hang on its order.
    """
    names = part.select("role", F.explode(F.array("player", "opponent_player")).alias("player")).distinct()
    every = names.join(state, ["role", "player"], "left").withColumns({"rating": F.coalesce("rating", F.lit(START)), "games": F.coalesce("games", F.lit(0).cast("long"))})
    own = every.select("role", "player", F.col("rating").alias("own"))
    other = every.select("role", F.col("player").alias("opponent_player"), F.col("rating").alias("other"))
    rows = part.join(own, ["role", "player"]).join(other, ["role", "opponent_player"])
    p = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("other") - F.col("own")) / SCALE))
    tenths = F.floor(K * F.col("weight") * (F.col("performance") - p) * 10.0 + 0.5)
    moved = rows.groupBy("role", "player").agg(F.max("period").alias("period"), F.sum(tenths).alias("delta"), F.count("*").alias("n"))
    after = every.join(moved, ["role", "player"], "left")
    end = half_up(F.col("rating") + F.coalesce("delta", F.lit(0)) / 10.0, 1)
    ends = F.struct(F.lit(None).cast("long").alias("period"), end.alias("rating"), (F.col("games") + F.coalesce("n", F.lit(0))).alias("games"))
    begins = F.struct("period", "rating", "games")
    both = after.select("role", "player", F.inline(F.when(F.col("n").isNull(), F.array(ends)).otherwise(F.array(begins, ends))))
    return both.select("role", "period", "player", "rating", "games")


def steps(dates: list[tuple[int, int]]) -> list[list[int]]:
    """Dates (with their rows, ascending) in steps of DATES dates and ROWS rows at most, or of one date with more."""
    out, held = [], 0
    for date, n in dates:
        if not out or len(out[-1]) == DATES or held + n > ROWS:
            out.append([])
            held = 0
        out[-1].append(date)
        held += n
    return out


def replay_players(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings at the end, ratings that each player had when each of its dates began) from ``matchups`` with a date and tier.

    All games of a date are scored from the ratings frozen at its start. A step takes DATES dates and ROWS rows
    at most, and only the players who play in it are scored, folded by role; so a task holds ROWS rows and
    twice as many players at most, however many games and players there are. A date with more rows than that is a
    step of its own and goes by joins and sums (``score_date``). Rows without a date do not count; rows
    are compared as they are, so repeated ones count each time.
    """
    spark = pairs.sparkSession
    path = new_path(spark, "players")
    rows = pairs.where("date is not null").select(F.unix_date("date").cast("long").alias("period"), "role", "player", "opponent_player", "performance", half_up(event_weight(F.col("tier")), 6).alias("weight"))
    # Ranges come from a sample, for which the pairs would be made twice.
    rows = write_back(rows, f"{path}/pairs")
    rows = write_back(rows.repartitionByRange("period").sortWithinPartitions("period"), f"{path}/rows")
    counts = {r["period"]: r["count"] for r in rows.groupBy("period").count().collect()}  # two numbers a date
    schema = "role string, period long, player long, rating double, games long"
    state = spark.createDataFrame([], schema)
    for i, now in enumerate(steps(sorted(counts.items()))):
        part = rows.where(F.col("period").between(now[0], now[-1]))
        playing = part.select("role", F.explode(F.array("player", "opponent_player")).alias("player")).distinct()
        own = state.drop("period").join(playing, ["role", "player"], "left_semi")
        if counts[now[0]] > ROWS:
            moved = score_date(own, part)
        else:
            moved = own.groupBy("role").cogroup(part.groupBy("role")).applyInArrow(fold_roles(now), schema)
        rest = state.join(playing, ["role", "player"], "left_anti").select("role", "period", "player", "rating", "games")
        state = write_back(moved.unionByName(rest), f"{path}/states/step={i}").where("period is null")
    states = spark.read.schema(schema).parquet(f"{path}/states") if counts else spark.createDataFrame([], schema)
    return state.select("role", "player", "rating", "games"), states.where("period is not null").select("role", "period", "player", "rating", "games")


def league_baseline(league_rating: Column) -> Column:
    return half_up(clamp(START + (league_rating - ANCHOR) * SLOPE, LOWEST, HIGHEST), 1)


def published(rating: Column, base: Column, tier: Column) -> Column:
    """A rating as published: what it is above its league's baseline counts by the league's tier."""
    return half_up(base + (rating - base) * lookup(SIGNAL, tier, 0.25), 1)


def pregame_edges(rosters: DataFrame) -> DataFrame:
    """The edge of each team in each game from its players' ratings: ``rosters`` has game keys in ``game``, team, role, rating (as frozen), games, base and signal.

    Players without a game before do not count; below the least coverage of role shares there is no edge.
    """
    share = lookup(ROLE_SHARES, F.col("role"), 0.0)
    some = F.col("games") >= 1
    out = rosters.groupBy("game", "team").agg(exact(F.when(some, share).otherwise(0.0)).alias("coverage"), exact(F.when(some, share * (F.col("rating") - F.col("base")) * F.col("signal")).otherwise(0.0)).alias("edge"))
    raw = EDGE * F.col("edge")
    size = F.abs(raw)
    capped_ = F.when(size <= SOFT, raw).otherwise(F.signum(raw) * F.least(SOFT + (size - SOFT) * BEYOND, F.lit(HARD)))
    return out.select("game", "team", half_up(F.col("coverage"), 4).alias("coverage"), F.when(F.col("coverage") >= COVERAGE, half_up(capped_, 1)).otherwise(0.0).alias("edge"))


def control_means(lines: DataFrame) -> DataFrame:
    """Means of ``no_win`` at six groupings in one pass: all, by role, and by role with league, side, patch and tier."""
    sets = [[], ["role"], ["role", "league"], ["role", "side"], ["role", "patch"], ["role", "tier"]]
    by = ["role", "league", "side", "patch", "tier"]
    out = lines.where("no_win is not null").groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.count("*").alias("games"), (exact(F.col("no_win")) / F.count("*")).alias("mean"), F.grouping_id(*by).alias("grouping"))
    return out.withColumn("mean", half_up(F.col("mean"), 6))


def with_control(lines: DataFrame, prefix: str = "") -> DataFrame:
    """``lines`` with ``expected``, the mean of its control groups, weighted; a group without games counts as its role.

    ``lines`` has role, league, side, patch and tier (league and side under ``prefix``). Means are a table of groups,
    which grows with leagues and patches and not with games; they are written down once, since five joins read them.
    """
    means = write_back(control_means(lines), new_path(lines.sparkSession, "controls"), 1)
    names = {"role": ["role"], "role_league": ["role", "league"], "role_side": ["role", "side"], "role_patch": ["role", "patch"], "role_tier": ["role", "tier"]}
    ids = {"role": 0b01111, "role_league": 0b00111, "role_side": 0b01011, "role_patch": 0b01101, "role_tier": 0b01110}
    out = lines
    for name, keys in names.items():
        group = means.where(F.col("grouping") == ids[name]).select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("mean").alias(f"mean_{name}"))
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"c_{k}"))
        out = out.join(group, cond, "left").drop(*[f"c_{k}" for k in keys])
    fallback = F.coalesce("mean_role", F.lit(0.5))
    value = sum(w * F.coalesce(F.col(f"mean_{n}"), fallback) for n, w in CONTROLS.items())
    return out.withColumn("expected", half_up(value, 6)).drop(*[f"mean_{n}" for n in CONTROLS])


def residuals(pairs: DataFrame, frozen: DataFrame) -> DataFrame:
    """``pairs`` with ``expected`` and ``opponent_expected`` beside the residual of each line, given the ratings frozen for its date.

    The residual is the difference of both lines' numbers, less what their control groups and ratings led to expect.
    """
    day = F.unix_date("date").cast("long")
    own = frozen.select(F.col("period").alias("p"), F.col("player").alias("q"), F.col("rating").alias("own"))
    other = own.withColumnRenamed("own", "other")
    rows = pairs.withColumn("period", day)
    rows = rows.join(own, (F.col("period") == F.col("p")) & (F.col("player") == F.col("q"))).drop("p", "q")
    rows = rows.join(other, (F.col("period") == F.col("p")) & (F.col("opponent_player") == F.col("q"))).drop("p", "q")
    proxy = half_up((1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("other") - F.col("own")) / SCALE)) - 0.5) * PROXY, 6)
    gap = (F.col("no_win") - F.col("opponent_no_win")) - ((F.col("expected") - F.col("opponent_expected")) + proxy)
    return rows.withColumn("residual", half_up(gap, 6))


def residual_scores(rows: DataFrame) -> DataFrame:
    """Score and confidence of each player from its residuals, with its main league."""
    league = rows.groupBy("player", "league").agg(F.count("*").alias("n")).groupBy("player").agg(F.min(F.struct((-F.col("n")).alias("n"), "league")).alias("m")).select("player", F.col("m.league").alias("main_league"))
    out = rows.groupBy("player", "role").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), half_up(exact(F.col("residual")) / F.count("residual"), 3).alias("residual"), F.count("residual").alias("known"))
    score = half_up(clamp(100.0 + F.coalesce("residual", F.lit(0.0)) * RESIDUAL_SCALE, RESIDUAL_LOW, RESIDUAL_HIGH), 1)
    sure = half_up(100.0 * F.least(F.lit(1.0), F.col("games") / float(RESIDUAL_GAMES)) * (F.col("known") / F.col("games")), 1)
    return out.join(league, "player").select("player", "role", "games", "wins", "residual", score.alias("score"), sure.alias("confidence"), "main_league")


def impact(rating: Column, form: Column, objectives: Column | None = None, awards: Column | None = None) -> Column:
    """How much more than its role a player weighs, by rating, objectives, awards and form (share of recent wins)."""
    zero = F.lit(0.0)
    signal = clamp((rating - START) / 24.0, -2.0, 2.0)
    a = clamp((zero if objectives is None else objectives) + signal * 0.35, -3.0, 3.0)
    b = clamp(zero if awards is None else awards, -3.0, 3.0)
    c = clamp((form - 0.5) * 2.0, -3.0, 3.0)
    return clamp(1.0 + IMPACT[0] * a + IMPACT[1] * b + IMPACT[2] * c, IMPACT_LOW, IMPACT_HIGH)


def player_shares(rows: DataFrame, team: list[str]) -> DataFrame:
    """``rows`` (role, rating, form) with ``impact`` and each player's ``share`` of its team."""
    weight = half_up(lookup(ROLE_SHARES, F.col("role"), 0.2) * impact(F.col("rating"), F.col("form")), 6).cast("decimal(18,6)")
    out = rows.withColumns({"impact": half_up(impact(F.col("rating"), F.col("form")), 2), "share_weight": weight})
    total = F.sum("share_weight").over(Window.partitionBy(*team)).cast("double")
    return out.withColumn("share", half_up(F.col("share_weight").cast("double") / total, 4)).drop("share_weight")
