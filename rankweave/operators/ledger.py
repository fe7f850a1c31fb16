"""The ledger of a replay: what every game and every batch added to a team's published rating, by component, and a second rating that moves game by game.

All series of a batch (a month, or several) are scored from the state frozen at its start. Results move the stable
rating and momentum once a series, with its last game. Execution is a channel of its own: within a series each
game is scored from where the game before left both sides, and all that a team's games gave is added at the end of
the batch. A published rating is the stable rating and momentum together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import EVENT_K, LEAGUE_K, execution_index, expected, lookup, soft_outcome, uncertainty_multiplier
from ..functions.rounding import clamp, half_up
from .replay import PERIOD_DAYS, START, UNCERTAIN, decayed
from .series import outcome, sides
from .storage import new_path, write_back

#: Shares of a series' evidence for the stable rating and for momentum, how momentum fades with each series, and its cap.
STABLE, FORM, FADE, CAP = 0.9, 0.1, 0.88, 70.0
STATE = "team string, rating double, momentum double, uncertainty double, execution double, old_rating double, old_momentum double, frozen_rating double, frozen_momentum double, frozen_uncertainty double, frozen_execution double, form double, series long"


def exact(values: Column) -> Column:
    """A sum that no order of rows changes."""
    return F.sum(values.cast("decimal(18,4)")).cast("double")


def side_rows(series: DataFrame, games: DataFrame, months: int) -> DataFrame:
    """Two rows for each series with all that its deltas hang on but the state; ``plays`` are its games in order, with both sides' soft outcome.

    ``games`` has series_id, game_number, winner and kills, gold and objectives of both sides; a series has few games.
    """
    index = execution_index(*[F.col(f"{c}_{x}").cast("double") for c in ("kills", "gold", "objectives") for x in "ab"])
    plays = games.join(series.select("series_id", "team_a"), "series_id").withColumns({"won": F.coalesce(F.col("winner") == F.col("team_a"), F.lit(False)), "index": index})
    play = F.struct("game_number", half_up(soft_outcome(F.col("won"), F.col("index")), 6).alias("a"), half_up(soft_outcome(~F.col("won"), -F.col("index")), 6).alias("b"))
    plays = plays.groupBy("series_id").agg(F.array_sort(F.collect_list(play)).alias("played"))
    rows = sides(series.where("date is not null").join(plays, "series_id", "left"))
    k = lookup(EVENT_K, F.col("tier"), 14).cast("double")
    signal = F.when(F.col("best_of") > 1, 1.0 + F.least(F.lit(0.18), 0.06 * (F.col("best_of") - F.col("games")))).otherwise(1.0)
    abroad = (F.col("league") != F.col("opponent_league")) & (lookup(LEAGUE_K, F.col("tier"), 0) > 0)
    lost = 5.0 + 8.0 * clamp((k - 12.0) / 22.0, 0.0, 1.0) + F.when(abroad, 7.0).otherwise(0.0)
    first = F.col("side_no") == 1
    own = F.transform(F.coalesce("played", F.array().cast("array<struct<game_number: long, a: double, b: double>>")), lambda g: F.struct(g.game_number.alias("game_number"), F.when(first, g.a).otherwise(g.b).alias("own"), F.when(first, g.b).otherwise(g.a).alias("other")))
    done = F.col("state") == "completed"
    return rows.select(
        "series_id",
        F.floor((F.year("date") * 12 + F.month("date") - 1) / months).cast("long").alias("period"),
        "team",
        "opponent",
        done.alias("done"),
        outcome().alias("observed"),
        k.alias("k"),
        signal.cast("double").alias("signal"),
        half_up(lost, 4).alias("lost"),
        half_up(k / F.sqrt(F.greatest(F.col("best_of"), F.lit(1)).cast("double")), 6).alias("game_k"),
        own.alias("plays"),
    )


def scored(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """``rows`` with what a series gives its team, from the frozen state (team, rating, momentum, uncertainty, execution; of each period, if it has several).

    ``steps`` has a struct for each game: the expectation of execution before it, and what it moved.
    """
    by = ["period"] if "period" in frozen.columns else []
    names = ("rating", "momentum", "uncertainty", "execution")
    own = frozen.select(*by, "team", *[F.col(c).alias(f"own_{c}") for c in names])
    other = frozen.select(*by, F.col("team").alias("opponent"), *[F.col(c).alias(f"other_{c}") for c in names if c != "uncertainty"])
    out = rows.join(own, [*by, "team"]).join(other, [*by, "opponent"])
    p = half_up(expected(F.col("own_rating") + F.col("own_momentum"), F.col("other_rating") + F.col("other_momentum")), 4)
    evidence = F.col("k") * uncertainty_multiplier(F.col("own_uncertainty")) * F.col("signal") * (F.col("observed") - p)
    given = lambda x: F.when(F.col("done"), x).otherwise(0.0)

    def chance(a: Column, b: Column) -> Column:
        return half_up(expected(a + F.col("own_momentum"), b + F.col("other_momentum")), 4)

    def play(state, game):
        at = chance(state.own, state.other)
        back = half_up(expected(state.other + F.col("other_momentum"), state.own + F.col("own_momentum")), 4)
        moved = half_up(F.col("game_k") * (game.own - at))
        answer = half_up(F.col("game_k") * (game.other - back))
        step = F.struct(game.game_number.alias("game_number"), at.alias("expected"), moved.alias("delta"))
        return F.struct((state.own + moved).alias("own"), (state.other + answer).alias("other"), F.concat(state.steps, F.array(step)).alias("steps"))

    start = F.struct(F.col("own_execution").alias("own"), F.col("other_execution").alias("other"), F.array().cast("array<struct<game_number: long, expected: double, delta: double>>").alias("steps"))
    moves = F.aggregate("plays", start, play, lambda s: s.steps)
    return out.select("series_id", "period", "team", "done", given(half_up(evidence * STABLE)).alias("stable"), given(half_up(evidence * FORM, 4)).alias("form"), given(F.col("lost")).alias("lost"), moves.alias("steps"))


def faded(momentum: Column, series: Column) -> Column:
    """What momentum loses by so many series."""
    return half_up(momentum * (F.pow(F.lit(FADE), series.cast("double")) - 1.0), 4)


def batch_step(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The state after a batch beside the one that was frozen for it."""
    moved = moves.groupBy("team").agg(exact(F.col("stable")).alias("stable"), exact(F.col("form")).alias("form"), exact(F.col("lost")).alias("lost"), F.count_if("done").alias("series"), exact(F.aggregate("steps", F.lit(0.0), lambda s, x: s + x.delta)).alias("moved"))
    out = state.join(moved, "team", "left").na.fill(0.0, ["stable", "form", "lost", "moved"]).na.fill(0, ["series"])
    momentum = half_up(clamp(F.col("momentum") + faded(F.col("momentum"), F.col("series")) + F.col("form"), -CAP, CAP), 4)
    return out.select(
        "team",
        (F.col("rating") + F.col("stable")).alias("rating"),
        momentum.alias("momentum"),
        half_up(F.greatest(F.col("uncertainty") - F.col("lost"), F.lit(20.0)), 4).alias("uncertainty"),
        (F.col("execution") + F.col("moved")).alias("execution"),
        "old_rating",
        "old_momentum",
        *[F.col(c).alias(f"frozen_{c}") for c in ("rating", "momentum", "uncertainty", "execution")],
        "form",
        "series",
    )


def replay_ledger(series: DataFrame, games: DataFrame, months: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, batches, state): the ledger's rows by game and side, those by batch and team, and all teams at the end.

    Game rows: unit, stable, form and uncertainty deltas with a completed series' last game and zero before, and
    the execution channel's expectation and delta. Batch rows: decay of the stable rating, what momentum lost at a
    new season, how it faded, and what the cap took. Stable and form deltas and those of batches add up
    to the change of the published rating. A step joins the state by team; ledger rows of all batches are then made at once.
    """
    spark = series.sparkSession
    path = new_path(spark, "ledger")
    rows = side_rows(series, games, months)
    rows.write.partitionBy("period").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    names = [c.split()[0] for c in STATE.split(", ")]
    start = rows.select("team").distinct().select("team", F.lit(START).alias("rating"), F.lit(0.0).alias("momentum"), F.lit(UNCERTAIN).alias("uncertainty"), F.lit(START).alias("execution"))
    state = write_back(start, f"{path}/start", 4)
    periods = sorted(r["period"] for r in rows.select("period").distinct().collect())  # one number a batch
    before = None
    for p in periods:
        days = 0.0 if before is None else float((p - before) * PERIOD_DAYS * months)
        fresh = before is not None and p * months // 12 != before * months // 12
        now = state.select("team", decayed(F.col("rating"), F.lit(days)).alias("rating"), (F.lit(0.0) if fresh else F.col("momentum")).alias("momentum"), "uncertainty", decayed(F.col("execution"), F.lit(days)).alias("execution"), F.col("rating").alias("old_rating"), F.col("momentum").alias("old_momentum"))
        state = write_back(batch_step(now, scored(rows.where(F.col("period") == p), now)), f"{path}/states/period={p}", 4)
        before = p
    states = spark.read.schema(f"{STATE}, period long").parquet(f"{path}/states") if periods else spark.createDataFrame([], f"{STATE}, period long")
    frozen = states.select("period", "team", *[F.col(f"frozen_{c}").alias(c) for c in ("rating", "momentum", "uncertainty", "execution")])
    moves = scored(rows, frozen)
    each = moves.withColumn("last", F.array_max(F.transform("steps", lambda s: s.game_number))).select("*", F.explode("steps").alias("s"))
    final = F.col("done") & (F.col("s.game_number") == F.col("last"))
    at_end = lambda x: F.when(final, x).otherwise(0.0)
    unit = F.when(final, "series-atomic").otherwise("series-member-no-team-update")
    by_game = each.select("series_id", F.col("s.game_number").alias("game_number"), "period", "team", unit.alias("unit"), at_end(F.col("stable")).alias("stable_delta"), at_end(F.col("form")).alias("form_delta"), at_end(-F.col("lost")).alias("uncertainty_delta"), F.col("s.expected").alias("execution_expected"), F.col("s.delta").alias("execution_delta"))
    fade = faded(F.col("frozen_momentum"), F.col("series"))
    r4 = lambda x: half_up(x, 4)
    by_batch = states.select("period", "team", r4(F.col("frozen_rating") - F.col("old_rating")).alias("decay_delta"), r4(F.col("frozen_momentum") - F.col("old_momentum")).alias("season_delta"), fade.alias("fade_delta"), r4(F.col("momentum") - F.col("frozen_momentum") - fade - F.col("form")).alias("cap_delta"), "rating", "momentum", "uncertainty", "execution", *[f"frozen_{c}" for c in names[1:5]])
    return by_game, by_batch, state.select(*names[:5])


def reconciled(by_game: DataFrame, by_batch: DataFrame, state: DataFrame) -> DataFrame:
    """For each team, the sums of all components and the published rating, which they have to lead to: ``gap`` is what is left."""
    a = by_game.groupBy("team").agg(*[exact(F.col(c)).alias(c) for c in ("stable_delta", "form_delta", "execution_delta")])
    b = by_batch.groupBy("team").agg(*[exact(F.col(c)).alias(c) for c in ("decay_delta", "season_delta", "fade_delta", "cap_delta")])
    rows = state.join(b, "team", "left").join(a, "team", "left").na.fill(0.0)
    parts = ("stable_delta", "form_delta", "decay_delta", "season_delta", "fade_delta", "cap_delta")
    total = sum((F.col(c) for c in parts), F.lit(START))
    published = F.col("rating") + F.col("momentum")
    return rows.select("team", *parts, "execution_delta", half_up(published, 4).alias("published"), half_up(F.col("execution"), 4).alias("execution"), half_up(published - total, 3).alias("gap"))
