"""Chronological replay of ratings without look-ahead: ``replay_by_date`` by UTC date, ``replay`` by month.

A period's series are scored from the state frozen at its start; all deltas of a team are summed and applied
together. The state is a table (team, rating, uncertainty), joined on team at any size; every step writes it,
so that a replay can resume from any period. Steps depend on each other by nature; within a step all series
are scored in parallel. By month, a step is a period. By date, a step folds ``DATES`` dates in one task, which
holds the state and the step's series summed up by what sets their delta; scoring is parallel again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import EVENT_K, LEAGUE_K, expected, lookup, uncertainty_multiplier
from ..functions.rounding import clamp, half_up
from .series import outcome, sides
from .storage import new_path, write_back

#: Start of ratings and uncertainty, the stable share of evidence, and how offsets decay with days.
START, UNCERTAIN, STABLE, KEEP, FADE, FADE_DAYS = 1500.0, 140.0, 0.9, 0.62, 0.38, 180.0
PERIOD_DAYS = 30
#: Dates that one step of the replay by date folds.
DATES = 128


def with_period(series: DataFrame) -> DataFrame:
    """``series`` with ``period``, the number of their month."""
    return series.withColumn("period", (F.year("date") * 12 + F.month("date") - 1).cast("long"))


def decayed(rating, days):
    keep = F.when(days > 0, KEEP + FADE * F.exp(-days / FADE_DAYS)).otherwise(1.0)
    return half_up(START + (rating - START) * keep, 4)


def evidence(series: DataFrame) -> DataFrame:
    """Two rows for each completed series, with all that a delta depends on but the state: observed, k, signal, and what uncertainty loses."""
    rows = sides(series.where("state = 'completed'"))
    k = lookup(EVENT_K, F.col("tier"), 14).cast("double")
    signal = F.when(F.col("best_of") > 1, 1.0 + F.least(F.lit(0.18), 0.06 * (F.col("best_of") - F.col("games")))).otherwise(1.0)
    rows = rows.withColumns({"observed": outcome(), "k": k, "signal": signal.cast("double")})
    abroad = (F.col("league") != F.col("opponent_league")) & (lookup(LEAGUE_K, F.col("tier"), 0) > 0)
    lost = 5.0 + 8.0 * clamp((F.col("k") - 12.0) / 22.0, 0.0, 1.0) + F.when(abroad, 7.0).otherwise(0.0)
    return rows.withColumn("lost", half_up(lost, 4))


def score_period(series: DataFrame, state: DataFrame) -> DataFrame:
    """Two rows for each completed series, from the frozen ``state`` (of each period, if it has several): p, observed, delta, and what uncertainty loses."""
    by = ["period"] if "period" in state.columns else []
    own = state.select(*by, "team", F.col("rating").alias("own"), F.col("uncertainty").alias("own_u"))
    other = state.select(*by, F.col("team").alias("opponent"), F.col("rating").alias("other"))
    rows = evidence(series).join(own, [*by, "team"]).join(other, [*by, "opponent"])
    rows = rows.withColumn("p", half_up(expected(F.col("own"), F.col("other")), 4))
    delta = half_up(F.col("k") * uncertainty_multiplier(F.col("own_u")) * F.col("signal") * STABLE * (F.col("observed") - F.col("p")))
    return rows.select("series_id", "period", "date", "team", "opponent", "p", "observed", delta.alias("delta"), "lost")


def step(state: DataFrame, scored: DataFrame) -> DataFrame:
    """The state after a period, with the ratings that were ``frozen`` for it; uncertainty ends at 20 at least."""
    moved = scored.groupBy("team").agg(F.sum("delta").alias("delta"), F.sum(F.col("lost").cast("decimal(18,4)")).cast("double").alias("lost"))
    out = state.join(moved, "team", "left")
    after = half_up(F.greatest(F.col("uncertainty") - F.coalesce("lost", F.lit(0.0)), F.lit(20.0)), 4)
    return out.select("team", (F.col("rating") + F.coalesce("delta", F.lit(0.0))).alias("rating"), after.alias("uncertainty"), F.col("rating").alias("frozen"), F.col("uncertainty").alias("frozen_uncertainty"))


def with_new_teams(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """``state`` with the teams of ``rows`` that are new to it, at their start."""
    teams = rows.select(F.explode(F.array("team_a", "team_b")).alias("team")).distinct()
    fresh = teams.select("team", F.lit(START).alias("rating"), F.lit(UNCERTAIN).alias("uncertainty"))
    return fresh if state is None else state.select("team", "rating", "uncertainty").unionByName(fresh.join(state, "team", "left_anti"))


def replay(series: DataFrame, state: DataFrame | None = None, after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(state at the end, scored rows of all periods) of ``series`` (from ``resolve_series``).

    With ``state`` and ``after``, replay resumes behind that period from its state, and gives what a full
    replay would. Teams that are new to the state start at 1500.
    """
    spark = series.sparkSession
    rows = with_period(series)
    path = new_path(spark, "replay")
    rows.write.partitionBy("period").parquet(f"{path}/series")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/series")
    state = write_back(with_new_teams(rows, state), f"{path}/start", 4)
    schema = step(state, score_period(rows.limit(0), state)).schema
    periods = sorted(r["period"] for r in rows.select("period").distinct().collect())  # one number a month
    fresh_periods = [p for p in periods if after is None or p > after]
    for period in fresh_periods:
        days = 0 if after is None else (period - after) * PERIOD_DAYS
        state = state.select("team", decayed(F.col("rating"), F.lit(float(days))).alias("rating"), "uncertainty")
        state = write_back(step(state, score_period(rows.where(F.col("period") == period), state)), f"{path}/states/period={period}", 4)
        after = period
    # All periods are scored again at once, each from the ratings that were frozen for it.
    schema = schema.add("period", "long")
    states = spark.read.schema(schema).parquet(f"{path}/states") if fresh_periods else spark.createDataFrame([], schema)
    frozen = states.select("period", "team", F.col("frozen").alias("rating"), F.col("frozen_uncertainty").alias("uncertainty"))
    return state.select("team", "rating", "uncertainty"), score_period(rows, frozen)


def fold_dates(dates: list[int], before: int | None):
    """The fold of ``dates`` (days since 1970, ascending) that follow date ``before``: (state, evidence) as Arrow tables to states.

    A row is a team that plays on a date, with its state frozen for that date; null dates have the state at the end.
    """

    def fold(state, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        round_to = lambda x, scale: np.floor(x * scale + 0.5) / scale
        names = state["team"].combine_chunks()
        rating, uncertainty = state["rating"].to_numpy().copy(), state["uncertainty"].to_numpy().copy()
        rows = rows.sort_by("period")
        own, other = (pc.index_in(rows[c], value_set=names).to_numpy() for c in ("team", "opponent"))
        k, signal, observed, lost, n = (rows[c].to_numpy() for c in ("k", "signal", "observed", "lost", "n"))
        lost = np.round(lost * 1e4) * n
        edges = np.searchsorted(rows["period"].to_numpy(), [*dates, dates[-1] + 1])
        found, at, previous = [], [], before
        for i, date in enumerate(dates):
            if previous is not None and date > previous:
                rating = round_to(START + (rating - START) * (KEEP + FADE * np.exp(-(date - previous) / FADE_DAYS)), 1e4)
            previous = date
            own_now = slice(edges[i], edges[i + 1])
            a, b = own[own_now], other[own_now]
            if not len(a):
                continue
            playing = np.unique(a)
            found.append((playing, rating[playing], uncertainty[playing]))
            at.append(np.full(len(playing), date, "int64"))
            p = round_to(1.0 / (1.0 + np.power(10.0, (rating[b] - rating[a]) / 400.0)), 1e4)
            multiplier = np.clip(1.0 + (uncertainty[a] - 50.0) / 100.0, 0.75, 1.75)
            delta = np.floor(k[own_now] * multiplier * signal[own_now] * STABLE * (observed[own_now] - p) + 0.5) * n[own_now]
            rating = rating + np.bincount(a, delta, len(names))
            uncertainty = round_to(np.maximum(uncertainty - np.bincount(a, lost[own_now], len(names)) / 1e4, 20.0), 1e4)
        found.append((np.arange(len(names)), rating, uncertainty))
        at = pa.concat_arrays([*map(pa.array, at), pa.nulls(len(names), pa.int64())])
        team, rating, uncertainty = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"period": at, "team": names.take(pa.array(team)), "rating": rating, "uncertainty": uncertainty})

    return fold


def replay_by_date(series: DataFrame, state: DataFrame | None = None, after: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``replay``, but all series of a UTC date are scored from the state frozen at its start, and decay has the real gap in days.

    ``period`` and ``after`` are days since 1970; every date of ``series`` is one, whether a series is completed on it or not.
    """
    spark = series.sparkSession
    path = new_path(spark, "replay")
    rows = write_back(series.withColumn("period", F.unix_date("date").cast("long")), f"{path}/series")
    state = write_back(with_new_teams(rows, state), f"{path}/start", 4)
    seen = sorted(r["period"] for r in rows.where("period is not null").select("period").distinct().collect())  # one number a date
    dates = [d for d in seen if after is None or d > after]
    # Series of a date with equal evidence have equal deltas, so a pair of teams has few rows a date at any size.
    by = ["period", "team", "opponent", "k", "signal", "observed", "lost"]
    summed = evidence(rows).where("team is not null and opponent is not null").groupBy(*by).agg(F.count("*").alias("n"))
    summed = write_back(summed.repartitionByRange("period").sortWithinPartitions("period"), f"{path}/summed")
    schema = "period long, team string, rating double, uncertainty double"
    for i in range(0, len(dates), DATES):
        now = dates[i : i + DATES]
        part = summed.where(F.col("period").between(now[0], now[-1]))
        one = F.lit(0).alias("one")
        folded = state.select("team", "rating", "uncertainty").groupBy(one).cogroup(part.groupBy(one)).applyInArrow(fold_dates(now, after), schema)
        state = write_back(folded, f"{path}/states/step={i}").where("period is null")
        after = now[-1]
    states = spark.read.schema(schema).parquet(f"{path}/states") if dates else spark.createDataFrame([], schema)
    return state.select("team", "rating", "uncertainty"), score_period(rows, states.where("period is not null"))
