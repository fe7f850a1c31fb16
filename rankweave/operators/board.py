"""Boards of standings: sorting, pages, tiers, movers and labels, each within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import public_score
from ..functions.rounding import clamp, half_up
from .series import sides, won

#: Tiers by how far a score is below the leader's, the score that is always in the first, and the gap that a lower tier needs.
DROPS, LOWEST, ELITE, GAP = (("S", 50), ("A", 225), ("B", 400)), "C", 2250, 35
SIZES = (15, 25, 50, 80)
SORTS = {"rank": ("rank", True), "rating": ("rating", False), "wins": ("wins", False)}
HEAT_BINS = 6
#: The resume gap that counts as large, in ranks and in points.
LARGE_RANKS, LARGE_POINTS = 5, 100


def season_board(games: DataFrame, least: int = 20) -> DataFrame:
    """Standings of each season: games, wins, rating, power (the public scale, whole), eligibility and rank; eligible teams first."""
    out = sides(games).groupBy("season", "team").agg(F.min("league").alias("league"), F.count("*").alias("games"), F.count_if(won()).alias("wins"), F.max("date").alias("last_date"))
    rate = (F.col("wins") + 1.0) / (F.col("games") + 2.0)
    out = out.withColumn("rating", half_up(1500.0 + 400.0 * (rate - 0.5), 1)).withColumn("power", half_up(public_score(F.col("rating"))).cast("long")).withColumn("eligible", F.col("games") >= least)
    order = Window.partitionBy("season").orderBy(F.col("eligible").desc(), F.col("rating").desc(), "team")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def sort_board(board: DataFrame, scope: list[str], sort: str, descending: bool) -> DataFrame:
    """``board`` with ``position`` by rank, rating or wins; eligible teams first in either direction, ties by rank and name."""
    column = F.col(SORTS[sort][0])
    order = Window.partitionBy(*scope).orderBy(F.col("eligible").desc(), column.desc() if descending else column.asc(), "rank", "team")
    return board.withColumn("position", F.row_number().over(order).cast("long"))


def paged(board: DataFrame, size: int, page: int | None = None) -> DataFrame:
    """``board`` with ``page`` of ``size`` rows by rank; one page alone where it is given."""
    out = board.withColumn("page", (F.floor((F.col("rank") - 1) / size) + 1).cast("long"))
    return out if page is None else out.where(F.col("page") == page)


def _tier_no(power: Column, leader: Column) -> Column:
    drop = F.greatest(leader - power, F.lit(0))
    out = F.lit(len(DROPS))
    for i, (_, most) in reversed(list(enumerate(DROPS))):
        out = F.when(drop <= most, i).otherwise(out)
    return F.when(power >= ELITE, 0).otherwise(out)


def tiers(board: DataFrame, scope: list[str]) -> DataFrame:
    """``board`` (team, rank, power) with ``tier``.

    A team's tier is its own by the drop from the scope's leader, but no lower than that of the team ranked
    before it while less than GAP points lie between the two. So tiers run down in islands between gaps,
    and within one each team has the best tier so far: two windows instead of a walk.
    """
    by_rank = Window.partitionBy(*scope).orderBy("rank", F.col("power").desc(), "team")
    own = _tier_no(F.col("power"), F.max("power").over(Window.partitionBy(*scope)))
    gap = F.lag("power").over(by_rank) - F.col("power")
    rows = board.withColumns({"own_tier": own, "cut": F.when(gap.isNull() | (gap >= GAP), 1).otherwise(0)})
    rows = rows.withColumn("island", F.sum("cut").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*scope, "island").orderBy("rank", F.col("power").desc(), "team").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*[F.lit(n) for n, _ in DROPS], F.lit(LOWEST))
    return rows.withColumn("tier", F.get(names, F.min("own_tier").over(within))).drop("own_tier", "cut", "island")


def tier_bands(tiered: DataFrame, scope: list[str]) -> DataFrame:
    """Lowest and highest score of each tier, and how far the lowest is from the scope's leader."""
    bands = tiered.groupBy(*scope, "tier").agg(F.min("power").alias("floor"), F.max("power").alias("ceiling"), F.count("*").alias("teams"))
    leader = F.max("ceiling").over(Window.partitionBy(*scope))
    return bands.withColumn("drop_from_leader", F.greatest(leader - F.col("floor"), F.lit(0)))


def tier_pages(tiered: DataFrame, scope: list[str], size: int) -> DataFrame:
    """The page of ``size`` rows by rank that the first team of each tier is on."""
    return tiered.groupBy(*scope, "tier").agg((F.floor((F.min("rank") - 1) / size) + 1).cast("long").alias("page"))


def podium(tiered: DataFrame, scope: list[str], places: int = 3) -> DataFrame:
    """The first ``places`` of each scope."""
    order = Window.partitionBy(*scope).orderBy("rank", F.col("rating").desc(), "team")
    return tiered.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= places)


def with_movement(board: DataFrame) -> DataFrame:
    """A season board with the rank and rating of the season before and the moves since."""
    before = board.select((F.col("season") + 1).alias("season"), "team", F.col("rank").alias("previous_rank"), F.col("rating").alias("previous_rating"))
    out = board.join(before, ["season", "team"], "left")
    return out.withColumns({"moved": F.col("previous_rank") - F.col("rank"), "rating_delta": half_up(F.col("rating") - F.col("previous_rating"), 1)})


def movers(moved: DataFrame, scope: list[str]) -> DataFrame:
    """The biggest riser and faller of each scope by rating, then ranks moved."""
    kind = F.when(F.col("rating_delta") > 0, "riser").when(F.col("rating_delta") < 0, "faller")
    rows = moved.withColumn("kind", kind).where("kind is not null")
    best = Window.partitionBy(*scope, "kind").orderBy(F.abs("rating_delta").desc(), F.abs(F.coalesce("moved", F.lit(0))).desc(), "rank", "team")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select(*scope, "kind", "team", "rank", "previous_rank", "moved", "rating_delta")


def upset_headlines(wins: DataFrame, scope: list[str]) -> DataFrame:
    """The least expected win of each scope, the latest of equals: ``wins`` has team, opponent, date and p, the winner's chance."""
    order = Window.partitionBy(*scope).orderBy("p", F.col("date").desc(), "team", "opponent", "series_id")
    rows = wins.where("p < 0.5").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    text = F.concat(F.col("team"), F.lit(" beat "), F.col("opponent"), F.lit(" with a "), half_up(F.col("p") * 100.0).cast("long").cast("string"), F.lit("% pre-match chance"))
    return rows.withColumns({"score": half_up((1.0 - F.col("p")) * 100.0, 1), "headline": text})


def heat(value: Column, low: Column, high: Column) -> Column:
    """Bin 1 to 6 of a value within an extent; 3 where the extent is a point."""
    t = (value - low) / (high - low)
    return F.when(high <= low, 3).otherwise(F.least(F.lit(HEAT_BINS), F.greatest(F.lit(1), F.ceil(t * HEAT_BINS)))).cast("long")


def percent_within(value: Column, low: Column, high: Column) -> Column:
    """Whole percent of a value within an extent, 2 at least; 100 where the extent is a point."""
    return F.when(high <= low, 100.0).otherwise(clamp(half_up((value - low) / (high - low) * 100.0), 2.0, 100.0)).cast("long")


def with_heat(board: DataFrame, scope: list[str], value: str) -> DataFrame:
    """``board`` with ``heat`` and ``percent`` of ``value`` within its scope."""
    ends = board.groupBy(*scope).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    rows = board.join(F.broadcast(ends), scope) if not scope else board.join(ends, scope)
    return rows.withColumns({"heat": heat(F.col(value), F.col("low"), F.col("high")), "percent": percent_within(F.col(value), F.col("low"), F.col("high"))}).drop("low", "high")


def confidence(matches: Column, idle: Column, uncertainty: Column, basis: Column, eligible: Column, stale: Column) -> Column:
    """How sure a standing is, 0 to 99: by volume, recency, uncertainty and roster, less where a team is not eligible."""
    volume = clamp(matches / 20.0, 0.0, 1.0)
    recency = clamp(1.0 - idle / 120.0, 0.0, 1.0)
    evidence = clamp((140.0 - uncertainty) / 105.0, 0.0, 1.0)
    roster = F.when(basis == "sourced", 1.0).when(basis == "assumed-continuous", 0.55).otherwise(0.3)
    scale = F.when(eligible, 1.0).when(stale, 0.55).otherwise(0.72)
    return F.least(F.lit(99.0), half_up((0.4 * volume + 0.25 * recency + 0.25 * evidence + 0.1 * roster) * scale * 100.0)).cast("long")


def spicy_score(sure: Column, uncertainty: Column, recent: Column, eligible: Column) -> Column:
    """How much a ranking can be trusted, 0 to 100."""
    raw = sure - uncertainty * 0.35 + F.least(recent, F.lit(5)) * 3 + F.when(eligible, 10).otherwise(-15)
    return clamp(half_up(raw), 0.0, 100.0).cast("long")


def spicy_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def strongest(factors: dict[str, Column]) -> Column:
    """The name of the largest factor, the first of equals."""
    ranked = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(factors.items())]
    return F.array_max(F.array(*ranked)).getField("name")


def gap_probability(gap: Column) -> Column:
    """Chance of one game on neutral ground from a gap on the public scale."""
    return half_up(1.0 / (1.0 + F.pow(F.lit(10.0), -(gap / 3.25) / 360.0)), 4)


def resume_gap(rank_gap: Column, score_gap: Column) -> Column:
    """Whether resume or power is ahead, and whether the gap is large."""
    label = F.when(rank_gap > 0, "Resume ahead").when(rank_gap < 0, "Power ahead").otherwise("Aligned")
    large = (F.abs(rank_gap) >= LARGE_RANKS) | (F.abs(score_gap) >= LARGE_POINTS)
    return F.struct(label.alias("label"), large.alias("large"))


def outcome_label(won_: Column, p: Column) -> Column:
    """``Upset`` for a win below 0.4, ``Miss`` for a loss above 0.6; else null."""
    return F.when(won_ & (p < 0.4), "Upset").when(~won_ & (p > 0.6), "Miss")


def signed(value: Column) -> Column:
    """A whole number with its sign; 0 without."""
    whole = half_up(value).cast("long").cast("string")
    return F.when(value.isNull() | (value == 0), "0").when(value > 0, F.concat(F.lit("+"), whole)).otherwise(whole)
