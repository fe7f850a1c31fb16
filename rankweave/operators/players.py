"""Players: appearances, shares, performance and resume credit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import clamp, half_up


def performance(games: DataFrame) -> DataFrame:
    """A row for each player and game: its kills and gold against the mean of its role, as a score between 0 and 1.

    Role means are five rows that are broadcast; every game counts alike.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count("*")
    means = games.groupBy("role").agg(half_up(exact("kills"), 4).alias("mean_kills"), half_up(exact("gold"), 4).alias("mean_gold"))
    rows = games.join(F.broadcast(means), "role")
    raw = 0.5 + 0.25 * (F.col("kills") / F.col("mean_kills") - 1.0) + 0.25 * (F.col("gold") / F.col("mean_gold") - 1.0)
    return rows.select("series_id", "game_number", "date", "season", "team_a", "player", "role", "winner", "tier", half_up(clamp(raw, 0.0, 1.0), 4).alias("score"))


def diagnostics(games: DataFrame) -> DataFrame:
    """Games, wins, mean score and spread of each player."""
    rows = performance(games)
    mean = F.sum(F.col("score").cast("decimal(18,4)")).cast("double") / F.count("*")
    return rows.groupBy("player", "role").agg(F.count("*").alias("games"), F.count_if(F.col("winner") == F.col("team_a")).alias("wins"), half_up(mean, 4).alias("score"), F.max("score").alias("best"), F.min("score").alias("worst"))


def contribution_shares(games: DataFrame) -> DataFrame:
    """Each player's share of its team's score over all games."""
    rows = performance(games).groupBy(F.col("team_a").alias("team"), "player").agg(F.sum(F.col("score").cast("decimal(18,4)")).alias("raw"))
    total = F.sum("raw").over(Window.partitionBy("team"))
    return rows.select("team", "player", half_up(F.when(total > 0, F.col("raw").cast("double") / total.cast("double")).otherwise(0.0), 4).alias("share"))


def resume_credit(games: DataFrame) -> DataFrame:
    """Credit of each player by career, season and international events: one for a win, less one for a loss."""
    value = F.when(F.col("winner") == F.col("team_a"), 1).otherwise(-1)
    abroad = F.col("tier").isin("worlds-playoffs", "msi-bracket")
    out = games.groupBy("player", "season").agg(F.sum(value).alias("season_credit"), F.coalesce(F.sum(F.when(abroad, value)), F.lit(0)).alias("international_credit"))
    return out.withColumn("career_credit", F.sum("season_credit").over(Window.partitionBy("player").orderBy("season").rowsBetween(Window.unboundedPreceding, 0)))


def roster_continuity(games: DataFrame) -> DataFrame:
    """Of each team's date: the share of its players that also played on its date before; null for the first."""
    rosters = games.groupBy(F.col("team_a").alias("team"), "date").agg(F.sort_array(F.collect_set("player")).alias("players"))
    before = F.lag("players").over(Window.partitionBy("team").orderBy("date"))
    return rosters.withColumn("before", before).select("team", "date", F.size("players").cast("long").alias("players"), half_up(F.size(F.array_intersect("players", "before")) / F.size("players"), 4).alias("continuity"))


def role_power(games: DataFrame, least: int = 20) -> DataFrame:
    """Players ranked in their role by mean score, those with ``least`` games."""
    rows = diagnostics(games).where(F.col("games") >= least)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.col("score").desc(), "player")).cast("long"))
