"""Regions: resume of a league from its cross-league series, depth and connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import effective_league
from ..functions.rounding import half_up
from .series import outcome, sides

#: Fixed value: where leagues start.
PRIOR = 1500.0


def region_resumes(series: DataFrame, records: DataFrame) -> DataFrame:
    """For each league: cross-league series, points, the score they give, shrunken by their number, mean of its top four teams, and rank."""
    abroad = sides(series.where("state = 'completed' and league_a <> league_b"))
    played = abroad.groupBy("league").agg(F.count("*").alias("series"), F.sum(outcome().cast("decimal(18,1)")).cast("double").alias("points"))
    n = F.col("series").cast("double")
    raw = PRIOR + 400.0 * (F.col("points") / n - 0.5)
    score = half_up(effective_league(F.lit(PRIOR), raw, n), 2)
    top = records.withColumn("r", F.row_number().over(Window.partitionBy("league").orderBy(F.col("rating").desc(), "team"))).where("r <= 4")
    depth = top.groupBy("league").agg(half_up(F.sum(F.col("rating").cast("decimal(18,1)")).cast("double") / F.count("*"), 2).alias("top4"))
    out = played.join(depth, "league").select("league", "series", "points", score.alias("score"), "top4")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "league")).cast("long"))


def head_to_head(series: DataFrame) -> DataFrame:
    """Latest meeting and balance of every pair of teams that met, by name."""
    first = F.least("team_a", "team_b")
    value = F.when(F.col("winner").isNull(), 0).when(F.col("winner") == first, 1).otherwise(-1)
    return series.groupBy(first.alias("first_team"), F.greatest("team_a", "team_b").alias("second_team")).agg(F.count("*").alias("meetings"), F.sum(value).alias("balance"), F.max("date").alias("latest"), F.max_by("winner", F.struct("date", "series_id")).alias("last_winner"))
