"""Deserved standing: what completed series were worth against expectation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import expected, lookup
from ..functions.rounding import half_up
from .series import outcome, sides

#: Weight by event tier and by format; scale and reliability of the score.
TIER_WEIGHT = {"worlds-playoffs": 36, "worlds-main": 28, "msi-bracket": 34, "msi-play-in": 24, "major-playoffs": 20, "regional-regular": 12, "minor-international": 18, "qualifier": 8}
FORMAT_WEIGHT = {1: 1.0, 2: 1.05, 3: 1.12, 5: 1.25}
BASE, SCALE, RELIABILITY = 1500.0, 420.0, 120.0


def series_ledger(series: DataFrame, ratings: DataFrame) -> DataFrame:
    """Two rows for each completed series: observed and expected result and the series' weight.

    ``ratings`` (team, rating) is a row a team and is broadcast by the optimizer where it is small.
    """
    rows = sides(series.where("state = 'completed'"))
    rows = rows.join(ratings, "team").join(ratings.withColumnsRenamed({"team": "opponent", "rating": "other"}), "opponent")
    weight = lookup(TIER_WEIGHT, F.col("tier"), 8) * lookup(FORMAT_WEIGHT, F.col("best_of"), 1.25)
    return rows.select("team", "opponent", "series_id", "date", outcome().alias("observed"), half_up(expected(F.col("rating"), F.col("other")), 4).alias("expected"), weight.alias("weight"))


def resume_scores(series: DataFrame, ratings: DataFrame) -> DataFrame:
    """Series, score and rank of each team; scores are 1500 and 420 for each weighted point above expectation, less where evidence is thin."""
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(20,6)")).cast("double")
    sums = series_ledger(series, ratings).groupBy("team").agg(F.count("*").alias("series"), exact(F.col("weight") * (F.col("observed") - F.col("expected"))).alias("value"), exact(F.col("weight")).alias("w"))
    score = half_up(BASE + SCALE * F.col("value") / F.col("w") * F.sqrt(F.col("w") / (F.col("w") + RELIABILITY)), 1)
    return sums.select("team", "series", score.alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "team")).cast("long"))
