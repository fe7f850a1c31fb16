"""Forecast scores: accuracy, Brier, log loss, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import clamp, half_up

#: Limits of probabilities inside the log loss.
LOW, HIGH = 0.001, 0.999


def _mean(value: Column, places: int = 4) -> Column:
    """Mean of values first rounded to eight places, so that it does not hang on the order of addition."""
    total = F.sum(F.round(value, 8).cast("decimal(20,8)")).cast("double")
    return half_up(total / F.count(value), places)


def forecast_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """n, accuracy (0.5 counts half), brier and log_loss of columns ``p`` (for a win) and ``y`` (1 or 0), for each group."""
    p, y = F.col("p"), F.col("y").cast("double")
    safe = clamp(p, LOW, HIGH)
    right = F.when(p == 0.5, 0.5).when((p > 0.5) == (y == 1.0), 1.0).otherwise(0.0)
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), _mean(right).alias("accuracy"), _mean((p - y) * (p - y)).alias("brier"), _mean(-(y * F.ln(safe) + (1.0 - y) * F.ln(1.0 - safe))).alias("log_loss"))


def calibration(predictions: DataFrame) -> DataFrame:
    """For each decile of the favourite's probability (50 to 90): how many, its mean and how often it won."""
    favourite = F.greatest(F.col("p"), 1.0 - F.col("p"))
    hit = F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y")).cast("double")
    rows = predictions.select(F.least(F.lit(90), F.floor(half_up(favourite * 1000.0) / 100.0) * 10).cast("long").alias("decile"), favourite.alias("f"), hit.alias("hit"))
    return rows.groupBy("decile").agg(F.count("*").alias("n"), _mean(F.col("f")).alias("mean_probability"), _mean(F.col("hit")).alias("hit_rate"))
