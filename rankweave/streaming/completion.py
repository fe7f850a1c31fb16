"""Completed matches out of a polled schedule feed, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Minutes between tries of a pending match, then every six hours.
RETRY_MINUTES = (15, 30, 60, 120)
LATER_MINUTES = 360


def with_evidence(events: DataFrame) -> DataFrame:
    """``events`` (state, teams with wins and outcome, best_of) with ``completed`` and ``reasons`` why not."""
    wins = F.transform("teams", lambda t: F.coalesce(t.wins, F.lit(0)))
    decided = F.exists("teams", lambda t: F.coalesce(t.outcome == "win", F.lit(False))) | (F.array_max(wins) > F.floor(F.coalesce("best_of", F.lit(1)) / 2)) | (F.aggregate(wins, F.lit(0), lambda s, x: s + x) >= F.coalesce("best_of", F.lit(99)))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("state") != "completed", F.lit(True)), "not-terminal"),
            F.when(F.coalesce(F.size("teams"), F.lit(0)) != 2, "not-two-teams"),
            F.when(~F.coalesce(decided, F.lit(False)), "no-result"),
        )
    )
    return events.withColumn("reasons", reasons).withColumn("completed", F.size("reasons") == 0)


def first_completions(events: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Each completed match once: repeats of a match id within the watermark are dropped; state is bounded by ``delay``."""
    return with_evidence(events).where("completed").withWatermark("at", delay).dropDuplicatesWithinWatermark(["match_id"])


def acknowledged(pending: DataFrame, reconciled: DataFrame, within: str = "7 days") -> DataFrame:
    """Pending matches joined with the rows that reconcile them, stream to stream within a bounded time."""
    p = pending.withWatermark("at", within).alias("p")
    r = reconciled.withWatermark("reconciled_at", within).alias("r")
    return p.join(r, F.expr(f"p.match_id = r.match_id AND r.reconciled_at >= p.at AND r.reconciled_at <= p.at + interval {within}")).select("p.match_id", "p.at", "r.reconciled_at")


def next_try(tries, last):
    """When a pending match is tried again after ``tries`` attempts, the last at ``last``."""
    minutes = F.lit(LATER_MINUTES)
    for i, m in reversed(list(enumerate(RETRY_MINUTES, 1))):
        minutes = F.when(tries == i, m).otherwise(minutes)
    return F.timestamp_add("MINUTE", F.when(tries <= 0, 0).otherwise(minutes), last)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, users and value by window and type; later than ``late`` is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "users", "value")


def run_trigger(events: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each batch of new completions to ``act``, once; a batch without any does nothing."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            act(batch, number)

    return first_completions(events).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def read_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder that polled pages land in, as a stream."""
    return spark.readStream.schema(schema).json(path)
