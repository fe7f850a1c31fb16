"""Filters, scope lattices and checkpoint windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Events that end a checkpoint.
BOUNDARIES = ("worlds-playoffs", "msi-bracket", "major-playoffs")


def in_scope(games: DataFrame, season: int | None = None, tier: str | None = None, league: str | None = None) -> DataFrame:
    """Games of a season, event tier and league (either side's); null means all."""
    if season is not None:
        games = games.where(F.col("season") == season)
    if tier is not None:
        games = games.where(F.col("tier") == tier)
    if league is not None:
        games = games.where((F.col("league_a") == league) | (F.col("league_b") == league))
    return games


def scope_lattice(games: DataFrame) -> DataFrame:
    """Game counts of all scopes in one pass: everything, each season, tier and league, each season with tier."""
    sets = [[], ["season"], ["tier"], ["league"], ["season", "tier"]]
    return games.groupingSets([[F.col(c) for c in s] for s in sets], F.col("season"), F.col("tier"), F.col("league")).agg(F.count("*").alias("games"))


def checkpoints(games: DataFrame) -> DataFrame:
    """The last date of each boundary event in each season, each starting the day after the one before."""
    ends = games.where(F.col("tier").isin(list(BOUNDARIES))).groupBy("season", "tier").agg(F.max("date").alias("end_date"))
    # A row for each season and boundary: a window over all of them is small whatever the games.
    return ends.withColumn("start_date", F.date_add(F.lag("end_date").over(Window.orderBy("end_date", "tier")), 1))


def assign_windows(games: DataFrame, ends: DataFrame) -> DataFrame:
    """``games`` with ``scope``: the season of the first checkpoint on or after their date; later games are left out.

    Checkpoints follow each other, so the windows are a sorted list of ends: it is a few rows, and is
    matched by a condition on a broadcast of it instead of a range join over dates.
    """
    w = Window.orderBy("end_date")
    spans = ends.select(F.col("season").alias("scope"), "end_date", F.lag("end_date").over(w).alias("after"))
    inside = (F.col("date") <= F.col("end_date")) & (F.col("after").isNull() | (F.col("date") > F.col("after")))
    return games.join(F.broadcast(spans), inside)
