"""Histories and directories as they are published: compacted, scoped, merged and searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def catalog_search(matches: DataFrame, text: str = "", league: str | None = None, event: str | None = None) -> DataFrame:
    """Matches whose team names or codes hold ``text``, whatever the case, of a league and with ``event`` in the event's name; empty means all."""
    if text:
        fits = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower())) for c in ("team_a", "team_b", "code_a", "code_b")]
        matches = matches.where(fits[0] | fits[1] | fits[2] | fits[3])
    if league is not None:
        matches = matches.where(F.col("league") == league)
    if event is not None:
        matches = matches.where(F.contains(F.lower("event"), F.lit(event.lower())))
    return matches


def match_points(points: DataFrame, team: str = "team") -> DataFrame:
    """Game points (series_id, seq, date, score, delta, won) as one point for each match: last score, summed delta, record and whether it is resolved."""
    out = points.groupBy(team, "series_id").agg(
        F.min("seq").alias("first_seq"),
        F.max("date").alias("date"),
        F.max_by("score", "seq").alias("score"),
        F.sum("delta").alias("delta"),
        F.count_if("won").alias("wins"),
        F.count_if(~F.col("won")).alias("losses"),
        F.max_by("opponent", "seq").alias("opponent"),
        # The last game that moved the score says what the match did.
        F.max_by(F.when(F.col("delta") != 0, F.col("game_number")), F.when(F.col("delta") != 0, F.col("seq"))).alias("deciding_game"),
    )
    return out.withColumns({"result": F.when(F.col("wins") > F.col("losses"), "W").when(F.col("wins") < F.col("losses"), "L").otherwise("T"), "resolved": F.col("wins") != F.col("losses"), "best_of": best_of_score(F.col("wins"), F.col("losses"))})


def best_of_score(wins: Column, losses: Column) -> Column:
    """The shortest format that a score fits: 1, 3 or 5 for a decided one, 2 for one all."""
    most = F.greatest(wins, losses)
    return F.when((wins == 1) & (losses == 1), 2).when(most <= 1, 1).when(most == 2, 3).otherwise(5).cast("long")


def plotted(matches: DataFrame, least: int = 2, team: str = "team") -> DataFrame:
    """Match points of the teams that have ``least`` of them."""
    return matches.withColumn("points", F.count("*").over(Window.partitionBy(team))).where(F.col("points") >= least)


def recent(matches: DataFrame, most: int = 25, team: str = "team") -> DataFrame:
    """The last matches of each team, newest first, with the change of score from the match before."""
    # One more than asked for tells the change of the oldest; Spark drops all others before it exchanges them.
    back = F.row_number().over(Window.partitionBy(team).orderBy(F.col("first_seq").desc()))
    rows = matches.withColumn("back", back).where(F.col("back") <= most + 1)
    rows = rows.withColumn("change", F.col("score") - F.lag("score").over(Window.partitionBy(team).orderBy("first_seq")))
    return rows.withColumn("back", F.col("back").cast("long")).where(F.col("back") <= most)


def with_current(history: DataFrame, standings: DataFrame, day: Column) -> DataFrame:
    """``history`` (team, seq, date, score) with a row for each standing (team, score) after its last."""
    last = history.groupBy("team").agg((F.max("seq") + 1).alias("seq"))
    current = standings.join(last, "team").select("team", "seq", day.alias("date"), "score", F.lit(True).alias("current"))
    return history.select("team", "seq", "date", "score", F.lit(False).alias("current")).unionByName(current)


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups of ``rows`` numbered in the order in which their keys first came."""
    groups = rows.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    return groups.withColumn("group_no", F.row_number().over(Window.orderBy("first", *keys)).cast("long"))


def provenance(rows: DataFrame, keys: list[str], order: str, source: str, item: str) -> DataFrame:
    """Of each key, the latest source and the distinct items in the order in which they first came."""
    first = rows.groupBy(*keys, item).agg(F.min(order).alias("at"))
    items = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item))), lambda x: x[item]).alias("items"))
    return rows.groupBy(*keys).agg(F.max_by(source, order).alias("source")).join(items, keys)


def game_order(games: DataFrame, ids: str) -> DataFrame:
    """``games`` with ``game_no`` in their series: by time with nulls last, then by the number that the id ends with, then by id."""
    number = F.regexp_extract(F.col(ids), r"(\d+)\D*$", 1).try_cast("long")
    order = Window.partitionBy("series_id").orderBy(F.col("at").asc_nulls_last(), number.asc_nulls_last(), ids)
    return games.withColumn("game_no", F.row_number().over(order).cast("long"))


def scoped_standings(points: DataFrame, keys: DataFrame, ratings: DataFrame) -> DataFrame:
    """Standings of every scope that ``keys`` (scope, series_id) names, over its matches: record, form and rank anew, the rating as it is (team, rating)."""
    rows = points.join(keys.select("scope", "series_id").distinct(), "series_id")
    back = F.row_number().over(Window.partitionBy("scope", "team").orderBy(F.col("seq").desc()))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("seq", "won"))), lambda x: F.when(x.won, "W").otherwise("L"))
    last = rows.withColumn("back", back).where("back <= 5").groupBy("scope", "team").agg(F.array_join(letters, "").alias("form"))
    out = rows.groupBy("scope", "team").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.max("date").alias("last_date"))
    out = out.join(last, ["scope", "team"]).join(ratings, "team")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("rating").desc(), "team")).cast("long"))


def with_fallback(scoped: DataFrame, everything: DataFrame, key: str = "team") -> DataFrame:
    """The scoped rows, and for keys without any the rows of all seasons."""
    return scoped.withColumn("scope", F.lit("scoped")).unionByName(everything.join(scoped.select(key).distinct(), key, "left_anti").withColumn("scope", F.lit("all")))


def movement_shards(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Points of each team in each tournament: one before its first match, one for each match, numbered within the day for charts.

    ``matches`` has instance, team, date, seq, score and before; ``entries`` (instance, team) says who takes part.
    """
    rows = matches.join(entries.select("instance", "team").distinct(), ["instance", "team"], "left_semi")
    first = rows.groupBy("instance", "team").agg(F.min("date").alias("date"), F.lit(-1).cast("long").alias("seq"), F.min_by("before", "seq").alias("score"))
    both = rows.select("instance", "team", "date", "seq", "score", F.lit("match").alias("kind")).unionByName(first.withColumn("kind", F.lit("start")))
    within = Window.partitionBy("instance", "team", "date").orderBy("seq")
    return both.withColumn("minute", F.row_number().over(within).cast("long") - 1)


def component_changes(history: DataFrame, components: list[str], least: float = 0.05) -> DataFrame:
    """Changes of rating components between a team's consecutive points, a row for each component that moved at least ``least``."""
    w = Window.partitionBy("team").orderBy("seq")
    parts = F.array(*[F.struct(F.lit(c).alias("component"), (F.col(c) - F.lag(c).over(w)).alias("change")) for c in components])
    rows = history.withColumn("parts", parts).select("team", "seq", F.explode("parts").alias("p")).select("team", "seq", "p.*")
    return rows.where(F.abs("change") >= least)


def unpivoted(rows: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """A comparison table: a row for each key and metric, with whether it is the best of that metric."""
    long = rows.unpivot([F.col(k) for k in key], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    best = long.groupBy("metric").agg(F.max("value").alias("most"))
    return long.join(F.broadcast(best), "metric").select(*key, "metric", "value", (F.col("value") == F.col("most")).alias("best"))
