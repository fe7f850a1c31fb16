"""Five forecasts of every series from what was known before it: published, by ratings alone, and with players or execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import series_points
from ..functions.rounding import half_up
from .model_replay import carried
from .series import outcome, sides

#: Games at which a side's edge counts half, and weights of players' edges and of execution as published and as tried beside it.
SIDE_GAMES = 24.0
PLAYERS, EXECUTION, TRIED = 1.0, 0.0, 1.0
VARIANTS = ("published", "team_only", "player_adjusted", "execution_baseline", "execution_adjusted")


def side_edges(games: DataFrame) -> DataFrame:
    """(patch, date, edge): rating points that the blue side is worth by games of earlier dates.

    Those of the patch count, or all games where the patch is new, or none. ``games`` has date, patch, team_a,
    winner and side_a; games without a side say nothing, those without a date are left out, and a null patch
    is one that is always new. Games are counted by patch and date first, so windows hold a row a date.
    """
    rows = games.where("date is not null")
    known = F.col("side_a").isNotNull() & F.col("winner").isNotNull()
    blue = (F.col("side_a") == "blue") == (F.col("winner") == F.col("team_a"))
    days = rows.groupBy("patch", "date").agg(F.count_if(known & blue).alias("b"), F.count_if(known).alias("n"))
    before = lambda w: w.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    own, every = before(Window.partitionBy("patch")), before(Window.partitionBy())
    total = days.groupBy("date").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).select("date", F.sum("b").over(every).alias("all_b"), F.sum("n").over(every).alias("all_n"))
    out = days.withColumns({"own_b": F.sum("b").over(own), "own_n": F.when(F.col("patch").isNotNull(), F.sum("n").over(own))}).join(total, "date")

    def edge(b: str, n: str) -> Column:
        odds = F.ln((F.col(b) + 0.5) / (F.col(n) - F.col(b) + 0.5))
        return 400.0 / F.ln(F.lit(10.0)) * odds * (F.col(n) / (F.col(n) + SIDE_GAMES))

    value = F.when(F.col("own_n") > 0, edge("own_b", "own_n")).when(F.col("all_n") > 0, edge("all_b", "all_n")).otherwise(0.0)
    return out.select("patch", "date", half_up(value, 4).alias("edge"))


def forecasts(series: DataFrame, frozen: DataFrame, edges: DataFrame, blue: DataFrame) -> DataFrame:
    """Two rows for each completed series: series_id, team, opponent, observed and the expected points of all VARIANTS.

    ``series`` (from ``resolve_series``) has ``side_a``, the side of its first game, and ``period``, the batch whose
    ``frozen`` state (period, team, power, rating, momentum, uncertainty, execution) it starts from. ``edges``
    (series_id, team, edge) are those of players before the series; a team without one keeps its last one of
    an earlier date as roster prior, and 0 before any. ``blue`` comes from ``side_edges``. Series without a date
    or a side of a team are left out; those with unknown sides get no side's edge.
    """
    done = series.where("state = 'completed' and date is not null and team_a is not null and team_b is not null")
    rows = sides(done).join(edges.select("series_id", "team", "edge"), ["series_id", "team"], "left").withColumn("day", F.unix_date("date").cast("long"))
    held = carried(rows.select("team", F.col("day").alias("period"), "series_id", F.col("edge").alias("told"))).select("team", F.col("period").alias("day"), F.col("prior").alias("held"))
    rows = rows.join(held, ["team", "day"]).withColumn("roster_prior", F.coalesce("edge", "held", F.lit(0.0)))
    blue = blue.select(F.col("patch").alias("side_patch"), F.col("date").alias("side_date"), F.col("edge").alias("blue"))
    rows = rows.join(blue, F.col("patch").eqNullSafe(F.col("side_patch")) & (F.col("date") == F.col("side_date")), "left")
    own_blue = (F.col("side_a") == "blue") == (F.col("side_no") == 1)
    rows = rows.withColumn("side_points", F.when(F.col("side_a").isNull(), 0.0).otherwise(F.coalesce("blue", F.lit(0.0)) * F.when(own_blue, 0.5).otherwise(-0.5)))
    rows = rows.join(frozen.select("period", "team", "power", "momentum", "uncertainty", (F.col("execution") - F.col("rating")).alias("residual")), ["period", "team"])
    base = F.col("power") + F.col("roster_prior") * PLAYERS + F.col("momentum")
    ratings = {
        "published": base + F.col("residual") * EXECUTION + F.col("side_points"),
        "team_only": F.col("power"),
        "player_adjusted": F.col("power") + F.coalesce("edge", F.lit(0.0)) * TRIED + F.col("momentum"),
        "execution_baseline": base,
        "execution_adjusted": base + F.col("residual") * TRIED,
    }
    rows = rows.select("series_id", "team", "opponent", "best_of", "uncertainty", outcome().alias("observed"), *[r.alias(v) for v, r in ratings.items()])
    other = rows.select("series_id", F.col("team").alias("opponent"), F.col("uncertainty").alias("other_uncertainty"), *[F.col(v).alias(f"other_{v}") for v in VARIANTS])
    points = [series_points(F.col(v), F.col(f"other_{v}"), F.col("uncertainty"), F.col("other_uncertainty"), F.col("best_of")).alias(v) for v in VARIANTS]
    return rows.join(other, ["series_id", "opponent"]).select("series_id", "team", "opponent", "observed", *points)


def by_variant(rows: DataFrame) -> DataFrame:
    """(variant, p, y) of the decided series of ``forecasts``, as ``metrics.forecast_metrics`` takes them."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("p")) for v in VARIANTS]))
    return rows.where("observed <> 0.5").select(F.col("observed").cast("int").alias("y"), each.alias("v")).select("v.variant", "v.p", "y")
