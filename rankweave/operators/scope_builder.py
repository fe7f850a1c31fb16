"""All scopes of the lattice season x event x region x checkpoint in one pass over shared histories.

A row says which scopes it belongs to; these are exploded once and grouped once, so that a thousand scopes take the
scans and shuffles of one. A standing of a scope comes from the histories of the whole contest: ratings are
those of the time, and only what is counted is the scope's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL = "All"
#: A scope: season, event, region and checkpoint, each a value or ``All``.
SCOPE = ("scope_season", "scope_event", "scope_region", "scope_checkpoint")
#: Results that a form shows, and games that make a team eligible.
FORM, ELIGIBLE = 5, 3


def scope_key() -> Column:
    return F.concat_ws("|", *SCOPE)


def memberships(season: Column, event: Column, regions: list[Column], checkpoint: Column) -> Column:
    """The scopes of a row as an array: every mix of its season, event and distinct regions with ``All``, and its season's checkpoint.

    Nulls belong to ``All`` only; a checkpoint comes with its season, for all events and regions.
    """
    options = lambda *values: F.array_distinct(F.array_compact(F.array(F.lit(ALL), *[v.cast("string") for v in values])))
    one = lambda s, e, r, c: F.struct(s.alias(SCOPE[0]), e.alias(SCOPE[1]), r.alias(SCOPE[2]), c.alias(SCOPE[3]))
    mixes = F.flatten(F.transform(options(season), lambda s: F.flatten(F.transform(options(event), lambda e: F.transform(options(*regions), lambda r: one(s, e, r, F.lit(ALL)))))))
    own = F.when(season.isNotNull() & checkpoint.isNotNull(), F.array(one(season.cast("string"), F.lit(ALL), F.lit(ALL), checkpoint.cast("string"))))
    return F.concat(mixes, F.coalesce(own, F.filter(mixes, lambda x: F.lit(False))))


def in_scopes(rows: DataFrame, season: Column, event: Column, regions: list[Column], checkpoint: Column) -> DataFrame:
    """``rows`` once for each of their scopes, with ``scope`` and its parts."""
    out = rows.withColumn("scope_parts", F.explode(memberships(season, event, regions, checkpoint))).select("*", "scope_parts.*").drop("scope_parts")
    return out.withColumn("scope", scope_key())


def scope_standings(points: DataFrame) -> DataFrame:
    """Standings of every scope from scoped ``points`` (scope, team, seq, date, won, score, delta).

    Games, wins and losses are the scope's; the rating is that after the team's last game there, ``before`` that
    before its first one, and ``moved`` the change of rank between both. Eligible teams come first. ``form``
    has the last results in the scope, the newest last.
    """
    by = ["scope", "team"]
    last = points.select(*by, "seq", "won").withColumn("back", _back(by)).where(F.col("back") <= FORM)
    return _placed(points.groupBy(*by).agg(*_counts()), last)


def _counts() -> list[Column]:
    return [
        F.count("*").alias("games"),
        F.count_if("won").alias("wins"),
        F.max_by("score", "seq").alias("rating"),
        F.min_by(F.col("score") - F.col("delta"), "seq").alias("before"),
        F.max("score").alias("peak"),
        F.max("date").alias("last_date"),
    ]


def _back(by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col("seq").desc()))


def _placed(counted: DataFrame, last: DataFrame) -> DataFrame:
    """Standings from counts by scope and team, and the last rows of each."""
    by = ["scope", "team"]
    form = last.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "won"))), lambda x: F.when(x.won, "W").otherwise("L")), "").alias("form"))
    rows = counted.join(form, by).withColumn("eligible", F.col("games") >= ELIGIBLE)
    place = lambda c: F.row_number().over(Window.partitionBy("scope").orderBy(F.col("eligible").desc(), F.col(c).desc(), "team")).cast("long")  # noqa: E731  a row a team
    rows = rows.withColumns({"rank": place("rating"), "rank_before": place("before")})
    return rows.withColumns({"losses": F.col("games") - F.col("wins"), "moved": F.col("rank_before") - F.col("rank")})


def standings_by_cell(points: DataFrame, season: Column, event: Column, regions: list[Column], checkpoint: Column) -> DataFrame:
    """What ``scope_standings`` gives for ``in_scopes``, from points before they are exploded.

    Points of equal season, event, regions and checkpoint are in the same scopes: a team's are summed up first, and
    only the sums and the last rows of such a cell go into its scopes. So points are read once, and not once a scope.
    """
    cell = {"cell_season": season.cast("string"), "cell_event": event.cast("string"), "cell_checkpoint": checkpoint.cast("string")} | {f"cell_region_{i}": r.cast("string") for i, r in enumerate(regions)}
    rows = points.withColumns(cell)
    by = ["team", *cell]
    scoped = lambda df: in_scopes(df, F.col("cell_season"), F.col("cell_event"), [F.col(f"cell_region_{i}") for i in range(len(regions))], F.col("cell_checkpoint"))
    sums = scoped(rows.groupBy(*by).agg(*_counts(), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")))
    counted = sums.groupBy("scope", "team").agg(
        F.sum("games").alias("games"),
        F.sum("wins").alias("wins"),
        F.max_by("rating", "last_seq").alias("rating"),
        F.min_by("before", "first_seq").alias("before"),
        F.max("peak").alias("peak"),
        F.max("last_date").alias("last_date"),
    )
    latest = scoped(rows.select(*by, "seq", "won").withColumn("back", _back(by)).where(F.col("back") <= FORM))
    return _placed(counted, latest.withColumn("back", _back(["scope", "team"])).where(F.col("back") <= FORM))


def scope_summaries(standings: DataFrame) -> DataFrame:
    """One row a scope: teams, eligible ones, games, the best team, and the one that rose most (the better ranked of equals)."""
    return standings.groupBy("scope").agg(
        F.count("*").alias("teams"),
        F.count_if("eligible").alias("eligible"),
        F.sum("games").alias("sides"),
        F.min_by("team", "rank").alias("best"),
        F.min_by("team", F.struct((-F.col("moved")).alias("m"), "rank")).alias("riser"),
        F.max("last_date").alias("last_date"),
    )


def scope_players(lines: DataFrame, leaders: int = 10) -> tuple[DataFrame, DataFrame]:
    """(players of every scope, the leaders of each by wins, games and id) from scoped ``lines`` (scope, player, won, kills).

    Players grow with the input, so all of them are counted and only leaders are ranked, which Spark limits
    before it exchanges.
    """
    out = lines.groupBy("scope", "player").agg(F.count("*").alias("games"), F.count_if("won").alias("wins"), F.sum("kills").cast("double").alias("kills"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("wins").desc(), F.col("games").desc(), "player"))
    return out, out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= leaders)


def players_by_scope(lines: DataFrame, season: Column, event: Column, regions: list[Column], checkpoint: Column, leaders: int = 10) -> tuple[DataFrame, DataFrame]:
    """What ``scope_players`` gives for ``in_scopes``, with lines exchanged by player before they are exploded: what a player has in all scopes is counted where its lines are."""
    return scope_players(in_scopes(lines.repartition("player"), season, event, regions, checkpoint), leaders)
