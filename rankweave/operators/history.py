"""Windows over a team's games: form, running values, as-of values, daily ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .series import sides, won
from .storage import new_path, write_back

GAME_ORDER = ("date", "series_id", "game_number")


def team_points(games: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each team and game, numbered by ``seq``, with ``score``: 1500 and 10 for each win more than losses so far, and ``extra`` columns of ``sides``.

    Games are numbered within their team and date, behind sums of the dates before, so that no task sorts all games of a team.
    """
    rows = sides(games).withColumn("won", won()).withColumns({"block": F.struct("team", "date"), "gain": F.when(F.col("won"), 10).otherwise(-10)})
    earlier = Window.partitionBy("block.team").orderBy("block.date").rowsBetween(Window.unboundedPreceding, -1)  # a row a team and date
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("gain").alias("gains"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.coalesce(F.sum("gains").over(earlier), F.lit(0)).alias("start"))
    w = Window.partitionBy("block").orderBy(*GAME_ORDER[1:])
    rows = rows.withColumns({"at": F.row_number().over(w), "running": F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(blocks, "block")
    return rows.select("team", "league", "opponent", "season", "date", "series_id", "game_number", "tier", "won", "player", (F.col("ahead") + F.col("at")).cast("long").alias("seq"), (1500 + F.col("start") + F.col("running")).cast("long").alias("score"), *extra)


def form(points: DataFrame, last: int = 5) -> DataFrame:
    """``points`` with ``form``: the last results, newest last, as W and L."""
    w = Window.partitionBy("team").orderBy("seq").rowsBetween(-(last - 1), 0)
    return points.withColumn("form", F.array_join(F.collect_list(F.when(F.col("won"), "W").otherwise("L")).over(w), ""))


def daily_close(points: DataFrame) -> DataFrame:
    """The last score of each team and day."""
    return points.groupBy("team", "date").agg(F.max_by("score", "seq").alias("score"), F.count("*").alias("games"))


def daily_ranks(points: DataFrame) -> DataFrame:
    """On every day with games, every team's last known score and its rank.

    The spine is days times teams, the result's own size; teams are a fixed dimension that is broadcast.
    """
    close = daily_close(points).select("team", "date", "score")
    spine = close.select("date").distinct().crossJoin(F.broadcast(close.select("team").distinct()))
    known = F.last("score", ignorenulls=True).over(Window.partitionBy("team").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    filled = spine.join(close, ["team", "date"], "left").withColumn("score", known).where("score is not null")
    return filled.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "team")).cast("long"))


def as_of(points: DataFrame, day) -> DataFrame:
    """Each team's score at the end of ``day``: its last point on or before it."""
    return points.where(F.col("date") <= day).groupBy("team").agg(F.max_by("score", "seq").alias("score"), F.max("date").alias("date"), F.count("*").alias("games"))


def extremes(points: DataFrame) -> DataFrame:
    """Peak, trough, first and last score of each team, earliest first among equals."""
    return points.groupBy("team").agg(
        F.max("score").alias("peak"),
        F.min(F.struct((-F.col("score")).alias("s"), "seq", "date")).getField("date").alias("peak_date"),
        F.min("score").alias("trough"),
        F.min(F.struct(F.col("score").alias("s"), "seq", "date")).getField("date").alias("trough_date"),
        F.min_by("score", "seq").alias("first_score"),
        F.max_by("score", "seq").alias("last_score"),
        (F.max_by("score", "seq") - F.min_by("score", "seq")).alias("net"),
    )


def rolling_movement(points: DataFrame, days: int = 30) -> DataFrame:
    """Each team's score and rank at the corpus end and ``days`` before, and the games in between."""
    end = points.agg(F.max("date").alias("end"))
    dated = points.crossJoin(F.broadcast(end)).withColumn("old", F.col("date") <= F.date_sub("end", days))
    both = dated.groupBy("team").agg(F.max_by("score", "seq").alias("score"), F.max_by(F.when(F.col("old"), F.col("score")), F.when(F.col("old"), F.col("seq"))).alias("base"), F.count_if(~F.col("old")).alias("recent"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), "team")).cast("long")  # noqa: E731  a row a team
    return both.withColumns({"rank": rank("score"), "base_rank": rank("base")}).select("team", "score", "base", "recent", "rank", "base_rank", (F.col("base_rank") - F.col("rank")).alias("moved"))


def tier_labels(scores: DataFrame, by: str, order: str, value: str, keep: float = 35.0) -> DataFrame:
    """``scores`` with ``label``: S from 1600, A from 1540, B from 1480, else C, where the label before stays while the score is within ``keep`` of its limit.

    Each label depends on the one before, so a group's rows are folded in order as an array.
    """
    label = lambda v: F.when(v >= 1600, "S").when(v >= 1540, "A").when(v >= 1480, "B").otherwise("C")
    floor_of = lambda t: F.when(t == "S", 1600.0).when(t == "A", 1540.0).when(t == "B", 1480.0).otherwise(-1e9)
    ceiling_of = lambda t: F.when(t == "S", 1e9).when(t == "A", 1600.0).when(t == "B", 1540.0).otherwise(1480.0)
    rows = scores.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("points"))
    state = F.struct(F.lit("").alias("t"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        stay = (s.t != "") & (p.v >= floor_of(s.t) - keep) & (p.v < ceiling_of(s.t) + keep)
        now = F.when(stay, s.t).otherwise(label(p.v))
        return F.struct(now.alias("t"), F.concat(s.out, F.array(now)).alias("out"))

    labels = F.aggregate("points", state, step, lambda s: s.out)
    return rows.select(by, F.explode(F.arrays_zip(F.col("points"), labels.alias("labels"))).alias("z")).select(by, F.col("z.points.o").alias(order), F.col("z.points.v").alias(value), F.col("z.labels").alias("label"))


def region_trend(points: DataFrame, days: int = 30, least: int = 2) -> DataFrame:
    """For each league and date with games: teams that played within ``days`` and their mean last score; dates with fewer than ``least`` are left out."""
    close = daily_close(points).select("team", "date", "score")
    league = points.groupBy("team").agg(F.min("league").alias("league"))
    spine = close.select("date").distinct().crossJoin(F.broadcast(league))
    so_far = Window.partitionBy("team").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(close.withColumn("played", F.col("date")), ["team", "date"], "left")
    rows = rows.withColumns({"score": F.last("score", ignorenulls=True).over(so_far), "played": F.last("played", ignorenulls=True).over(so_far)})
    active = rows.where(F.datediff("date", "played") <= days)
    return active.groupBy("league", "date").agg(F.count("*").alias("active"), F.sum("score").alias("total")).where(F.col("active") >= least)


def rates_before(points: DataFrame) -> DataFrame:
    """For each team and date: its games and wins before that date."""
    days = points.groupBy("team", "date").agg(F.count("*").alias("n"), F.count_if("won").alias("w"))
    earlier = Window.partitionBy("team").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("team", "date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("games_before"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("wins_before"))


def ranks_after_games(points: DataFrame, each: int = 200_000) -> DataFrame:
    """The place of each game's two teams among all known ones right after it, by score and name.

    Games are cut into blocks in order of time, of ``each`` rows or as many as there are teams. First every
    team's last score before each block is carried forward, a row a team and block; then blocks are walked in
    parallel over a tree of counts, with work of a logarithm for each game. So a block's task holds its games and
    one score a team, and no rows are made for teams that do not play.
    """
    place = ["date", "series_id", "game_number"]
    n, teams = points.agg(F.count("*"), F.countDistinct("team")).first()
    blocks = max(1, -(-n // max(each, teams, 1)))
    path = new_path(points.sparkSession, "ranks")
    rows = write_back(points.select(*place, "team", "score").repartitionByRange(blocks, *place).withColumn("block", F.spark_partition_id()), f"{path}/games")
    closes = rows.groupBy("block", "team").agg(F.max_by("score", F.struct(*place)).alias("score"))
    spine = rows.select("team").distinct().select("team", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    earlier = Window.partitionBy("team").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = spine.join(closes, ["block", "team"], "left").withColumn("score", F.last("score", ignorenulls=True).over(earlier)).where("score is not null")
    start = write_back(start.select("block", "team", "score"), f"{path}/start", max(1, blocks))
    schema = T.StructType([*(rows.schema[c] for c in (*place, "team", "score")), T.StructField("rank", T.LongType())])
    return start.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_ranks_of_block, schema)


def _ranks_of_block(start, rows):
    """Ranks after each game of a block, given the scores before it."""
    import numpy as np
    import pyarrow as pa

    rows = rows.sort_by([(c, "ascending") for c in ("date", "series_id", "game_number", "team")])
    names = pa.chunked_array([*start["team"].chunks, *rows["team"].chunks], pa.string())
    _, code = np.unique(names.to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    score = np.concatenate([start["score"].to_numpy(), rows["score"].to_numpy()])
    # Every (score, team) that occurs has its place in the order, and a tree counts the teams that stand there now.
    pairs, at = np.unique(np.stack([-score, code], axis=1), axis=0, return_inverse=True)
    at = at.reshape(-1).tolist()
    size, known = len(pairs), start.num_rows
    counts = np.zeros(size + 1, "int64")
    counts[np.array(at[:known], "int64") + 1] = 1
    total = np.concatenate([[0], np.cumsum(counts[1:])])
    tree = [int(total[i] - total[i - (i & -i)]) for i in range(size + 1)]
    stands = dict(zip(code[:known].tolist(), at[:known], strict=True))

    def add(i, by):
        i += 1
        while i <= size:
            tree[i] += by
            i += i & -i

    games = list(zip(rows["date"].to_pylist(), rows["series_id"].to_pylist(), rows["game_number"].to_pylist(), strict=True))
    ranks, first = [0] * len(games), 0
    while first < len(games):
        last = first
        while last < len(games) and games[last] == games[first]:
            team, now = int(code[known + last]), at[known + last]
            if team in stands:
                add(stands[team], -1)
            stands[team] = now
            add(now, 1)
            last += 1
        for k in range(first, last):
            i, rank = at[known + k] + 1, 0
            while i:
                rank += tree[i]
                i -= i & -i
            ranks[k] = rank
        first = last
    return rows.select(["date", "series_id", "game_number", "team", "score"]).append_column("rank", pa.array(ranks, pa.int64()))
