"""Roster eras, joins of overlapping dates, and how far eras that are still open widen a replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import ended, islands

#: Days of the narrowest bins; each further level is twice as wide.
BIN_DAYS = 32


def roster_eras(observations: DataFrame) -> DataFrame:
    """Eras of each team out of ``observations`` (team, date, match_id, signature): runs of matches with one roster.

    ``ended`` is the date that the next era starts, null for the open one; ``last`` is the era's last match.
    """
    rows = islands(observations, ["team"], ["date", "match_id"], "signature").withColumnRenamed("island", "era")
    spans = rows.groupBy("team", "era").agg(F.min("signature").alias("signature"), F.min("date").alias("started"), F.max("date").alias("last"), F.count("*").alias("matches"), F.min("last_island").alias("last_island"), F.min("next_start").alias("next_start"))
    return spans.withColumn("ended", ended("era", "started")).drop("last_island", "next_start")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows that agree on ``on`` and whose date spans (ends inclusive) share a day; columns of both sides but ``on`` differ in name.

    A span lies in two bins at most of the level as wide as itself, and in as many of each wider one; a pair
    meets once, at the level of its longer span, in the bin of the later start. So it is an equi-join whose rows
    grow with spans and levels, not with their length, and Spark is free to shuffle or broadcast. A null end
    means that the span is open; a null start, and an end before the start, overlap nothing.
    """
    a0, a1, b0, b1 = (F.unix_date(c) for c in (*left_span, *right_span))
    far = [df.agg(F.max(F.greatest(s, e))).first()[0] for df, s, e in ((left, a0, a1), (right, b0, b1))]
    horizon = max((x for x in far if x is not None), default=0)

    def numbered(df, start, end, mark):
        out = df.withColumns({f"{mark}0": start, f"{mark}1": F.coalesce(end, F.lit(horizon))}).where(F.col(f"{mark}0") <= F.col(f"{mark}1"))
        length = F.col(f"{mark}1") - F.col(f"{mark}0") + 1
        return out.withColumn(f"{mark}_level", F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(BIN_DAYS)))).cast("int"))

    sides = [numbered(left, a0, a1, "overlap_a"), numbered(right, b0, b1, "overlap_b")]
    levels = [df.agg(F.max(f"{m}_level")).first()[0] for df, m in zip(sides, ("overlap_a", "overlap_b"), strict=True)]
    top = max((x for x in levels if x is not None), default=0)
    width = lambda level: F.call_function("shiftleft", F.lit(BIN_DAYS), level)
    bin_of = lambda day, level: F.floor(day / width(level)).cast("int")

    def binned(df, mark):
        start, end = F.col(f"{mark}0"), F.col(f"{mark}1")
        each = F.transform(F.sequence(F.col(f"{mark}_level"), F.lit(top)), lambda lv: F.transform(F.sequence(bin_of(start, lv), bin_of(end, lv)), lambda n: F.struct(lv.alias("overlap_level"), n.alias("overlap_bin"))))
        return df.withColumn("overlap_at", F.explode(F.flatten(each))).select("*", "overlap_at.*").drop("overlap_at")

    both = binned(sides[0], "overlap_a").join(binned(sides[1], "overlap_b"), [*on, "overlap_level", "overlap_bin"])
    later = F.greatest("overlap_a0", "overlap_b0")
    meet = (F.greatest("overlap_a_level", "overlap_b_level") == F.col("overlap_level")) & (later <= F.least("overlap_a1", "overlap_b1")) & (bin_of(later, F.col("overlap_level")) == F.col("overlap_bin"))
    return both.where(meet).drop("overlap_level", "overlap_bin", *[f"overlap_{m}{x}" for m in "ab" for x in ("0", "1", "_level")])


def replay_blocks(eras: DataFrame) -> DataFrame:
    """(block_start, block_end) of dates that eras tie together: a replay from within a block has to start at its beginning.

    A replay from a date needs every era that still has matches there from its start on, which reaches further
    eras; the fixed point of that is the beginning of the run of overlapping eras. Eras are first summed up by
    their start, so that the running maximum is over a row a date.
    """
    days = eras.groupBy(F.col("started").alias("day")).agg(F.max("last").alias("reach"))
    before = F.max("reach").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    marked = days.withColumn("first", (before.isNull() | (before < F.col("day"))).cast("int"))
    numbered = marked.withColumn("block", F.sum("first").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("block").agg(F.min("day").alias("block_start"), F.max("reach").alias("block_end")).drop("block")


def replay_starts(eras: DataFrame, boundaries: DataFrame, fresh: DataFrame, changed: Column | None = None) -> DataFrame:
    """Where the eras of a run have to be replayed from, for each of ``boundaries`` (boundary, until).

    ``fresh`` (team, date) are matches; those after a boundary up to ``until`` are new to it. ``open_eras``: teams
    whose era is open at the boundary; ``open_start``: the earliest start of those that have new matches;
    ``replay_from``: the least of it and ``changed``, a column of ``boundaries``, widened to the beginning of its block.
    """
    at = overlap_join(boundaries, eras.withColumn("era_end", F.date_sub("ended", 1)), ("boundary", "boundary"), ("started", "era_end"))
    after = boundaries.select(F.col("boundary").alias("of"), F.date_add("boundary", 1).alias("from"), F.col("until").alias("to"))
    new = overlap_join(fresh.select("team", "date").distinct(), after, ("date", "date"), ("from", "to")).select("team", F.col("of").alias("boundary")).distinct().withColumn("is_new", F.lit(True))
    open_ = at.join(new, ["team", "boundary"], "left").groupBy("boundary").agg(F.count("*").alias("open_eras"), F.min(F.when(F.col("is_new"), F.col("started"))).alias("open_start"))
    start = F.col("open_start") if changed is None else F.least("open_start", changed)
    rows = boundaries.join(open_, "boundary", "left").withColumn("start", start)
    blocks = overlap_join(rows.select("boundary", "start"), replay_blocks(eras), ("start", "start"), ("block_start", "block_end")).select("boundary", "block_start")
    return rows.join(blocks, "boundary", "left").select("boundary", F.coalesce("open_eras", F.lit(0)).alias("open_eras"), "open_start", F.coalesce("block_start", "start").alias("replay_from"))
