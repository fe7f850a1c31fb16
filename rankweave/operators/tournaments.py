"""Tournament instances: their span and state, participants, filters and placement points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..functions.taxonomy import any_case
from .eras import overlap_join
from .series import sides, won

#: K, cap and most stage points of a placement by kind of event; points of a stage by words.
PLACEMENT = {"worlds": (2.0, 35.0, 11.0), "msi": (1.65, 25.0, 11.0), "minor": (1.25, 18.0, 8.0)}
FINAL, SEMI, QUARTER = r"\b(grand\s+final|finals?|championship)\b", r"\bsemi", r"\bquarter"
CURRENT_DAYS, LEAD_DAYS = 3, 7


def lifecycles(rated: DataFrame, schedule: DataFrame, generated) -> DataFrame:
    """A row for each instance with rated matches: status, start, boundary, rated_through, scheduled_end, data_lag and coverage_complete.

    ``rated`` has instance, date and match_id; ``schedule`` has instance, date, match_id, completed,
    coverage_start, coverage_end, coverage_end_complete and retrieved. An instance is completed once all
    of its schedule is and the coverage spans it; it is ongoing while rows are open in a schedule that is
    current; else its status is unknown. Matches before a scheduled start that is covered a week ahead do
    not count. An instance without any schedule is unknown and ends with its last rated match.
    """
    plan = schedule.where("instance is not null").groupBy("instance").agg(
        F.min("date").alias("scheduled_start"),
        F.max("date").alias("scheduled_end"),
        F.min("coverage_start").alias("coverage_start"),
        F.max("coverage_end").alias("coverage_end"),
        F.max("retrieved").alias("retrieved"),
        F.bool_or("coverage_end_complete").alias("ends"),
        F.bool_and("completed").alias("all_done"),
        F.max(F.when(F.col("completed"), F.col("date"))).alias("last_done"),
        F.count_if(F.col("completed") & F.col("match_id").isNotNull()).alias("done_ids"),
    )
    led = F.datediff("scheduled_start", "coverage_start") >= LEAD_DAYS
    played = rated.where("instance is not null and date is not null").join(plan.select("instance", "scheduled_start", "coverage_start"), "instance", "left")
    played = played.where(~F.coalesce(led & (F.col("date") < F.col("scheduled_start")), F.lit(False)))
    spans = played.groupBy("instance").agg(F.min("date").alias("start"), F.max("date").alias("rated_through"))
    # Completed ids of the schedule that no rated match has.
    done = schedule.where("completed and match_id is not null").select("instance", "match_id").distinct()
    missing = done.join(played.select("instance", "match_id").distinct(), ["instance", "match_id"], "left_anti").groupBy("instance").agg(F.count("*").alias("missing"))
    out = spans.join(plan, "instance", "left").join(missing, "instance", "left")
    covers = (F.col("coverage_start") <= F.col("scheduled_start")) & (F.col("coverage_end") >= F.col("scheduled_end")) & F.col("ends")
    current = (F.col("coverage_end") >= generated) & (F.abs(F.datediff(generated, F.col("retrieved"))) <= CURRENT_DAYS)
    status = F.when(F.col("all_done") & covers, "completed").when(~F.col("all_done") & current & (F.col("scheduled_end") >= generated), "ongoing").otherwise("unknown")
    boundary = F.when(F.col("status") == "completed", F.col("scheduled_end")).when(F.col("status") == "ongoing", generated).otherwise(F.col("rated_through"))
    return out.withColumn("status", status).select(
        "instance",
        "status",
        "start",
        boundary.alias("boundary"),
        "rated_through",
        "scheduled_end",
        F.coalesce(F.col("last_done") > F.col("rated_through"), F.lit(False)).alias("data_lag"),
        F.coalesce(F.col("all_done") & (F.col("done_ids") > 0) & F.col("missing").isNull(), F.lit(False)).alias("coverage_complete"),
    )


def participants(rated: DataFrame) -> DataFrame:
    """Every team of each instance with its matches there."""
    return rated.where("instance is not null").select("instance", F.explode(F.array("team_a", "team_b")).alias("team")).groupBy("instance", "team").agg(F.count("*").alias("matches"))


def project_standings(standings: DataFrame, entries: DataFrame) -> DataFrame:
    """``standings`` (team, rank, ...) of each instance's participants, ranked anew among them, with the rank that they have overall."""
    from pyspark.sql.window import Window

    kept = [c for c in standings.columns if c != "team"]
    rows = standings.join(entries.select("instance", "team", "matches"), "team").withColumnRenamed("rank", "overall_rank")
    order = Window.partitionBy("instance").orderBy("overall_rank", "team")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).select("instance", "team", "matches", "overall_rank", *[c for c in kept])


def overlapping(entries: DataFrame, start, end) -> DataFrame:
    """Entries (start, end; a null end is open) that share a day with a window."""
    return entries.where((F.col("start") <= end) & (F.coalesce("end", F.lit(end)) >= start))


def stage_points(matches: DataFrame) -> DataFrame:
    """``matches`` (phase, event, tier, team_a, team_b, winner) with ``points_a`` and ``points_b``: 3 and 5 for quarter- and semi-finals, 8 and 11 for the final, else a floor by tier."""
    phase = F.lower(F.concat_ws(" ", "phase", "event"))
    final = phase.rlike(FINAL) & ~phase.rlike(SEMI) & ~phase.rlike(QUARTER)
    floor = F.when(F.col("tier").isin("worlds-playoffs", "msi-bracket"), 3).otherwise(1)
    each = F.when(phase.rlike(QUARTER), 3).when(phase.rlike(SEMI), 5).otherwise(floor)
    points = lambda team: F.when(final, F.when(F.col("winner") == F.col(team), 11).otherwise(8)).otherwise(each).cast("long")
    return matches.withColumns({"points_a": points("team_a"), "points_b": points("team_b")})


def placement_residuals(matches: DataFrame, powers: DataFrame) -> DataFrame:
    """For each event and league: stage points made and expected, representatives, and the delta that the league's score gets.

    ``matches`` has event_key, kind (a key of PLACEMENT), multiplier and both sides' team and league, with the
    columns of ``stage_points``; ``powers`` (event_key, team, power) are the ratings before the event.
    Points are expected by softmax of power over all participants. Deltas below 0.05 are null.
    """
    scored = stage_points(matches)
    side = lambda x: F.struct(F.col(f"team_{x}").alias("team"), F.col(f"league_{x}").alias("league"), F.col(f"points_{x}").alias("points"))
    rows = scored.select("event_key", "kind", "multiplier", F.explode(F.array(side("a"), side("b"))).alias("s")).select("event_key", "kind", "multiplier", "s.*")
    teams = rows.groupBy("event_key", "team").agg(F.max("kind").alias("kind"), F.min("multiplier").alias("multiplier"), F.max("league").alias("league"), F.max("points").alias("points"))
    teams = teams.join(powers, ["event_key", "team"], "left").withColumn("power", F.coalesce("power", F.lit(1500.0)))
    top = teams.groupBy("event_key").agg(F.max("power").alias("top"))
    teams = teams.join(top, "event_key").withColumn("weight", F.round(F.exp((F.col("power") - F.col("top")) / 400.0), 8).cast("decimal(20,8)"))
    total = teams.groupBy("event_key").agg(F.sum("weight").cast("double").alias("total"))
    pick = lambda i: F.create_map(*[F.lit(x) for kind, v in PLACEMENT.items() for x in (kind, v[i])])[F.col("kind")]
    teams = teams.join(total, "event_key").withColumn("expected", F.round(1.0 + F.col("weight").cast("double") / F.col("total") * (pick(2) - 1.0), 6).cast("decimal(20,6)"))
    out = teams.groupBy("event_key", "league").agg(F.max("kind").alias("kind"), F.min("multiplier").alias("multiplier"), F.sum("points").alias("actual"), F.sum("expected").cast("double").alias("expected"), F.countDistinct("team").alias("representatives"))
    cap = pick(1) * F.col("multiplier")
    raw = pick(0) * F.col("multiplier") * (F.col("actual") - F.col("expected")) / F.sqrt(F.col("representatives").cast("double"))
    delta = half_up(F.greatest(F.least(raw, cap), -cap), 1)
    return out.select("event_key", "league", "actual", half_up(F.col("expected"), 4).alias("expected"), "representatives", F.when(F.abs(delta) >= 0.05, delta).alias("delta"))


def placement_entries(matches: DataFrame) -> DataFrame:
    """A row for each team of each event: event_key, team, league, points, opens, closes, k, cap and most, as ``model_replay.replay_placed`` takes them.

    ``matches`` has event_key, kind, multiplier, date, both sides' team and league, and the columns of ``stage_points``.
    The least multiplier of an event counts, and a team's league is that of its last match there.
    """
    scored = stage_points(matches.where("event_key is not null and date is not null"))
    side = lambda x: F.struct(F.col(f"team_{x}").alias("team"), F.col(f"league_{x}").alias("league"), F.col(f"points_{x}").alias("points"))
    rows = scored.select("event_key", "kind", "multiplier", "date", F.explode(F.array(side("a"), side("b"))).alias("s")).select("event_key", "kind", "multiplier", "date", "s.*").where("team is not null")
    spans = scored.groupBy("event_key").agg(F.min("date").alias("opens"), F.max("date").alias("closes"), F.max("kind").alias("kind"), F.min("multiplier").alias("multiplier"))
    teams = rows.groupBy("event_key", "team").agg(F.max_by("league", F.struct("date", "league")).alias("league"), F.max("points").alias("points"))
    pick = lambda i: F.create_map(*[F.lit(x) for kind, v in PLACEMENT.items() for x in (kind, v[i])])[F.col("kind")]
    out = teams.join(spans, "event_key")
    return out.select("event_key", "team", "league", "points", "opens", "closes", (pick(0) * F.col("multiplier")).alias("k"), (pick(1) * F.col("multiplier")).alias("cap"), pick(2).alias("most"))


def powers_before(games: DataFrame, entries: DataFrame) -> DataFrame:
    """(event_key, team, power) of ``entries`` (event_key, team, start): ratings by the shrunken win rate in games before the event's first date.

    Each team's totals hold from one of its dates to the next; an event finds those of the day before it
    by a join on team and bins of dates. Teams that had not played yet are left out.
    """
    from pyspark.sql.window import Window

    days = sides(games).groupBy("team", "date").agg(F.count("*").alias("n"), F.count_if(won()).alias("w"))
    so_far = Window.partitionBy("team").orderBy("date")
    total = lambda c: F.sum(c).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    known = days.select("team", F.col("date").alias("since"), F.date_sub(F.lead("date").over(so_far), 1).alias("until"), total("n").alias("n"), total("w").alias("w"))
    asked = entries.select("event_key", "team", F.date_sub("start", 1).alias("day")).distinct()
    found = overlap_join(asked, known, ("day", "day"), ("since", "until"), ("team",))
    return found.select("event_key", "team", half_up(1500.0 + 400.0 * ((F.col("w") + 1.0) / (F.col("n") + 2.0) - 0.5), 1).alias("power"))


def placed_scores(residuals: DataFrame, ends: DataFrame, priors: DataFrame) -> DataFrame:
    """Each league's score after each of its events: ``residuals`` applied on the day the event ends (event_key, end), on top of ``priors`` (league, prior).

    What an event gives reaches later dates only: ``before`` is the score that counts until its end, which all
    events that end on one day share.
    """
    from pyspark.sql.window import Window

    rows = residuals.where("delta is not null").join(ends, "event_key").join(priors, "league")
    exact = F.col("delta").cast("decimal(18,1)")
    w = Window.partitionBy("league").orderBy(F.unix_date("end"))
    earlier = F.coalesce(F.sum(exact).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    after = F.sum(exact).over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("double")
    return rows.select("league", "event_key", "end", "delta", half_up(F.col("prior") + earlier, 1).alias("before"), half_up(F.col("prior") + after, 1).alias("score"))


def unresolved(events: DataFrame, most: int = 12, samples: int = 5) -> DataFrame:
    """The events without a league that most matches have, with a few of their teams: ``events`` has event, league, team."""
    from pyspark.sql.window import Window

    rows = events.where("league = 'Unknown'").groupBy("event", "team").agg(F.count("*").alias("n"))
    total = Window.partitionBy("event")
    ranked = rows.withColumns({"sides": F.sum("n").over(total), "teams": F.count("*").over(total), "r": F.row_number().over(total.orderBy(F.col("n").desc(), "team"))}).where(F.col("r") <= samples)
    out = ranked.groupBy("event").agg(F.max("sides").alias("sides"), F.max("teams").alias("teams"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "team"))), lambda x: x.team), ",").alias("samples"))
    return out.orderBy(F.col("sides").desc(), "event").limit(most)


def matches_text(column, text: str):
    return column.rlike(any_case(text))
