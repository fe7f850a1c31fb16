"""Polling a schedule as streams: coverage of probes by feed, pending matches with retries, and acknowledgement.

All three work in event time. Rows wait in state until the watermark has passed them and are then worked on in
order of time, so that results do not depend on how rows fall into batches. State ends by its timers.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .completion import LATER_MINUTES, RETRY_MINUTES

#: Fixed value: a feed without a watermark is asked for so many hours back.
RECOVERY_HOURS = 48
MINUTE, HOUR = 60_000, 3_600_000


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages (feed, probe, page, checked_at, older, events with start_time) with the earliest and latest time of their events instead of these."""
    times = F.transform("events", lambda e: e.start_time)
    return pages.select("feed", "probe", "page", "checked_at", "older", F.array_min(times).alias("earliest"), F.array_max(times).alias("latest"))


def close_probe(held: dict, rows: list[list]) -> dict:
    """The outcome of one probe, and ``held`` (watermark, covered intervals) after it.

    ``rows`` are (probe, checked, page, earliest, latest, older) in milliseconds, a page maybe several times.
    Consecutive pages cover the time between their events without a gap. A probe is complete when its pages
    from the first on reach the target, or the schedule's end; together with what earlier probes covered it
    may be ``covered`` without being complete. Only then the watermark moves.
    """
    pages = {r[2]: r for r in rows}
    checked = max(r[1] for r in rows)
    target = held["watermark"] if held["watermark"] is not None else checked - RECOVERY_HOURS * HOUR
    runs: list[list] = []
    for number in sorted(pages):
        _, _, _, earliest, latest, _ = pages[number]
        if not runs or runs[-1][0] != number - 1:
            runs.append([number, number, None, None])
        run = runs[-1]
        run[0] = number
        if earliest is not None:
            run[2] = earliest if run[2] is None else min(run[2], earliest)
            run[3] = latest if run[3] is None else max(run[3], latest)
    first = runs[0] if runs[0][1] == 0 else None
    # The schedule has no older page: everything before is covered as well.
    ended = first is not None and not pages[first[0]][5]
    complete = ended or first is not None and first[2] is not None and first[2] <= target
    merged: list[list] = []
    own = [[target if r is first and ended else r[2], r[3]] for r in runs if r[2] is not None]
    for a, b in sorted([*held["covered"], *([min(x, y), y] for x, y in own)]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    end = first[3] if first else None
    covered = complete or end is not None and any(a <= target and end <= b for a, b in merged)
    if covered:
        held["watermark"] = max(target, end if end is not None else checked)
    held["covered"] = [x for x in merged if held["watermark"] is None or x[1] >= held["watermark"]]
    return {"checked": checked, "target": target, "start": min((r[2] for r in runs if r[2] is not None), default=None), "end": max((r[3] for r in runs if r[3] is not None), default=None), "pages": len(pages), "complete": complete, "covered": covered, "watermark": held["watermark"]}


def _numbers(values):
    return [None if v != v or v is None else int(v) for v in values]


def _in_time(columns: tuple[str, ...]) -> list:
    """Milliseconds back as timestamps, which no time zone of a session changes."""
    return [F.timestamp_millis(F.col(c)).alias(c) for c in columns]


def probes(pages: DataFrame, patience: str = "1 hour") -> DataFrame:
    """A stream of closed probes out of page rows (``page_rows``): what they covered, and the feed's watermark after each.

    A probe closes when the stream's time is ``patience`` past it; pages that come later are dropped, and
    missing ones leave it incomplete. State is what lies open, the covered intervals above the watermark, and
    the watermark: it does not grow with the past.
    """

    def run(key, frames, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {"watermark": None, "covered": [], "open": []}
        for frame in frames:
            held["open"] += [list(r) for r in zip(*(_numbers(frame[c]) for c in ("probe", "checked", "page", "earliest", "latest", "older")), strict=True)]
        now, out = state.getCurrentWatermarkMs(), []
        by_probe: dict = {}
        for row in held["open"]:
            by_probe.setdefault(row[0], []).append(row)
        due = {p: max(r[1] for r in rows) for p, rows in by_probe.items()}
        for p in sorted((p for p, t in due.items() if t <= now), key=lambda p: (due[p], p)):
            out.append({"feed": key[0], "probe": p} | close_probe(held, by_probe.pop(p)))
        held["open"] = [r for rows in by_probe.values() for r in rows]
        state.update((json.dumps(held),))
        if held["open"]:
            state.setTimeoutTimestamp(max(now + 1, min(due[p] for p in by_probe)))
        if out:
            yield pd.DataFrame(out).astype(dict.fromkeys(times, "Int64"))

    times = ("checked", "target", "start", "end", "watermark")
    schema = "feed string, probe long, checked long, target long, start long, end long, pages int, complete boolean, covered boolean, watermark long"
    rows = pages.withWatermark("checked_at", patience).select("feed", "probe", "page", "checked_at", F.unix_millis("checked_at").alias("checked"), F.unix_millis("earliest").alias("earliest"), F.unix_millis("latest").alias("latest"), F.col("older").cast("int").alias("older"))
    closed = rows.groupBy("feed").applyInPandasWithState(run, schema, "held string", "append", "EventTimeTimeout")
    return closed.select("feed", "probe", *_in_time(times), "pages", "complete", "covered").select("feed", "probe", "checked", "target", "start", "end", "pages", "complete", "covered", "watermark")


def advance(held: dict, until: int, give_up: int, keep: int) -> list[tuple[str, int, int]]:
    """(event, attempts, time) of one match up to time ``until``, in order of time; ``held`` moves along.

    ``held`` has rows (time, whether acknowledged) that wait, when the match was detected, attempts so far, the
    next attempt, and when it was acknowledged. The first attempt comes at once, later ones as ``completion`` has
    it. An acknowledgement at the very time of an attempt comes first; one of a match that is not pending
    says nothing. ``give_up`` after it was detected a match expires; ``keep`` after its acknowledgement it may be
    forgotten, until then more completions say nothing.
    """
    out = []
    held["rows"].sort()
    while True:
        pending = held["detected"] is not None and held["acknowledged"] is None
        row = held["rows"][0][0] if held["rows"] else None
        expiry = held["detected"] + give_up if pending else held["acknowledged"] + keep if held["acknowledged"] is not None else None
        # Of equal times: acknowledgements and completions, then the end, then attempts.
        steps = [(t, order) for order, t in enumerate((row, expiry, held["next"] if pending else None)) if t is not None]
        if not steps or min(steps)[0] > until:
            return out
        t, what = min(steps)
        if what == 0:
            acknowledged = held["rows"].pop(0)[1]
            if acknowledged and pending:
                held["acknowledged"] = t
                out.append(("acknowledged", held["attempts"], t))
            elif not acknowledged and held["detected"] is None:
                held.update(detected=t, next=t, attempts=0)
                out.append(("pending", 0, t))
        elif what == 1:
            if pending:
                out.append(("expired", held["attempts"], t))
            held.update(detected=None, next=None, attempts=0, acknowledged=None)
        else:
            held["attempts"] += 1
            minutes = RETRY_MINUTES[held["attempts"] - 1] if held["attempts"] <= len(RETRY_MINUTES) else LATER_MINUTES
            held["next"] = t + minutes * MINUTE
            out.append(("attempt", held["attempts"], t))


def pending_matches(rows: DataFrame, delay: str = "1 hour", give_up_hours: int = 72, keep_hours: int = 72) -> DataFrame:
    """A stream of (match_id, event, attempts, at) out of rows (match_id, at, acknowledged): ``pending`` once, each ``attempt``, and ``acknowledged`` or ``expired``.

    Rows that come more than ``delay`` late are dropped. A match's state ends ``give_up_hours`` after it was
    detected without an acknowledgement, or ``keep_hours`` after it; so the store holds recent matches only.
    """

    def run(key, frames, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else {"rows": [], "detected": None, "next": None, "attempts": 0, "acknowledged": None}
        for frame in frames:
            held["rows"] += [[t, bool(a)] for t, a in zip(_numbers(frame["ms"]), frame["acknowledged"], strict=True)]
        now = state.getCurrentWatermarkMs()
        out = advance(held, now, give_up_hours * HOUR, keep_hours * HOUR)
        pending = held["detected"] is not None and held["acknowledged"] is None
        following = [t for t in (held["rows"] and min(held["rows"])[0], held["next"] if pending else None, held["acknowledged"] and held["acknowledged"] + keep_hours * HOUR) if t]
        if following:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(now + 1, min(following)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"match_id": [key[0]] * len(out), "event": [x[0] for x in out], "attempts": pd.array([x[1] for x in out], "int32"), "at": [x[2] for x in out]})

    timed = rows.where("at is not null").withWatermark("at", delay).select("match_id", "at", F.unix_millis("at").alias("ms"), "acknowledged")
    moved = timed.groupBy("match_id").applyInPandasWithState(run, "match_id string, event string, attempts int, at long", "held string", "append", "EventTimeTimeout")
    return moved.select("match_id", "event", "attempts", *_in_time(("at",)))


def attempts_within(lasted: Column) -> Column:
    """Attempts of a match that was pending for ``lasted`` milliseconds; one at its very end does not come."""
    starts = list(accumulate((0, *RETRY_MINUTES)))
    first = sum((F.when(lasted > m * MINUTE, 1).otherwise(0) for m in starts), F.lit(0))
    later = F.floor((lasted - starts[-1] * MINUTE - 1) / (LATER_MINUTES * MINUTE))
    return (first + F.greatest(later, F.lit(0))).cast("int")


def outcomes(rows: DataFrame, delay: str = "1 hour", give_up_hours: int = 72, keep_hours: int = 72) -> DataFrame:
    """How the matches of ``pending_matches`` ended: (match_id, event, attempts, at), ``acknowledged`` or ``expired``, without the steps before.

    All of it are Spark's own expressions over session windows, for feeds with too many matches to call Python
    for each. What a match leaves has ended when its rows stop for as long as giving up and keeping take, so a
    session holds all rows that hang on each other; it is folded once the watermark has passed its end, that is
    later than ``pending_matches`` tells. Rows have to come at most ``delay`` late.
    """
    give_up, keep = give_up_hours * HOUR, keep_hours * HOUR
    row = F.struct(F.unix_millis("at").alias("t"), F.coalesce("acknowledged", F.lit(False)).alias("done"))
    timed = rows.where("at is not null").withWatermark("at", delay)
    lives = timed.groupBy("match_id", F.session_window("at", f"{give_up_hours + keep_hours} hours")).agg(F.collect_list(row).alias("rows"))
    none = F.lit(None).cast("long")
    end = lambda event, t, lasted: F.array(F.struct(F.lit(event).alias("event"), t.alias("t"), lasted.alias("lasted")))
    state = lambda detected, acknowledged, out: F.struct(detected.alias("detected"), acknowledged.alias("acknowledged"), out.alias("out"))
    start = state(none, none, F.array().cast("array<struct<event:string,t:bigint,lasted:bigint>>"))

    def step(s, r):
        # What is due before the row comes first; of equal times the row does.
        expired = s.detected.isNotNull() & s.acknowledged.isNull() & (s.detected + give_up < r.t)
        over = expired | F.coalesce(s.acknowledged + keep < r.t, F.lit(False))
        detected, acknowledged = F.when(~over, s.detected), F.when(~over, s.acknowledged)
        now = r.done & detected.isNotNull() & acknowledged.isNull()
        out = F.when(expired, F.concat(s.out, end("expired", s.detected + give_up, F.lit(give_up)))).otherwise(s.out)
        out = F.when(now, F.concat(s.out, end("acknowledged", r.t, r.t - s.detected))).otherwise(out)
        return state(F.when(~r.done & detected.isNull(), r.t).otherwise(detected), F.when(now, r.t).otherwise(acknowledged), out)

    def last(s):
        return F.when(s.detected.isNotNull() & s.acknowledged.isNull(), F.concat(s.out, end("expired", s.detected + give_up, F.lit(give_up)))).otherwise(s.out)

    ended = lives.select("match_id", F.explode(F.aggregate(F.array_sort("rows"), start, step, last)).alias("e"))
    return ended.select("match_id", "e.event", attempts_within(F.col("e.lasted")).alias("attempts"), F.timestamp_millis("e.t").alias("at"))


def acknowledgements(pending: DataFrame, reconciled: DataFrame, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Every pending match (match_id, at) once, with the time of the exact reconciliation (match_id, status, reconciled_at) that acknowledges it, or null.

    A stream-to-stream outer join: a reconciliation counts from the match's time on until ``within`` after it; once
    both feeds are past that, a match without one comes out with a null. Of several reconciliations of one
    match that come within ``delay`` of each other, the first to arrive counts; those that are not exact never do.
    """
    p = pending.withWatermark("at", delay).dropDuplicatesWithinWatermark(["match_id"]).alias("p")
    r = reconciled.where("status = 'exact'").withWatermark("reconciled_at", delay).dropDuplicatesWithinWatermark(["match_id"]).alias("r")
    inside = F.expr(f"p.match_id = r.match_id AND r.reconciled_at >= p.at AND r.reconciled_at <= p.at + interval {within}")
    return p.join(r, inside, "left_outer").select("p.match_id", "p.at", "r.reconciled_at")


def drain(stream: DataFrame, path: str, name: str, schema: str | None = None) -> DataFrame:
    """Run a stream until its input is read and its last timers have fired, and read back what it wrote below ``path``."""
    run = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(f"{path}/{name}")
