"""Incremental runs: a stream of changed series keeps a ledger, rating states, forecasts and season boards up to date.

Every table lies in folders ``<table>/version=<version>/period=<month>``. A commit record says which version of which
period counts; it is written last and in one step, so that readers see a whole run or none of it. A batch that
runs again finds its own record, or writes over what it left without one. The states at the ends of months are
the checkpoints: a run replays from the last one before the earliest change whose proof holds, and everything
where there is none.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import replay
from ..operators.incremental import parity
from ..operators.storage import delete, names_in, publish_file, read_file

SERIES = "series_id long, date date, season long, patch string, team_a string, team_b string, league_a string, league_b string, tier string, games long, wins_a long, wins_b long, last_winner string, best_of long, state string, winner string"
#: What a rating depends on; the other columns only show.
SCORING = ("date", "team_a", "team_b", "league_a", "league_b", "tier", "games", "best_of", "state", "winner")
LEDGER = f"{SERIES}, scoring string, shown string, period long"
STATES = "team string, rating double, uncertainty double, frozen double, frozen_uncertainty double, period long"
SCORED = "series_id long, date date, team string, opponent string, p double, observed double, delta double, lost double, period long"
BOARDS = "team string, series long, points double, expected double, period long"
SCHEMAS = {"ledger": LEDGER, "states": STATES, "scored": SCORED, "boards": BOARDS}


class Refused(ValueError):
    """An incremental run that cannot be proven; a full one takes its place."""


def digest(columns) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def ledger_rows(series: DataFrame) -> DataFrame:
    """``series`` as ledger rows: digests of what is scored and of what is only shown, and the month."""
    rows = replay.with_period(series.select([c.split()[0] for c in SERIES.split(", ")]))
    return rows.withColumn("scoring", digest(SCORING)).withColumn("shown", digest(("season", "patch", "wins_a", "wins_b", "last_winner"))).select([c.split()[0] for c in LEDGER.split(", ")])


def checksums(rows: DataFrame) -> dict[int, list]:
    """Rows and order-free checksums of each period, which tasks add up: [rows, xor, sum]."""
    h = F.xxhash64(*[c for c in rows.columns if c != "period"])
    found = rows.groupBy("period").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("s")).collect()  # a row a month
    return {r["period"]: [r["n"], r["x"], r["s"]] for r in found}


@dataclass
class Store:
    """Versioned tables and commit records below ``root``, a folder that all machines share."""

    spark: SparkSession
    root: str

    def latest(self) -> dict | None:
        """The commit record with the highest number, or None."""
        names = [n for n in names_in(self.spark, f"{self.root}/commits") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return None
        record = json.loads(read_file(self.spark, f"{self.root}/commits/{names[-1]}"))
        for part in ("tables", "proofs"):
            record[part] = {t: {int(p): v for p, v in own.items()} for t, own in record[part].items()}
        return record

    def commit(self, record: dict) -> dict:
        """Publish a record: the step from which on its run counts."""
        publish_file(self.spark, f"{self.root}/commits/{record['epoch']:012d}.json", json.dumps(record, sort_keys=True))
        return self.latest()

    def write(self, table: str, version: str, rows: DataFrame, files: int | None = None) -> None:
        """Write a version, over what a run without a record left of it."""
        rows = rows.coalesce(files) if files else rows.repartition("period")
        rows.write.mode("overwrite").partitionBy("period").parquet(f"{self.root}/{table}/version={version}")

    def read(self, table: str, versions: dict[int, str], where=lambda period: True) -> DataFrame:
        """The rows of the periods that ``versions`` names, each in its version."""
        paths = [f"{self.root}/{table}/version={v}/period={p}" for p, v in sorted(versions.items()) if where(p)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}").parquet(*paths).select(columns)

    def current(self, table: str) -> DataFrame:
        """The table as of the last commit."""
        record = self.latest()
        return self.read(table, record["tables"][table] if record else {})

    def vacuum(self) -> int:
        """Delete versions that the last commit does not name; the number of folders deleted. Not while a run or a reader is under way."""
        used = {(t, v) for t, own in self.latest()["tables"].items() for v in own.values()}
        gone = 0
        for table in SCHEMAS:
            for name in names_in(self.spark, f"{self.root}/{table}"):
                if name.startswith("version=") and (table, name.removeprefix("version=")) not in used:
                    gone += delete(self.spark, f"{self.root}/{table}/{name}")
        return gone


def net_changes(changes: DataFrame) -> DataFrame:
    """The last change of each series by ``seq``: the series' columns and ``deleted``. A series without a date cannot be placed and is left as it was."""
    columns = [c.split()[0] for c in SERIES.split(", ")]
    rest = F.struct("deleted", *[c for c in columns if c != "series_id"])
    return changes.groupBy("series_id").agg(F.max_by(rest, "seq").alias("row")).select("series_id", "row.*").where("deleted or date is not null")


def classify(previous: DataFrame, net: DataFrame) -> dict:
    """What a batch does to the ledger: kind, reasons, the earliest date, and the periods that it touches.

    ``latest-append``: only new series, all after the latest date; ``same-day-insertion``: only new ones, on dates
    that are there; ``metadata-only``: nothing that ratings depend on; else ``historical-correction``.
    """
    old = previous.select("series_id", F.col("date").alias("old_date"), F.col("period").alias("old_period"), F.col("scoring").alias("old_scoring"), F.col("shown").alias("old_shown"))
    both = ledger_rows(net).join(net.select("series_id", "deleted"), "series_id").join(old, "series_id", "left")
    known, deleted = F.col("old_scoring").isNotNull(), F.col("deleted")
    what = F.when(~known & ~deleted, "added").when(known & deleted, "deleted").when(known & ~deleted & (F.col("scoring") != F.col("old_scoring")), "changed").when(known & ~deleted & (F.col("shown") != F.col("old_shown")), "shown")
    rows = both.withColumn("what", what).where("what is not null")
    days = previous.select(F.col("date").alias("known_date")).distinct()
    latest = F.lit(previous.agg(F.max("date")).first()[0])
    rows = rows.join(days, F.col("date") == F.col("known_date"), "left")
    earliest = F.min(F.when(F.col("what") != "shown", F.least("date", "old_date")))
    touched = F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(F.when(F.col("what") != "deleted", F.col("period")), F.col("old_period"))))))  # months
    counts = [F.count_if(F.col("what") == w).alias(w) for w in ("added", "deleted", "changed", "shown")]
    late, same = F.min(F.coalesce(F.col("date") > latest, F.lit(True))).alias("late"), F.min(F.col("known_date").isNotNull()).alias("same")
    r = rows.agg(*counts, earliest.alias("earliest"), touched.alias("periods"), late, same).first()
    scored = r["added"] + r["deleted"] + r["changed"]
    if not scored + r["shown"]:
        kind = "no-change"
    elif not scored:
        kind = "metadata-only"
    elif r["deleted"] + r["changed"] + r["shown"] == 0 and r["late"]:
        kind = "latest-append"
    elif r["deleted"] + r["changed"] + r["shown"] == 0 and r["same"]:
        kind = "same-day-insertion"
    else:
        kind = "historical-correction"
    reasons = [reason for reason, n in (("match-added", r["added"]), ("match-deleted", r["deleted"]), ("match-changed", r["changed"]), ("shown-changed", r["shown"])) if n]
    return {"kind": kind, "reasons": reasons, "earliest": r["earliest"], "periods": sorted(r["periods"] or []), "added": r["added"], "deleted": r["deleted"], "changed": r["changed"] + r["shown"]}


def first_period(earliest) -> int:
    return earliest.year * 12 + earliest.month - 1


def checkpoint_before(store: Store, last: dict, period: int, config: str, prefix: bool) -> int | None:
    """The last checkpoint before ``period`` whose state still has the checksum on record; with ``prefix``, so must the ledger up to it.

    None where no state is needed, since nothing was played before. ``Refused`` where there are checkpoints and none fits.
    """
    if last["config"] != config:
        raise Refused("configuration-changed")
    earlier = [p for p in last["tables"]["states"] if p < period]
    if not earlier:
        return None
    ledger = checksums(store.read("ledger", last["tables"]["ledger"], lambda p: p < period)) if prefix else last["proofs"]["ledger"]
    bad = [p for p in last["tables"]["ledger"] if p < period and ledger.get(p) != last["proofs"]["ledger"][p]]
    for p in sorted(earlier, reverse=True):
        if any(b <= p for b in bad):
            continue
        if checksums(store.read("states", last["tables"]["states"], lambda q, p=p: q == p)).get(p) == last["proofs"]["states"][p]:
            return p
    raise Refused("no-checkpoint-proven")


def replay_from(store: Store, version: str, ledger: dict[int, str], boundary: int | None, states: dict[int, str]) -> list[int]:
    """Write the states, scored rows and season boards of all months after ``boundary``; returns these months. One job a month joins states by team."""
    spark = store.spark
    months = [p for p in sorted(ledger) if boundary is None or p > boundary]
    columns = [c.split()[0] for c in STATES.split(", ")][:-1]
    none = spark.createDataFrame([], STATES).select(columns)
    state = none if boundary is None else store.read("states", states, lambda p: p == boundary).select(columns)
    for table in ("states", "scored"):
        store.write(table, version, spark.createDataFrame([], SCHEMAS[table]), 1)
    # Teams begin in the month of their first series, so that no state knows of later ones.
    teams = store.read("ledger", ledger, lambda p: p in set(months)).select("period", F.explode(F.array("team_a", "team_b")).alias("team"))
    fresh = teams.groupBy("team").agg(F.min("period").alias("since")).join(state, "team", "left_anti")
    path = f"{store.root}/entrants/version={version}"
    fresh.select("team", F.lit(replay.START).alias("rating"), F.lit(replay.UNCERTAIN).alias("uncertainty"), "since").coalesce(4).write.mode("overwrite").parquet(path)
    entrants = spark.read.schema("team string, rating double, uncertainty double, since long").parquet(path)
    begin = {r["since"] for r in entrants.select("since").distinct().collect()}  # months
    before = boundary
    for p in months:
        rows = store.read("ledger", ledger, lambda q, p=p: q == p)
        days = 0 if before is None else (p - before) * replay.PERIOD_DAYS
        state = state.select("team", replay.decayed(F.col("rating"), F.lit(float(days))).alias("rating"), "uncertainty")
        if p in begin:
            state = state.unionByName(entrants.where(F.col("since") == p).drop("since"))
        path = f"{store.root}/states/version={version}/period={p}"
        replay.step(state, replay.score_period(rows, state)).coalesce(4).write.mode("overwrite").parquet(path)
        state = spark.read.schema(none.schema).parquet(path)
        before = p
    fresh = {p: version for p in months}
    frozen = store.read("states", fresh).select("period", "team", F.col("frozen").alias("rating"), F.col("frozen_uncertainty").alias("uncertainty"))
    scored = replay.score_period(store.read("ledger", ledger, lambda p: p in fresh), frozen)
    store.write("scored", version, scored.select([c.split()[0] for c in SCORED.split(", ")]))
    return months


def boards(scored: DataFrame) -> DataFrame:
    """Series, points and expected points of each team by season (as ``period``, the first month's number)."""
    season = (F.floor(F.col("period") / 12) * 12).cast("long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    return scored.groupBy("team", season.alias("season")).agg(F.count("*").alias("series"), exact("observed").alias("points"), exact("p").alias("expected")).select("team", "series", "points", "expected", F.col("season").alias("period"))


def _tables(store: Store, version: str, last: dict | None, ledger: dict[int, str], boundary: int | None) -> dict[str, dict[int, str]]:
    """Replay after ``boundary`` and build the boards of the seasons that this changes: the versions of all tables."""
    states = last["tables"]["states"] if last else {}
    months = replay_from(store, version, ledger, boundary, states)
    kept = lambda own: {p: v for p, v in own.items() if boundary is not None and p <= boundary}
    tables = {"ledger": ledger} | {t: kept(last["tables"][t] if last else {}) | {p: version for p in months} for t in ("states", "scored")}
    # A month of which no series is completed has no scored rows.
    own = {r["period"] for r in store.spark.read.schema(SCORED).parquet(f"{store.root}/scored/version={version}").select("period").distinct().collect()}
    tables["scored"] = {p: v for p, v in tables["scored"].items() if v != version or p in own}
    season = 0 if boundary is None else (boundary + 1) // 12 * 12
    store.write("boards", version, boards(store.read("scored", tables["scored"], lambda p: p >= season)))
    seasons = {p // 12 * 12 for p in tables["scored"] if p >= season}
    tables["boards"] = {p: v for p, v in (last["tables"]["boards"] if last else {}).items() if p < season} | {p: version for p in seasons}
    return tables


def _proofs(store: Store, last: dict | None, tables: dict) -> dict:
    """Checksums of the ledger and of states by month; those of months that keep their version are carried on."""
    out = {}
    for table in ("ledger", "states"):
        old = last["tables"][table] if last else {}
        fresh = {p: v for p, v in tables[table].items() if old.get(p) != v}
        found = checksums(store.read(table, fresh)) if fresh else {}
        out[table] = {p: found[p] if p in fresh else last["proofs"][table][p] for p in tables[table]}
    return out


def apply_changes(store: Store, changes: DataFrame, epoch: int, config: str = "1", mode: str = "gated", prefix: bool = False) -> dict:
    """Bring all tables up to date with one batch of changes (``seq``, ``deleted`` and a series' columns) and return the commit record.

    A batch whose number is committed changes nothing. ``mode``: ``gated`` replays after the last safe checkpoint,
    ``shadow`` does so and replays everything too, publishes the full run and records whether both agree, ``full``
    only replays everything. Whatever keeps an incremental run from being proven or finished is recorded as
    ``fallback``, and a full run takes its place. The season boards of untouched seasons keep their version.
    """
    last = store.latest()
    if last and last["epoch"] >= epoch:
        return last
    version = f"{epoch:012d}"
    old = last["tables"] if last else {t: {} for t in SCHEMAS}
    net = net_changes(changes)
    path = f"{store.root}/changes/version={version}"
    net.write.mode("overwrite").parquet(path)
    net = store.spark.read.schema(net.schema).parquet(path)
    previous = store.read("ledger", old["ledger"])
    found = classify(previous, net)
    record = {"epoch": epoch, "config": config, "fallback": None, "parity": None, "replayed": 0, "boundary": None} | {k: v for k, v in found.items() if k not in ("earliest", "periods")}
    if found["kind"] == "no-change" and last and last["config"] == config and mode == "gated":
        return store.commit(record | {"tables": old, "proofs": last["proofs"]})
    touched = found["periods"]
    rest = store.read("ledger", old["ledger"], lambda p: p in touched).join(net.select("series_id"), "series_id", "left_anti")
    store.write("ledger", version, rest.unionByName(ledger_rows(net.where("not deleted")).where(F.col("period").isin(touched))))
    own = {r["period"] for r in store.spark.read.schema(LEDGER).parquet(f"{store.root}/ledger/version={version}").select("period").distinct().collect()} if touched else set()
    ledger = {p: v for p, v in old["ledger"].items() if p not in touched} | {p: version for p in own}

    tables, boundary = None, None
    if mode != "full":
        try:
            if last is None:
                raise Refused("no-state")
            boundary = checkpoint_before(store, last, first_period(found["earliest"]) if found["earliest"] else 10**9, config, prefix)
            if found["kind"] == "metadata-only":
                tables = old | {"ledger": ledger}
            else:
                tables = _tables(store, version, last, ledger, boundary)
        except (Refused, PySparkException, Py4JJavaError) as error:
            record["fallback"] = str(error) if isinstance(error, Refused) else type(error).__name__
            tables = None
    if mode == "shadow" and tables is not None:
        full = _tables(store, f"{version}-full", None, ledger, None)
        sides = [store.read("states", t["states"]) for t in (full, tables)]
        same = parity(*sides, ["period", "team"], ["rating", "uncertainty"])
        record["parity"] = same.where("not same").isEmpty()
        tables, boundary = full, None
    elif tables is None:
        tables, boundary = _tables(store, f"{version}-full", None, ledger, None), None
    record["boundary"] = boundary
    record["replayed"] = sum(v.startswith(version) for v in tables["states"].values())
    return store.commit(record | {"tables": tables, "proofs": _proofs(store, last, tables)})


def standings(store: Store) -> DataFrame:
    """Rating and uncertainty of every team at the end of the ledger."""
    record = store.latest()
    states = record["tables"]["states"] if record else {}
    end = max(states, default=None)
    return store.read("states", states, lambda p: p == end).select("team", half_up(F.col("rating"), 2).alias("rating"), half_up(F.col("uncertainty"), 2).alias("uncertainty"))


def run(changes: DataFrame, store: Store, config: str = "1", mode: str = "gated", prefix: bool = False, load=None):
    """Start a stream that applies each batch of changes; it stops when all are read, and goes on where it stopped when started anew.

    ``load`` gives the changes of a batch, where the stream only names what holds them.
    """
    rows = load or (lambda batch: batch)
    return changes.writeStream.option("checkpointLocation", f"{store.root}/progress").foreachBatch(lambda batch, epoch: apply_changes(store, rows(batch), epoch, config, mode, prefix) and None).trigger(availableNow=True).start()
