"""Incremental runs: what changed, what may be kept, and what has to be replayed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reconcile import causal_prefix

#: Fixed value: deltas of a partition after which it is written anew.
MOST_DELTAS = 32
#: The surfaces whose proofs a run needs together.
SURFACES = ("sourced-player", "dss-team", "dss-region", "roster-era", "player-resume")
#: A refresh begins so many days before what is covered, and goes so far back without any.
OVERLAP_DAYS, FIRST_DAYS = 2, 30


def mutations(old: DataFrame, new: DataFrame, key: list[str], partition: list[str]) -> DataFrame:
    """What turns one inventory (key, digest, partition) into another: a row for each added, replaced or deleted key with the digest before and after.

    A row that moves to another partition is deleted in the old one and added in the new one.
    """
    a = old.select(*key, *partition, F.col("digest").alias("before"))
    b = new.select(*key, *partition, F.col("digest").alias("after"))
    both = a.join(b, [*key, *partition], "full_outer")
    action = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "delete").when(F.col("before") != F.col("after"), "replace")
    return both.withColumn("action", action).where("action is not null").select(*key, *partition, "action", "before", "after")


def refused(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The changes that do not fit ``base`` (key, digest): an added key that is there, or one whose digest is not the one before."""
    rows = changes.join(base.select(*key, F.col("digest").alias("present")), key, "left")
    why = F.when((F.col("action") == "add") & F.col("present").isNotNull(), "already-there").when((F.col("action") != "add") & ~F.col("before").eqNullSafe(F.col("present")), "other-digest")
    return rows.withColumn("why", why).where("why is not null").select(*key, "action", "why")


def rebaseline(deltas: DataFrame, partition: list[str]) -> DataFrame:
    """Partitions with their number of deltas (delta_no), and whether they are due to be written anew."""
    out = deltas.groupBy(*partition).agg(F.countDistinct("delta_no").alias("deltas"), F.count("*").alias("rows"))
    return out.withColumn("due", F.col("deltas") > MOST_DELTAS)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: the digest of a set of files (path, digest), whatever their order. Files are listed one a source and stay few."""
    line = F.concat_ws("=", "path", "digest")
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count("*").alias("files"))


def safe_checkpoint(checkpoints: DataFrame, changed_from: Column) -> DataFrame:
    """The newest checkpoint (boundary, digest, proven) before the first changed date whose proof holds; none if there is no such."""
    fits = checkpoints.where(F.coalesce(F.col("boundary") < changed_from, F.lit(True)) & F.col("proven"))
    return fits.orderBy(F.col("boundary").desc(), "digest").limit(1)


def proof_bundle(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """For each surface of two dated ledgers (surface, key, date, digest): rows proven, changed, and where its replay starts; a surface without rows is missing."""
    each = []
    for surface in SURFACES:
        pick = lambda df, s=surface: df.where(F.col("surface") == s)
        proof = causal_prefix(pick(old), pick(new), key)
        rows = pick(new).agg(F.count("*").alias("rows"))
        each.append(proof.crossJoin(rows).select(F.lit(surface).alias("surface"), "rows", "proven", F.coalesce("changed", F.lit(0)).alias("changed"), "replay_from", (F.col("rows") == 0).alias("missing")))
    return reduce(DataFrame.union, each)


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events (event, start, end, teams) whose structure differs between two contracts: added, removed, moved or with other teams."""
    a = old.select("event", *[F.col(c).alias(f"old_{c}") for c in ("start", "end", "teams")])
    b = new.select("event", "start", "end", "teams")
    both = a.join(b, "event", "full_outer")
    moved = ~(F.col("old_start").eqNullSafe(F.col("start")) & F.col("old_end").eqNullSafe(F.col("end")))
    what = F.when(F.col("old_teams").isNull(), "added").when(F.col("teams").isNull(), "removed").when(moved, "calendar").when(F.col("old_teams") != F.col("teams"), "structure")
    return both.withColumn("what", what).where("what is not null").select("event", "what")


def refresh_window(covered: Column, now: Column) -> Column:
    """(start, end) of the dates that a refresh asks for: a little before what is covered, or a month back without any."""
    start = F.coalesce(F.date_sub(covered, OVERLAP_DAYS), F.date_sub(now, FIRST_DAYS))
    return F.struct(F.least(start, now).alias("start"), now.alias("end"))


def keep_partitions(old: DataFrame, fresh: DataFrame, partition: list[str]) -> DataFrame:
    """A directory after a partial publication: the fresh partitions' rows, and the old ones of all other partitions."""
    return fresh.unionByName(old.join(fresh.select(*partition).distinct(), partition, "left_anti"))


def prefix_faults(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a dated ledger that no proof may stand on: repeated keys, no date, or a digest that is no SHA-256."""
    w = Window.partitionBy(*key)
    fault = F.when(F.count("*").over(w) > 1, "repeated").when(F.col("date").isNull(), "no-date").when(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad-digest")
    return rows.withColumn("fault", fault).where("fault is not null").select(*key, "fault")


def document_faults(documents: DataFrame, schema: str, key: str, text: str) -> DataFrame:
    """Published documents whose JSON text does not parse or lacks a field of the DDL ``schema``: (key, fault)."""
    parsed = F.from_json(F.col(text), schema)
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]
    missing = F.array_compact(F.array(*[F.when(parsed[n].isNull(), n) for n in names]))
    whole = F.when(F.get_json_object(text, "$").isNull(), "not-json").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    return documents.withColumn("fault", whole).where("fault is not null").select(key, "fault")


def index_faults(index: DataFrame, shards: DataFrame, key: list[str]) -> DataFrame:
    """Where an index (key, rows) and its shards' rows (key) disagree."""
    have = shards.groupBy(*key).agg(F.count("*").alias("present"))
    both = index.select(*key, F.col("rows").alias("listed")).join(have, key, "full_outer")
    what = F.when(F.col("present").isNull(), "no-shard").when(F.col("listed").isNull(), "not-listed").when(F.col("present") != F.col("listed"), "other-count")
    return both.withColumn("what", what).where("what is not null").select(*key, "listed", "present", "what")


def checkpoint_digests(state: DataFrame, boundary: str, key: str, values: list[str]) -> DataFrame:
    """For each boundary of a state table, its rows and the digest of its lines in order of key. A state has a row a team, so that a boundary's lines are few."""
    line = F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(v).cast("string"), F.lit("~")) for v in values])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return state.groupBy(boundary).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x.line), "\n"), 256).alias("digest"))


def read_checkpoint(state: DataFrame, boundary: str, at, key: str, values: list[str], digest: str) -> DataFrame:
    """The rows of one boundary; a digest that is not the one on record stops the read."""
    rows = state.where(F.col(boundary) == at)
    found = checkpoint_digests(rows, boundary, key, values).first()
    if found is None or found["digest"] != digest:
        raise ValueError(f"the checkpoint of {at} does not have the digest on record")
    return rows


def parity(full: DataFrame, incremental: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys of two states with whether all their values agree; a key that one of them lacks does not."""
    a = full.select(*key, *[F.col(v).alias(f"a_{v}") for v in values])
    b = incremental.select(*key, *[F.col(v).alias(f"b_{v}") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & (F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance)
    return a.join(b, key, "full_outer").select(*key, F.coalesce(same, F.lit(False)).alias("same"))
