"""Publication in two phases: a plan of what to write, every document checked, written beside the old ones, and an index that is switched last.

Documents lie at ``data/<artifact>/generation=<generation>/doc_key=<key>``. The index of a generation says for each
artifact and key which generation holds its rows; a build writes only what changed and takes the rest over from
the index before. One small file names the generation that counts, and readers go through it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import semantic_digest
from .storage import delete, publish_file, read_file, write_back

INDEX = "artifact string, doc_key string, generation string, rows long, bytes long, digest string"


class Rejected(ValueError):
    """A build whose documents do not pass; nothing of it is published."""


@dataclass
class Artifact:
    """Rows of documents that have ``doc_key``; ``checks`` must be true of every row, ``unique`` columns are distinct within a document, and none takes more than ``budget`` bytes."""

    name: str
    rows: DataFrame
    checks: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    budget: int | None = None


def documents(artifact: Artifact) -> DataFrame:
    """(doc_key, rows, bytes, digest) of an artifact's documents; volatile columns do not count in the digest."""
    size = artifact.rows.groupBy("doc_key").agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1).alias("bytes"))
    return semantic_digest(artifact.rows, ["doc_key"]).join(size, "doc_key").select(F.lit(artifact.name).alias("artifact"), "doc_key", "rows", "bytes", "digest")


def faults(artifact: Artifact) -> DataFrame:
    """(artifact, doc_key, fault, rows) of all that is wrong with an artifact: rows that fail a check, a null key, repeated rows, documents over budget."""
    rows = artifact.rows.withColumn("fault", F.explode(F.array_compact(F.array(F.when(F.col("doc_key").isNull(), "no-key"), *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in artifact.checks.items()]))))
    found = rows.groupBy("doc_key", "fault").agg(F.count("*").alias("rows"))
    if artifact.unique:
        twice = artifact.rows.groupBy("doc_key", *artifact.unique).count().where("count > 1")
        found = found.unionByName(twice.groupBy("doc_key").agg(F.lit("repeated").alias("fault"), F.sum("count").alias("rows")))
    if artifact.budget is not None:
        found = found.unionByName(documents(artifact).where(F.col("bytes") > artifact.budget).select("doc_key", F.lit("over-budget").alias("fault"), "rows"))
    return found.select(F.lit(artifact.name).alias("artifact"), "doc_key", "fault", "rows")


@dataclass
class Site:
    spark: SparkSession
    root: str

    def current(self) -> dict | None:
        """The record of the generation that counts: its name, and the one before."""
        text = read_file(self.spark, f"{self.root}/CURRENT.json")
        return None if text is None else json.loads(text)

    def index(self) -> DataFrame:
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(f"{self.root}/index/{now['generation']}")

    def read(self, artifact: str, schema: str) -> DataFrame:
        """The rows of an artifact as published; the index prunes the folders that are read."""
        wanted = self.index().where(F.col("artifact") == artifact).select("doc_key", "generation")
        if wanted.isEmpty():
            return self.spark.createDataFrame([], f"{schema}, doc_key string")
        rows = self.spark.read.schema(f"{schema}, doc_key string, generation string").parquet(f"{self.root}/data/{artifact}")
        return rows.join(wanted, ["doc_key", "generation"]).drop("generation")

    def plan(self, artifacts: list[Artifact], affected: DataFrame | None = None) -> DataFrame:
        """(artifact, doc_key, action, rows, bytes, digest, generation) of a build: ``write`` what is new or differs, ``keep`` what does not, ``remove`` what is no longer there.

        With ``affected`` (artifact, doc_key) only those documents are looked at, and all others are kept as
        they are. Artifacts that the build does not bring are kept too.
        """
        fresh = None
        for a in artifacts:
            own = documents(a)
            fresh = own if fresh is None else fresh.unionByName(own)
        old = self.index().select("artifact", "doc_key", *[F.col(c).alias(f"old_{c}") for c in ("rows", "bytes", "digest", "generation")])
        brought = F.col("artifact").isin([a.name for a in artifacts])
        if affected is not None:
            marks = affected.select("artifact", "doc_key").distinct().withColumn("marked", F.lit(True))
            fresh = fresh.join(marks, ["artifact", "doc_key"], "left_semi")
            old = old.join(marks, ["artifact", "doc_key"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)) & brought)
        else:
            old = old.withColumn("marked", brought)
        both = old.join(fresh, ["artifact", "doc_key"], "full_outer")
        action = F.when(F.col("digest").isNull(), F.when(F.col("marked"), "remove").otherwise("keep")).when(F.col("digest") == F.col("old_digest"), "keep").otherwise("write")
        kept = F.col("action") == "keep"
        pick = lambda c: F.when(kept, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
        return both.withColumn("action", action).select("artifact", "doc_key", "action", pick("rows"), pick("bytes"), pick("digest"), F.when(kept, F.col("old_generation")).alias("generation"))

    def build(self, artifacts: list[Artifact], generation: str, affected: DataFrame | None = None) -> DataFrame:
        """Check, write and publish a generation; returns its plan.

        All documents that will be written are checked before the first is written; what was written is read
        back and compared with the plan; the index is written, and only then the generation counts. A build that
        fails before leaves readers with the old one, and may be run again under its name.
        """
        now = self.current()
        if now and now["generation"] == generation:
            return self.spark.read.parquet(f"{self.root}/plan/{generation}")
        # Plan, checks and documents all read what the artifacts' rows are made into here, once.
        drafts = f"{self.root}/draft/{generation}"
        artifacts = [Artifact(a.name, write_back(a.rows, f"{drafts}/{a.name}"), a.checks, a.unique, a.budget) for a in artifacts]
        try:
            return self._build(artifacts, generation, affected, now)
        finally:
            delete(self.spark, drafts)

    def _build(self, artifacts: list[Artifact], generation: str, affected: DataFrame | None, now: dict | None) -> DataFrame:
        self.plan(artifacts, affected).write.mode("overwrite").parquet(f"{self.root}/plan/{generation}")
        plan = self.spark.read.parquet(f"{self.root}/plan/{generation}")
        writes = plan.where("action = 'write'")
        chosen = []
        for a in artifacts:
            own = writes.where(F.col("artifact") == a.name).select("doc_key")
            chosen.append(Artifact(a.name, a.rows.join(own, "doc_key", "left_semi"), a.checks, a.unique, a.budget))
            bad = faults(Artifact(a.name, a.rows.where("doc_key is null").unionByName(chosen[-1].rows), a.checks, a.unique, a.budget)).limit(20).collect()
            if bad:
                raise Rejected(f"{a.name}: {', '.join(f'{r.fault} in {r.doc_key} ({r.rows} rows)' for r in bad)}")
        for a in chosen:
            # Documents are dealt by key and a second hash by size, so that a large one is written by several tasks.
            a.rows.hint("rebalance", "doc_key").write.mode("overwrite").partitionBy("doc_key").parquet(f"{self.root}/data/{a.name}/generation={generation}")
            back = self.spark.read.schema(a.rows.schema).parquet(f"{self.root}/data/{a.name}/generation={generation}")
            found = documents(Artifact(a.name, back.select(a.rows.columns)))
            own = writes.where(F.col("artifact") == a.name)
            if not own.select("doc_key", "rows", "digest").exceptAll(found.select("doc_key", "rows", "digest")).isEmpty():
                raise Rejected(f"{a.name}: what was written is not what was planned")
        index = plan.where("action <> 'remove'").select("artifact", "doc_key", F.coalesce("generation", F.lit(generation)).alias("generation"), "rows", "bytes", "digest")
        index.write.mode("overwrite").parquet(f"{self.root}/index/{generation}")
        publish_file(self.spark, f"{self.root}/CURRENT.json", json.dumps({"generation": generation, "before": now and now["generation"]}))
        return plan
