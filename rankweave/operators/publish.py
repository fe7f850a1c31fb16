"""Publication: partitioned tables written beside the old ones, budgets, manifests and semantic digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that change with every build and say nothing of the content.
VOLATILE = ("generated_at", "build_id", "run_id")


def semantic_digest(df: DataFrame, key: list[str], volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """A digest of each key's content: volatile columns left out, the others in order of name, rows in any order.

    Rows' SHA-256 are added up in four parts of 60 bits, which tasks do before they exchange, so that a
    key with many rows is gathered nowhere.
    """
    columns = sorted(c for c in df.columns if c not in volatile and c not in key)
    rows = df.select(*key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("row_hash"))
    part = lambda i: F.sum(F.conv(F.substring("row_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return rows.groupBy(*key).agg(F.sha2(F.concat_ws(":", *[part(i) for i in range(4)]), 256).alias("digest"), F.count("*").alias("rows"))


def table_digest(df: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """One row for a table of any size: rows and an order-free checksum that tasks add up, without gathering row digests."""
    columns = sorted(c for c in df.columns if c not in volatile)
    h = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))


def over_budget(df: DataFrame, key: list[str], budget: int) -> DataFrame:
    """The keys whose rows take more than ``budget`` bytes as JSON."""
    return df.groupBy(*key).agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1).alias("bytes")).where(F.col("bytes") > budget)


def publish(df: DataFrame, path: str, by: list[str], budget: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` in folders by ``by`` and return the manifest: rows and bytes of each.

    Only the folders that ``df`` has rows for are replaced. A key over ``budget`` stops the write before it
    begins. Rows of a key are dealt by a second hash, so that a large scope is written by several tasks.
    """
    if budget is not None and (bad := over_budget(df, by, budget).limit(5).collect()):
        raise ValueError(f"over the budget of {budget} bytes: {bad}")
    dealt = df.hint("rebalance", *by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1).alias("bytes"))


def semantic_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or differ between two digest tables."""
    both = old.select(*key, F.col("digest").alias("a")).join(new.select(*key, F.col("digest").alias("b")), key, "full_outer")
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "differs")
    return both.withColumn("what", what).where("what is not null").select(*key, "what")


def pages(df: DataFrame, by: list[str], order: list[str], size: int = 25) -> DataFrame:
    """``df`` with ``page`` in each scope, oldest first, so that earlier pages stay as they are when rows come at the end."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("page", (F.floor((rank - 1) / size) + 1).cast("long"))


def affected_scopes(changed: DataFrame) -> DataFrame:
    """The scopes that changed games (season, tier, league_a, league_b) touch: all, season, tier and leagues."""
    scope = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    return changed.select(F.explode(F.array(scope("all", F.lit("all")), scope("season", F.col("season")), scope("tier", F.col("tier")), scope("league", F.col("league_a")), scope("league", F.col("league_b")))).alias("s")).select("s.*").distinct()
