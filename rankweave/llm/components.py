"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a and b, long): root is the least node reachable.

    Every round is a grouped minimum and a join, and is written out; rounds end when the links are stars.
    Links of a node to itself and repeated links add nothing; null ends are left out; no links give no rows.
    """
    edges = stage(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links", parts(links.count()))
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).alias("s")).first()
        if not mark["n"] or mark == seen:
            out = edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())
            out.stage_path = edges.stage_path
            return out
        seen = mark
        files = parts(mark["n"])
        both = edges.union(edges.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).where("v <> u").distinct()
        large = stage(large, "links", files)
        unstage(edges)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.greatest("u", "m").alias("v"), F.least("u", "m").alias("u"))
        edges = stage(small.union(least).distinct(), "links", files)
        unstage(large)
