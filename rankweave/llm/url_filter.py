"""URL allow and block rules by host suffix and path prefix.

Each distinct (host, path) is expanded into the host-suffix/path-prefix expressions that the rule table
can hold, the expressions are joined to the rules on the first 32 bits of their SHA-256, and a hit counts
only where the whole digests agree. Of several fitting rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused

#: Most bytes of rules that are broadcast, at RULE_BYTES a rule besides its text; beyond it the join shuffles, with the urls' side salted.
BROADCAST_BYTES, RULE_BYTES = 32 << 20, 128
SALTS = 32


def url_parts(url):
    """(host, path) columns of a url: the host follows the first ``://``, A-Z lower-cased; both are empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host):
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(expression):
    return F.sha2(expression, 256)


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with columns host, path, rule and verdict; every row stays, once.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest ``host + path`` wins, then the longer host, then ``block``.
    A url without a fitting rule gets a null rule and the verdict ``default``.

    Null urls and urls without ``://`` have an empty host and path and no rule; rules with null or empty
    hosts are ignored, repeated rules count once; repeated rows are judged each; columns of ``df`` named
    host, path, rule or verdict are replaced; an empty table gives an empty one. Long hosts cost no more
    than short ones, since only suffixes and prefixes as long as some rule's are made.
    """
    host, path = url_parts(F.col(url_col))
    own_host, own_path = unused(df, "own_host", "own_path")
    base = df.withColumns({own_host: host, own_path: path}).drop("host", "path", "rule", "verdict").withColumnsRenamed({own_host: "host", own_path: "path"})
    rules = rules.where("host is not null and host <> '' and path is not null").select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    # What lengths the rules have: at most as many pairs as rules, in practice a handful.
    shapes = rules.select(_labels(F.col("r_host")).alias("n"), F.length("r_path").alias("m")).distinct().orderBy("n", "m").collect()
    rules = (
        rules.withColumn("r_rule", F.concat("r_host", "r_path"))
        .groupBy("r_host", "r_path", "r_rule")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .select("r_rule", "r_verdict", F.length("r_host").alias("r_len"), _digest(F.col("r_rule")).alias("r_digest"))
        .withColumn("r_prefix", F.substring("r_digest", 1, 8))
    )
    keys = base.select("host", "path").distinct()
    if not shapes:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shape = F.array(*[F.struct(F.lit(s.n).alias("n"), F.lit(s.m).alias("m")) for s in shapes])
    fits = F.filter(shape, lambda s: (s.n <= _labels(F.col("host"))) & (s.m <= F.length("path")))
    expanded = (
        keys.select("host", "path", F.explode(fits).alias("s"))
        .select("host", "path", F.expr("concat(substring_index(host, '.', -s.n), substring(path, 1, s.m))").alias("e"))
        .withColumn("digest", _digest(F.col("e")))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    if (rules.agg(F.sum(F.octet_length("r_rule") + RULE_BYTES).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        hits = expanded.join(F.broadcast(rules), F.col("prefix") == F.col("r_prefix"))
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = expanded.withColumn("deal", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
        hits = dealt.join(salted, (F.col("prefix") == F.col("r_prefix")) & (F.col("deal") == F.col("salt")))
    best = (
        hits.where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r_rule").alias("len"), "r_len", F.col("r_verdict").alias("verdict"), F.col("r_rule").alias("rule"))).alias("b"))
        .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    )
    return base.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
