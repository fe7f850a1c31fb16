"""Tournament simulation: many seeded single-elimination brackets, dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simulate_bracket(field: DataFrame, runs: int = 10_000, seed: int = 1, scale: float = 400.0) -> DataFrame:
    """How often each team of ``field`` (slot from 0, team, rating; a power of two rows) reaches each round and wins.

    The field is a bounded table of at most 64 rows. Every run draws from its own seed, so results do not
    hang on how runs are dealt. Rounds are tracked per run as one array of survivors, in Spark: each match
    is a comparison of a hashed uniform number with the expectation.
    """
    teams = [r.asDict() for r in field.orderBy("slot").limit(65).collect()]
    n = len(teams)
    if not n or n & (n - 1) or n > 64:
        raise ValueError("the field must have 1, 2, 4, ... 64 teams")
    spark = field.sparkSession
    ratings = F.array(*[F.lit(float(t["rating"])) for t in teams])
    alive = F.array(*[F.lit(i) for i in range(n)])
    rows = spark.range(runs).select(F.col("id").alias("run"), alive.alias("alive"), F.array().cast("array<int>").alias("past"))
    rounds = n.bit_length() - 1
    for number in range(rounds):

        def match(i, number=number):
            a, b = F.get("alive", i * 2), F.get("alive", i * 2 + 1)
            p = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.get(ratings, b) - F.get(ratings, a)) / scale))
            u = F.pmod(F.xxhash64("run", F.lit(seed), F.lit(number), i), F.lit(1 << 52)) / float(1 << 52)
            return F.when(u < p, a).otherwise(b)

        left = n >> (number + 1)
        rows = rows.withColumn("alive", F.transform(F.sequence(F.lit(0), F.lit(left - 1)), lambda i: match(i))).withColumn("past", F.concat("past", "alive"))
    wins = rows.select(F.explode("past").alias("slot")).groupBy("slot").agg(F.count("*").alias("matches"))
    titles = rows.select(F.explode("alive").alias("slot")).groupBy("slot").agg(F.count("*").alias("titles"))
    out = field.join(wins, "slot", "left").join(titles, "slot", "left")
    return out.select("slot", "team", (F.coalesce("matches", F.lit(0)) / runs).alias("mean_wins"), (F.coalesce("titles", F.lit(0)) / runs).alias("title_chance"))
