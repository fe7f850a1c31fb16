"""Joins that reconcile rows of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consumable_match(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows of ``left`` matched with rows of ``right`` on ``keys``, each row used once: the n-th of a key with the n-th.

    The result has ``keys``, ``turn``, and both sides' other columns; rows without a partner are left out.
    Null keys never match.
    """
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return left.withColumn("turn", number(order_left)).join(right.withColumn("turn", number(order_right)), [*keys, "turn"])


def any_key_match(rows: DataFrame, others: DataFrame, keys: list[str], row_id: str, other_id: str) -> DataFrame:
    """For each row, the least ``other_id`` that agrees with it in any of the key columns (nulls never agree).

    Each key's least id is found first, so that a key which many rows of both sides share makes no pairs.
    """

    def long(df, name):
        pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys])
        return df.select(F.col(name), F.explode(pairs).alias("key")).where("key.v is not null").select(name, "key.k", "key.v")

    least = long(others, other_id).groupBy("k", "v").agg(F.min(other_id).alias(other_id))
    found = long(rows, row_id).join(least, ["k", "v"])
    return found.groupBy(row_id).agg(F.min(other_id).alias(other_id))


def dimension_lookup(rows: DataFrame, key: str, dimension: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the columns of the ``dimension`` row that any of its ``names`` columns finds by ``key``, whatever the case.

    Of dimension rows that share a name, the last by ``order`` counts, and of its names the last. Rows that
    find nothing, null keys among them, are left out.
    """
    kept = F.struct(*dimension.columns)
    spelled = F.array(*[F.struct(F.lower(F.col(n).cast("string")).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(names)])
    listed = dimension.select(F.explode(spelled).alias("n"), kept.alias("found"), F.struct(*order).alias("at")).where("n.name is not null")
    last = listed.groupBy(F.col("n.name").alias("lookup_name")).agg(F.max_by("found", F.struct("at", "n.i")).alias("found"))
    out = rows.join(last, F.lower(F.col(key).cast("string")) == F.col("lookup_name"))
    return out.select(*[F.col(c) for c in rows.columns], "found.*")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order``; Spark prunes to group limits before the exchange."""
    return rows.withColumn("first_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("first_rank = 1").drop("first_rank")


def ledger(rows: DataFrame, key: list[str]) -> DataFrame:
    """A row for each key: the columns of ``key`` and ``digest``, the SHA-256 of the other columns in order of name."""
    others = sorted(c for c in rows.columns if c not in key)
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in others])
    return rows.select(*key, F.sha2(joined, 256).alias("digest"))


def ledger_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The keys that were added, removed or changed between two ledgers, with ``change``."""
    both = old.withColumnRenamed("digest", "old_digest").join(new.withColumnRenamed("digest", "new_digest"), key, "full_outer")
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "change")


def apply_changes(base: DataFrame, changed: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """``base`` without the removed and changed keys, and with the changed rows."""
    gone = changed.select(*key).union(removed.select(*key))
    return base.join(gone, key, "left_anti").unionByName(changed)


def classify_changes(diff: DataFrame, last_date) -> DataFrame:
    """One row that names the kind of an update and the date that replay starts from.

    ``diff`` has ``date`` and ``change``; ``last_date`` is the newest date replayed so far. Only later
    additions are an append; additions on that date are a same-day insertion; anything older is a
    historical correction.
    """
    out = diff.agg(F.count("*").alias("changes"), F.min("date").alias("replay_from"), F.coalesce(F.bool_and((F.col("change") == "added") & (F.col("date") > last_date)), F.lit(False)).alias("append"), F.coalesce(F.bool_and((F.col("change") == "added") & (F.col("date") >= last_date)), F.lit(False)).alias("same_day"))
    kind = F.when(F.col("changes") == 0, "no-change").when(F.col("append"), "latest-append").when(F.col("same_day"), "same-day-insertion").otherwise("historical-correction")
    return out.select(kind.alias("kind"), "changes", "replay_from")


def rank_bounds(scores: DataFrame, by: str, score: str, uncertainty: str) -> DataFrame:
    """Best and worst rank of each row: one more than the rows above its score and uncertainty, and above its score less uncertainty.

    Counting sorted events replaces the pairwise comparison: each row asks at two thresholds, and a running
    count over scores answers. Ranks run over the table of ranked entities, a fixed dimension.
    """
    values = scores.select(F.col(score).alias("at"), F.lit(1).alias("weight"), F.lit(None).cast("string").alias("who"), F.lit(0).alias("ask"))
    best = scores.select((F.col(score) + F.col(uncertainty)).alias("at"), F.lit(0).alias("weight"), F.col(by).cast("string").alias("who"), F.lit(1).alias("ask"))
    worst = scores.select((F.col(score) - F.col(uncertainty)).alias("at"), F.lit(0).alias("weight"), F.col(by).cast("string").alias("who"), F.lit(2).alias("ask"))
    events = reduce(DataFrame.union, (values, best, worst))
    above = F.sum("weight").over(Window.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)) - F.sum("weight").over(Window.partitionBy("at"))
    ranked = events.withColumn("rank", (above + 1).cast("long")).where("ask > 0")
    return ranked.groupBy(F.col("who").alias(by)).agg(F.max(F.when(F.col("ask") == 1, F.col("rank"))).alias("best_rank"), F.max(F.when(F.col("ask") == 2, F.col("rank"))).alias("worst_rank"))


def causal_prefix(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many keys of two dated ledgers (key, date, digest) agree before the first date that differs, and that date.

    ``replay_from`` is null where nothing differs; rows before it are proven equal, so a replay may start there.
    """
    a = old.select(*key, F.col("date").alias("old_date"), F.col("digest").alias("a"))
    b = new.select(*key, F.col("date").alias("new_date"), F.col("digest").alias("b"))
    both = a.join(b, key, "full_outer").withColumn("at", F.least("old_date", "new_date"))
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("old_date").eqNullSafe(F.col("new_date"))
    first = both.agg(F.min(F.when(~same, F.col("at"))).alias("replay_from"), F.count_if(~same).alias("changed"))
    return both.crossJoin(F.broadcast(first)).agg(F.count_if(F.col("replay_from").isNull() | (F.col("at") < F.col("replay_from"))).alias("proven"), F.max("changed").alias("changed"), F.max("replay_from").alias("replay_from"))


def enrich_from_schedule(games: DataFrame, schedule: DataFrame) -> DataFrame:
    """``games`` (date, team_a, team_b, best_of) with ``official_match_id`` and the official format where there is one.

    A key is the date and both names' keys in order. Keys that several official matches share are
    ambiguous and match nothing; a schedule row without exactly two teams or a time is left out.
    """
    from ..functions.names import name_key

    def keyed(day, a, b):
        return F.concat_ws("|", F.date_format(day, "yyyy-MM-dd"), F.least(name_key(a), name_key(b)), F.greatest(name_key(a), name_key(b)))

    listed = schedule.where("size(teams) = 2 and at is not null").select(keyed(F.col("at"), F.col("teams")[0]["name"], F.col("teams")[1]["name"]).alias("match_key"), "match_id", F.col("best_of").alias("official_best_of"))
    unique = listed.groupBy("match_key").agg(F.min("match_id").alias("official_match_id"), F.max("official_best_of").alias("official_best_of"), F.countDistinct("match_id").alias("n")).where("n = 1").drop("n")
    out = games.withColumn("match_key", keyed(F.col("date"), F.col("team_a"), F.col("team_b"))).join(unique, "match_key", "left")
    return out.withColumn("best_of", F.coalesce("official_best_of", "best_of")).drop("match_key", "official_best_of")


def enrich_from_duplicates(kept: DataFrame, dropped: DataFrame, key: list[str]) -> DataFrame:
    """``kept`` rows with a longer format and a higher event tier where a dropped duplicate of their key knows one."""
    from ..functions.ratings import EVENT_K, lookup

    weight = lookup(EVENT_K, F.col("tier"), 14)
    better = dropped.groupBy(*key).agg(F.max("best_of").alias("other_best_of"), F.max(F.struct(weight.alias("k"), "tier")).alias("other"))
    out = kept.join(better, key, "left")
    tier = F.when(F.col("other.k") > weight, F.col("other.tier")).otherwise(F.col("tier"))
    return out.withColumns({"best_of": F.greatest("best_of", "other_best_of"), "tier": tier}).drop("other_best_of", "other")


def gap_fill(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """``primary`` and those rows of ``secondary`` whose ``keys`` it lacks, with ``filled``; null keys match nothing."""
    fill = secondary.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.withColumn("filled", F.lit(False)).unionByName(fill.withColumn("filled", F.lit(True)))


def by_provider(games: DataFrame, series: list[str], number: str, priority: dict[str, int]) -> DataFrame:
    """One row for each game number of each series, of the provider with the least priority number; the longest format that any of them knows."""
    rank = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])[F.col("provider")]
    best = Window.partitionBy(*series, number).orderBy(F.coalesce(rank, F.lit(len(priority) + 1)), "game_id")
    rows = games.withColumns({"best_of": F.max("best_of").over(Window.partitionBy(*series)), "provider_rank": F.row_number().over(best)})
    return rows.where("provider_rank = 1").drop("provider_rank")


def match_rankings(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Outer match of two rankings on several keys in order of priority: each row once, by the first key that finds a row.

    Of several finds a row takes the one by the best key and then the least id; rows without any come with a null.
    Keys are compared in lower case without blanks around them; null and blank keys find nothing.
    """

    def long(df, name):
        each = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("how"), F.lower(F.trim(F.col(k).cast("string"))).alias("value")) for i, k in enumerate(keys)])
        return df.select(F.col(name), F.explode(each).alias("k")).where("k.value is not null and k.value <> ''").select(name, "k.*")

    found = long(left, left_id).join(long(right, right_id), ["priority", "how", "value"])
    own = Window.partitionBy(left_id).orderBy("priority", right_id)
    found = found.withColumn("r", F.row_number().over(own)).where("r = 1")
    other = Window.partitionBy(right_id).orderBy("priority", left_id)
    found = found.withColumn("r", F.row_number().over(other)).where("r = 1").select(left_id, right_id, "how")
    out = left.select(left_id).join(found, left_id, "left")
    return out.unionByName(right.select(right_id).join(found, right_id, "left_anti").select(F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), right_id, F.lit(None).cast("string").alias("how")))


def merge_teams(schedule: DataFrame, details: DataFrame, match: str) -> DataFrame:
    """Teams of a schedule with what details know of them: by id, else by name; the schedule's own fields win.

    Both have ``match``, id, name and code; a detail without a team in the schedule is left out.
    """
    from ..functions.names import name_key

    d = details.select(match, F.col("id").alias("d_id"), F.col("name").alias("d_name"), F.col("code").alias("d_code"), name_key(F.col("name")).alias("d_key"))
    by_id = first_of(d.where("d_id is not null"), [match, "d_id"], ["d_name", "d_code"])
    by_name = first_of(d.where("d_key is not null"), [match, "d_key"], ["d_id", "d_code"]).withColumnsRenamed({"d_id": "n_id", "d_name": "n_name", "d_code": "n_code", "d_key": "n_key"})
    rows = schedule.withColumn("s_key", name_key(F.col("name")))
    rows = rows.join(by_id.withColumnRenamed(match, "d_match"), (F.col(match) == F.col("d_match")) & (F.col("id") == F.col("d_id")), "left")
    rows = rows.join(by_name.withColumnRenamed(match, "n_match"), (F.col(match) == F.col("n_match")) & (F.col("s_key") == F.col("n_key")), "left")
    return rows.select(match, F.coalesce("id", "d_id", "n_id").alias("id"), F.coalesce("name", "d_name", "n_name").alias("name"), F.coalesce("code", "d_code", "n_code").alias("code"))


def resolved_ids(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """``players`` (name, team, given) with ``player_id``: that of an alias (alias, id), else the given one, else a digest of name and team.

    Aliases are compared in any case; of repeated ones the least id counts.
    """
    from ..functions.names import name_key

    known = aliases.where("alias is not null and id is not null").groupBy(F.lower(F.trim("alias")).alias("alias_key")).agg(F.min("id").alias("alias_id"))
    rows = players.join(known, F.lower(F.trim("name")) == F.col("alias_key"), "left")
    digest = F.concat(F.lit("unresolved:"), F.sha2(F.concat_ws("|", name_key(F.col("name")), name_key(F.col("team"))), 256))
    return rows.withColumn("player_id", F.coalesce("alias_id", F.nullif(F.trim("given"), F.lit("")), digest)).drop("alias_key", "alias_id")
