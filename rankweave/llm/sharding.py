"""Shards of near-equal bytes by histogram sort, with DataFrame operations only.

Rows are ordered by a digest of their text, then of their id. Fifteen (or n - 1) splitters start as wide
intervals of that order; each round counts, over all partitions, the exact bytes below equally spaced
probes inside the open intervals, and narrows every interval to the gap that holds its target, until the
bytes below a probe meet the tolerance. One exchange then deals all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, unstage, unused

#: Probes of a round in each open interval, as a power of two; the driver gets at most (n - 1) * 2**12 counts a round.
PROBE_BITS = 12
#: Rows of a window that numbers slots on average, and most bits of the key that windows are cut by.
PART_ROWS, SLOT_BITS = 200_000, 20
LOW = -(2**63)


def text_size(text):
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1


def sort_keys(text, doc_id):
    """(key, tie): digests of the text (null as empty) and of the id with the text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(1), text)


def find_splitters(keyed: DataFrame, n: int, tolerance: float = 0.001, group_tolerance: float = 0.01) -> list[tuple[int, int]]:
    """The n - 1 splitters of ``keyed`` (key, tie, size), each the least (key, tie) of the next shard.

    A splitter closes when the exact bytes below it are within ``tolerance`` of a shard's share of the
    target. Where the gap left holds a single text, a splitter at its edge within ``group_tolerance`` is
    taken, so that equal texts stay together; a larger group is split by the tie.
    """
    total = keyed.agg(F.sum("size").alias("s")).first()["s"] or 0
    # An interval: (key prefix, its bits, tie prefix, its bits, bytes below it)
    open_, found = {k: (0, 0, 0, 0, 0) for k in range(1, n)}, {}
    while open_:
        by_tie = {k: v for k, v in open_.items() if v[1] == 64}
        by_key = {k: v for k, v in open_.items() if v[1] < 64}
        for part, column, at in ((by_key, "key", 0), (by_tie, "tie", 2)):
            if not part:
                continue
            for bits in {v[at + 1] for v in part.values()}:
                own = {k: v for k, v in part.items() if v[at + 1] == bits}
                wide = min(64, bits + PROBE_BITS)
                rows = keyed
                if column == "key" and bits:
                    rows = rows.where(F.shiftright("key", 64 - bits).isin(sorted({v[0] for v in own.values()})))
                if column == "tie":
                    rows = rows.where(F.col("key").isin(sorted({v[0] for v in own.values()})))
                    if bits:
                        rows = rows.where(F.shiftright("tie", 64 - bits).isin(sorted({v[2] for v in own.values()})))
                child = F.shiftright(column, 64 - wide) if wide < 64 else F.col(column)
                group = [child.alias("p")] if column == "key" else [F.col("key").alias("k"), child.alias("p")]
                counts = rows.groupBy(*group).agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
                for k, (key, kbits, tie, tbits, below) in own.items():
                    target = total * k / n
                    prefix = key if column == "key" else tie
                    mine = sorted((c for c in counts if (column == "key" or c["k"] == key) and (not bits or c["p"] >> (wide - bits) == prefix)), key=lambda c: c["p"])
                    edge, here = below, None
                    for c in mine:
                        if edge + c["s"] > target:
                            here = c
                            break
                        edge += c["s"]
                    if here is None:  # nothing is left above the target
                        found[k] = (2**63 - 1, 2**63 - 1)
                        continue
                    start = here["p"] << (64 - wide)
                    after = start + (1 << (64 - wide))
                    single = here["lo"] == here["hi"]
                    near = min(target - edge, edge + here["s"] - target)
                    ends = column == "tie" and wide == 64
                    allowed = (group_tolerance if single and column == "key" else tolerance) * total / n
                    if near <= allowed or ends:
                        at_start = target - edge <= edge + here["s"] - target
                        value = start if at_start else after
                        if column == "key":
                            found[k] = (value, LOW)
                        else:
                            found[k] = (key, value) if value < 2**63 else (key + 1, LOW)
                    elif column == "key" and single:
                        open_[k] = (here["lo"], 64, 0, 0, edge)
                    elif column == "key":
                        open_[k] = (here["p"], wide, 0, 0, edge)
                    else:
                        open_[k] = (key, 64, here["p"], wide, edge)
        open_ = {k: v for k, v in open_.items() if k not in found}
    top = (2**63 - 1, 2**63 - 1)
    return [min(found[k], top) for k in sorted(found)]


def shard(df: DataFrame, n: int = 16, text_col: str = "text", id_col: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """``df`` with size, text_crc32, law (``bytes``), shard (0 to n - 1) and slot (gapless from 0 in each shard).

    Shards hold near-equal bytes, and equal texts share a shard unless a splitter falls inside a group
    that is larger than the tolerance. Null texts count as empty ones, with size 1; null ids are values
    like others; repeated rows (same id, same text) stay together, in one window, and take slots of their
    own in any order; an empty table gives an empty one; columns of ``df`` with the names of new ones are replaced.
    """
    key, tie, part, sub, base, bits, size, crc = unused(df, "key", "tie", "part", "sub", "base", "bits", "own_size", "own_crc")
    text = F.col(text_col)
    k, t = sort_keys(text, F.col(id_col))
    keyed = df.withColumns({size: text_size(text), crc: F.crc32(F.coalesce(text, F.lit(""))), key: k, tie: t}).drop("size", "text_crc32", "law", "shard", "slot").withColumnsRenamed({size: "size", crc: "text_crc32"})
    narrow = stage(keyed.select(F.col(key).alias("key"), F.col(tie).alias("tie"), "size"), "shard-keys")
    splitters = find_splitters(narrow, n, tolerance)

    def place(kc, tc):
        return sum(((kc > a) | ((kc == a) & (tc >= b))).cast("int") for a, b in splitters) if splitters else F.lit(0)

    # Slots: rows are counted by (shard, key prefix), and crowded prefixes by digits of the tie too, so that no window holds a hot group whole.
    slot_bits = min(SLOT_BITS, max(PROBE_BITS, (narrow.count() // PART_ROWS).bit_length()))
    prefix = lambda c: F.shiftright(c, 64 - slot_bits).cast("int")
    placed = narrow.select(place(F.col("key"), F.col("tie")).alias("shard"), prefix("key").alias("part"), "tie")
    counts = placed.groupBy("shard", "part").count().collect()  # at most 2**SLOT_BITS + n rows
    mean = max(1, sum(c["count"] for c in counts) // max(1, len(counts)))
    crowded = [(c["shard"], c["part"], min(20, (c["count"] // mean).bit_length())) for c in counts if c["count"] > 4 * mean]
    spark = df.sparkSession
    deep = F.broadcast(spark.createDataFrame(crowded, "shard int, part int, bits int"))

    def dealt(rows, sh, pt, ti, su):
        joined = rows.join(deep.select(F.col("shard").alias(sh), F.col("part").alias(pt), F.col("bits").alias(bits)), [sh, pt], "left")
        return joined.withColumn(su, F.expr(f"case when `{bits}` is null then 0 else cast(shiftrightunsigned({ti}, cast(64 - `{bits}` as int)) as int) end")).drop(bits)

    parts = sorted(dealt(placed, "shard", "part", "tie", "sub").groupBy("shard", "part", "sub").count().collect())
    unstage(narrow)
    bases, last, at = [], None, 0
    for c in parts:
        at = 0 if c["shard"] != last else at
        bases.append((c["shard"], c["part"], c["sub"], at))
        last, at = c["shard"], at + c["count"]
    bases = F.broadcast(spark.createDataFrame(bases, f"shard int, `{part}` int, `{sub}` int, `{base}` long"))
    out = keyed.withColumns({"shard": place(F.col(key), F.col(tie)), part: prefix(key), "law": F.lit("bytes")})
    out = dealt(out, "shard", part, f"`{tie}`", sub)
    window = Window.partitionBy("shard", part, sub).orderBy(key, tie)
    out = out.withColumn("slot", F.row_number().over(window) - 1)
    out = out.join(bases, ["shard", part, sub], "left")
    return out.withColumn("slot", F.col("slot") + F.coalesce(F.col(base), F.lit(0).cast("long"))).drop(key, tie, part, sub, base)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows of ``shard`` as one folder a shard; the exchange of ``shard`` is the only one."""
    sharded.write.partitionBy("shard").parquet(path)
