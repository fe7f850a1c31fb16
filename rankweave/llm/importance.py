"""Importance resampling towards a target distribution over hashed word n-grams.

Identical texts are collapsed by grouping the full text; each distinct text gets its features once, its
counts are multiplied by its number of copies, and its weight goes back to all its documents before noise of
their own decides which are drawn.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, slices, stage, text_bytes, unstage, unused

#: Buckets that a process remembers, and their longest feature in bytes; both bound memory and never change a bucket.
CACHE, LONGEST = 400_000, 48
#: Every ASCII character but letters and digits parts words; A-Z are lower-cased.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """The bucket of a feature, looked up in a bounded cache."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        out = zlib.crc32(feature) % self.buckets
        if len(self) < CACHE and len(feature) <= LONGEST:
            self[feature] = out
        return out


def _features(df: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(digest, copies, n_words, n_features, features) of the distinct texts of ``df`` (columns text, copies); features are little-endian buckets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Buckets(buckets)
        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        for batch in slices(batches):
            n_words, features = [], []
            for text in text_bytes(batch, "text"):
                words = text.translate(WORD_BYTES).split()
                n_words.append(len(words))
                own = [known[w] for w in words]
                for n in range(2, longest + 1):
                    own += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
                features.append(np.array(own, kind).tobytes())
            size = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array([len(f) // size for f in features], pa.int64()), pa.array(features, pa.binary())], names=["digest", "copies", "n_words", "n_features", "features"])

    return df.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text").mapInArrow(run, "digest binary, copies long, n_words long, n_features long, features binary")


def _collapsed(df: DataFrame, text_col: str) -> DataFrame:
    """(text, copies) of the distinct texts; null is empty."""
    return df.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def _totals(features: DataFrame, buckets: int):
    """How often each bucket occurs over all documents, copies included: an array of ``buckets`` numbers."""
    import numpy as np

    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, "int64")
        for batch in batches:
            held = batch.column(1).to_pylist()
            copies = np.repeat(batch.column(0).to_numpy(), [len(f) // np.dtype(kind).itemsize for f in held])
            total += np.bincount(np.frombuffer(b"".join(held), kind), weights=copies, minlength=buckets).astype("int64")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, "int64")
    for r in features.select("copies", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target, raw) -> list[int]:
    """A bucket's gain: floor(1000 ln) of its smoothed share of the target over its smoothed share of the raw documents."""
    n, all_target, all_raw = len(raw), int(target.sum()) + len(raw), int(raw.sum()) + len(raw)
    return [math.floor(1000 * math.log(((int(target[i]) + 1) * float(all_raw)) / ((int(raw[i]) + 1) * float(all_target)))) for i in range(n)]


def noise(seed: int, doc_id):
    """Gumbel noise in thousandths from the document's id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    r"""``df`` without its text, which is shuffled once only, and with ``n_features``, ``weight``, ``score`` and ``rank``; the documents with a rank are drawn.

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased; features are all runs of
    1 to ``longest`` words. A weight is the sum of the gains of a text's features; a score adds noise of the
    document. Of the documents with at least ``min_words`` words, ``percent`` of a hundred (rounded down) are
    drawn by highest score, ties to the smaller id, and ranked from 1.

    Null and empty texts have no features and weight 0. Repeated rows count and are drawn each, in any order among
    themselves. A null id counts as empty text for the noise and comes first among ties. An empty target or ``df`` has
    counts of zero; an empty ``df`` gives an empty table; columns of ``df`` named as new ones are replaced.
    ``buckets`` bounds what goes through the driver.
    """
    features = stage(_features(_collapsed(df, text_col), buckets, longest), "features")
    wanted = stage(_features(_collapsed(target, target_col), buckets, longest), "target_features")
    shared = df.sparkSession.sparkContext.broadcast(gains(_totals(wanted, buckets), _totals(features, buckets)))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        gain = np.array(shared.value, "int64")
        for batch in batches:
            weight = [int(gain[np.frombuffer(f, kind)].sum()) for f in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["digest", "n_words", "n_features", "weight"])

    weights = features.select("digest", "n_words", "n_features", "features").mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long")
    new = ("n_features", "weight", "score", "rank")
    kept = [c for c in df.columns if c.lower() not in new and c != text_col]
    text_digest, n_words, place, part, skipped = unused(df, "text_digest", "n_words", "place", "part", "skipped")
    scored = df.select(*kept, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias(text_digest)).join(weights.withColumnsRenamed({"digest": text_digest, "n_words": n_words}), text_digest).drop(text_digest)
    scored = stage(scored.withColumn("score", F.col("weight") + noise(seed, F.col(id_col))), "scored")
    unstage(wanted, features)
    able = scored.where(F.col(n_words) >= min_words)
    n = able.count()
    # Ranges of scores, each sorted by its own task; rows before a range are counted from its number.
    order = [F.col("score").desc(), F.col(id_col).asc()]
    ranked = stage(able.repartitionByRange(parts(n), *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    counts = sorted((r[part], r["count"]) for r in ranked.groupBy(F.shiftright(place, 33).alias(part)).count().collect())
    before, at = [], 0
    for number, size in counts:
        before.append((number, at))
        at += size
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], f"{part} long, {skipped} long")
    rank = F.col(skipped) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = ranked.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part).withColumn("rank", F.when(rank <= n * percent // 100, rank))
    rest = scored.where(F.col(n_words) < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [*kept, *new]
    return drawn.select(columns).unionByName(rest.select(columns))
