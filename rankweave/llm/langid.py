"""Language identification: multinomial naive Bayes over hashed character n-grams.

A bounded sample of labelled documents is counted by Spark; the matrix of log probabilities, of a size that
n-gram buckets and languages fix, is broadcast; batches are scored as sparse sums in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, code_points, held, letters, mix, slices, text_bytes, with_arrow

#: Buckets of n-grams; lengths of n-grams; expected most rows of a language that the model is fitted on.
BUCKET_BITS, NGRAMS, PER_LANGUAGE, SMOOTHING = 17, (1, 2, 3, 4), 4000, 0.5
#: Most languages, which bounds the matrix that is broadcast (at 256: 128 MB).
MOST_LANGUAGES = 256
UNKNOWN = "und"


def gram_buckets(texts: list[str]):
    """For each n-gram length: the bucket at every code point, 2**BUCKET_BITS where no n-gram of one text begins; and where texts begin."""
    import numpy as np

    codes, starts = code_points(texts)
    wide = codes.astype("uint64")
    # The end of the text that each code point belongs to.
    end = np.repeat(starts[1:], np.diff(starts))
    at, out = np.arange(len(codes)), []
    for n in NGRAMS:
        h = np.full(len(codes), n, "uint64")
        for k in range(n):
            m = max(0, len(codes) - k)
            h[:m] = (h[:m] ^ wide[k:]) * np.uint64(0x9E3779B97F4A7C15)
            h[:m] ^= h[:m] >> np.uint64(29)
        bucket = (mix(h) >> np.uint64(64 - BUCKET_BITS)).astype("int64")
        outside = at + n > end
        if n == 1:
            outside |= codes == 32
        bucket[outside] = 1 << BUCKET_BITS
        out.append(bucket)
    return out, starts


@dataclass
class Model:
    languages: list[str]
    log_probability: object  # (2**BUCKET_BITS + 1, languages); the last row is zero
    prior: object

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; (``und``, 0) without a letter or without a fitted language."""
        import numpy as np

        clean = [letters(t) for t in texts]
        out: list[tuple[str, float]] = []
        for a, b in chunked(clean):
            buckets, starts = gram_buckets(clean[a:b])
            score = np.tile(self.prior, (b - a, 1))
            for j in range(len(self.languages)):
                column = self.log_probability[:, j]
                total = sum(np.take(column, x) for x in buckets)
                score[:, j] += np.add.reduceat(total.astype("float64"), starts[:-1])
            for i in range(b - a):
                if not self.languages or not any(map(str.isalpha, clean[a + i])):
                    out.append((UNKNOWN, 0.0))
                    continue
                s = score[i] - score[i].max()
                best = int(s.argmax())
                out.append((self.languages[best], float(1.0 / np.exp(s).sum())))
        return out


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows with a language.

    Of each language, rows are taken by a hash of their text and of the other columns, ``per_language`` of
    them as expected; a language with fewer gives all. Null and empty texts teach nothing; rows without a
    language are left out; repeated rows count each; without any labelled row the model knows no language. More than
    MOST_LANGUAGES languages are an error.
    """
    import numpy as np

    rows = df.where(F.col(lang_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {lang_col}: the model would have no size bound")
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(share)
    others = [F.col(c) for c, kind in df.dtypes if c not in (text_col, lang_col) and not kind.startswith(("map", "variant"))]
    sample = rows.where(F.pmod(F.xxhash64(F.col(text_col), *others), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        held()  # those of other stages go
        import pyarrow as pa

        width = 1 << BUCKET_BITS
        total: dict[str, object] = {}
        for batch in slices(batches):
            langs = batch.column(0).to_pylist()
            clean = [letters(t.decode()) for t in text_bytes(batch, "text")]
            for a, b in chunked(clean):
                buckets, starts = gram_buckets(clean[a:b])
                for lang in set(langs[a:b]):
                    own = np.repeat([x == lang for x in langs[a:b]], np.diff(starts))
                    sums = sum(np.bincount(x[own], minlength=width + 1) for x in buckets)
                    total[lang] = total.get(lang, 0) + sums
        for lang, sums in total.items():
            at = np.flatnonzero(sums[:width])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype("int32")), pa.array(sums[at].astype("int64"))], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    for j, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        counts[own.bucket.to_numpy(), j] = own.n.to_numpy()
    matrix = np.zeros(((1 << BUCKET_BITS) + 1, len(languages)), "float32", order="F")
    matrix[:-1] = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(counts))
    taken = np.array([float(sizes[x]) for x in languages])
    return Model(languages, matrix, np.log(taken / taken.sum()) if len(taken) else taken)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior (0 to 1).

    Null and empty texts and those without a letter are ``und`` with score 0. Every row stays, once;
    repeated rows get equal results; texts are read whole; an empty table gives an empty one; columns of
    ``df`` named lang_pred or score are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        held()  # those of other stages go
        import pyarrow as pa

        found = shared.value.predict([t.decode() for t in text_bytes(batch, text_col)])
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return with_arrow(df, "lang_pred string, score double", make)


def held_out(doc_id):
    """Whether a document is kept from fitting: crc32 of the id's text modulo 4 is 2 (a null id's text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
