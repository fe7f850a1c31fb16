"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

Features are words and word beginnings, as 64-bit hashes. Spark counts them over a bounded sample of
labelled documents and keeps those that mark toxic ones; a proportional-odds model, one weight a feature and
ordered thresholds between grades, is fitted to the sample. The expected grade is the severity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BASE, chunked, code_points, held, letters, mix, slices, stage, text_bytes, unstage, with_arrow

#: Lengths of word beginnings besides whole words (0); expected most rows of a label in the sample; most features; least documents of a feature; least odds.
PREFIXES, PER_LABEL, FEATURES, LEAST, ODDS = (0, 4, 5), 8000, 1024, 5, 30.0
#: Documents that a feature's log odds are drawn to zero by.
PSEUDO = 5.0
#: Least hashes that near copies share all of.
SIGNS = 3


def word_features(texts: list[str]):
    """(feature hash, index of the text) of every feature of texts from ``letters``, and words of each text."""
    import numpy as np

    codes, starts = code_points(texts)
    space = codes == 32
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    # Sums of code points times powers of an odd base: differences, divided by the power, are hashes of parts.
    step = np.uint64(HASH_BASE | 1)
    powers = np.full(len(codes), step, "uint64")
    powers[:1] = 1
    powers = np.cumprod(powers, dtype="uint64")
    back = np.full(len(codes), pow(int(step), -1, 1 << 64), "uint64")
    back[:1] = 1
    back = np.cumprod(back, dtype="uint64")
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(codes.astype("uint64") * powers, dtype="uint64")])
    text = np.searchsorted(starts, begin, "right") - 1
    hashes, owners = [], []
    for k in PREFIXES:
        own = stop - begin > k if k else slice(None)
        a = begin[own]
        b = a + k if k else stop
        hashes.append(mix((sums[b] - sums[a]) * back[a] + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)))
        owners.append(text[own])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(text, minlength=len(texts))


def signatures(texts: list[str]):
    """A digest of SIGNS least hashes of three words in a row of each text, which near copies mostly share; of all words in shorter texts."""
    import numpy as np

    h, owner, words = word_features(texts)
    n = int(words.sum())
    h, owner = h[:n], owner[:n]
    out = np.zeros(len(texts), "uint64")
    if n:
        whole = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        # The sum over mixed (place, word) pairs tells apart all texts that differ.
        place = np.arange(n) - np.repeat(whole, np.diff(np.r_[whole, n]))
        out[owner[whole]] = np.add.reduceat(mix(h + mix(place.astype("uint64"))), whole)
    if n < 3:
        return out
    three = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:])
    inside = owner[:-2] == owner[2:]
    three, owner = three[inside], owner[:-2][inside]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    if len(first):
        out[owner[first]] = 0
        for k in range(SIGNS):
            out[owner[first]] = mix(out[owner[first]] + np.minimum.reduceat(mix(three ^ np.uint64(HASH_BASE * (2 * k + 1) % 2**64)), first))
    return out


@dataclass
class Model:
    features: object  # sorted hashes
    weights: object
    thresholds: object  # ascending; one less than grades

    def __post_init__(self):
        import numpy as np

        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.features & np.uint64(0xFFFF)).astype("int64")] = True

    def hits(self, texts: list[str]):
        """(index of the text, index of the feature, log of 1 + its count) of the model's features in the texts."""
        import numpy as np

        rows, cols, values = [], [], []
        clean = [letters(t) for t in texts]
        for a, b in chunked(clean):
            h, owner, _ = word_features(clean[a:b])
            own = self.sieve[(h & np.uint64(0xFFFF)).astype("int64")]
            h, owner = h[own], owner[own]
            at = np.searchsorted(self.features, h)
            at[at == len(self.features)] = 0
            own = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
            pair, n = np.unique(owner[own].astype("int64") * max(1, len(self.features)) + at[own], return_counts=True)
            rows.append(pair // max(1, len(self.features)) + a)
            cols.append(pair % max(1, len(self.features)))
            values.append(np.log1p(n))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(rows, "int64"), join(cols, "int64"), join(values, "float64")

    def exceed(self, texts: list[str]):
        """For each text, the probability of a grade above each threshold."""
        import numpy as np

        rows, cols, values = self.hits(texts)
        eta = np.bincount(rows, weights=self.weights[cols] * values, minlength=len(texts)) if len(rows) else np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -60, 60)))


def fit_ordinal(rows, cols, values, grades, n_features: int, n_grades: int, l2: float = 1e-5, steps: int = 2000):
    """Weights and ascending thresholds of the proportional-odds model, by full-batch Adam on the sparse rows."""
    import numpy as np

    n = max(1, len(grades))
    w, first, gaps = np.zeros(n_features), np.array(0.0), np.zeros(n_grades - 2)
    state: dict[int, tuple] = {}
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        eta = np.bincount(rows, weights=w[cols] * values, minlength=len(grades)) if len(rows) else np.zeros(len(grades))
        up, low = sigmoid(edges[grades + 1] - eta), sigmoid(edges[grades] - eta)
        up[grades == n_grades - 1], low[grades == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p / n, low * (1 - low) / p / n
        g_eta = d_up - d_low  # of the negative log likelihood by eta
        g_cut = np.array([d_low[grades == k + 1].sum() - d_up[grades == k].sum() for k in range(n_grades - 1)])
        g_w = (np.bincount(cols, weights=g_eta[rows] * values, minlength=n_features) if len(rows) else 0) + l2 * w
        g_gaps = np.array([g_cut[k + 1 :].sum() for k in range(n_grades - 2)]) * np.exp(gaps)
        for i, (x, g) in enumerate(((w, g_w), (first, g_cut.sum()), (gaps, g_gaps))):
            m, v = state.get(i, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * np.square(g)
            state[i] = (m, v)
            x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model of the labelled documents, with grades 0 (not toxic), 1 and 2.

    Labels are 0 or 1, so nothing outside the texts orders the toxic documents: the upper grade is made here,
    and is 2 if a document's marked words weigh more than those of half of the toxic ones, by the log odds of
    each and the log of its count, else 1. Labels of 0, 1 and 2 are taken as grades as they are.
    Of each label, rows are taken by a hash of the id,
    ``per_label`` of them as expected. Null ids, labels and texts teach nothing; repeated labels count
    once; without toxic labels the model has no features and gives every text a severity near 0.
    """
    import numpy as np
    import pyarrow as pa

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1, 2)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, per_label / n)).otherwise(share)
    # At most 3 * per_label ids of 12 bytes, as expected, whatever the tables' sizes: small enough to broadcast.
    ids = F.broadcast(known.where(F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)))
    texts = documents.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(ids, F.col("d_id") == F.col("l_id")).select("label", "text")

    def sign(batch):
        clean = [letters(t.decode()) for t in text_bytes(batch, "text")]
        return [pa.array(np.concatenate([signatures(clean[a:b]) for a, b in chunked(clean)]).view("int64"))] if clean else [pa.array([], pa.int64())]

    # Copies would make their rare words look like marks of their label: one of each group stays.
    sample = stage(with_arrow(sample, "signature long", sign).dropDuplicates(["label", "signature"]).drop("signature"), "labelled")

    def count(batches):
        held()  # those of other stages go
        for batch in slices(batches):
            label = np.array([x > 0 for x in batch.column(0).to_pylist()], "int64")
            clean = [letters(t.decode()) for t in text_bytes(batch, "text")]
            for a, b in chunked(clean):
                h, owner, _ = word_features(clean[a:b])
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, toxic = h[new], label[a:b][owner[new]]
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(first)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view("int64")), pa.array(np.add.reduceat(toxic, at)), pa.array(np.add.reduceat(1 - toxic, at))], names=["feature", "bad", "good"])

    total = sample.groupBy("label").count().collect()
    n_bad = max(1, sum(r["count"] for r in total if r["label"]))
    n_good = max(1, sum(r["count"] for r in total if not r["label"]))
    stats = sample.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.col("bad") / n_bad) / ((F.col("good") + 0.5) / n_good)
    least = max(LEAST, n_bad // 250) if n_bad >= 20 * LEAST else max(1, n_bad // 20)
    chosen = stats.where((F.col("bad") >= least) & (odds >= min(ODDS, n_good / 4))).orderBy(F.col("bad").desc(), "feature").limit(FEATURES).collect()
    features = np.array([r["feature"] for r in chosen], "int64").view("uint64")
    order = np.argsort(features)
    features = features[order]
    # Values are scaled by the shrunken log odds, so that the surest marks learn fastest.
    scale = np.array([np.log(((r["bad"] + PSEUDO) / n_bad) / ((r["good"] + PSEUDO) / n_good)) for r in chosen])[order]
    blank = Model(features, np.zeros(len(features)), np.zeros(2))

    def marks(batch):
        texts = [t.decode() for t in text_bytes(batch, "text")]
        rows, cols, values = blank.hits(texts)
        ends = np.searchsorted(rows, np.arange(len(texts) + 1)).astype("int32")
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(cols.astype("int32"))), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]

    fitted = with_arrow(sample, "cols array<int>, logs array<double>", marks).select("label", "cols", "logs").toPandas() if len(features) else None
    unstage(sample)
    if fitted is None or not len(fitted):
        return Model(features[:0], np.zeros(0), np.array([5.0, 6.0]))
    label = fitted.label.to_numpy()
    rows = np.repeat(np.arange(len(fitted)), [len(c) for c in fitted.cols])
    cols = np.concatenate([np.asarray(c, "int64") for c in fitted.cols])
    values = np.concatenate([np.asarray(c, "float64") for c in fitted.logs])
    evidence = np.bincount(rows, weights=values * scale[cols], minlength=len(fitted))
    middle = np.median(evidence[label > 0]) if (label > 0).any() else 0.0
    grades = label.astype("int64") if (label == 2).any() else np.where(label > 0, 1 + (evidence > middle), 0)
    w, cuts = fit_ordinal(rows, cols, values * scale[cols], grades, len(features), 3)
    return Model(features, w * scale, cuts)


def grade(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``severity`` (the expected grade), ``grade`` (the likeliest) and ``toxic`` (a grade above 0 is likelier than not).

    Null and empty texts get what a text without features gets. Every row stays, once; repeated rows get
    equal results; texts are read whole; an empty table gives an empty one; columns of ``df`` named
    severity, grade or toxic are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        held()  # those of other stages go
        import numpy as np
        import pyarrow as pa

        above = shared.value.exceed([t.decode() for t in text_bytes(batch, text_col)])
        edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        return [pa.array(above.sum(1)), pa.array((edges[:, :-1] - edges[:, 1:]).argmax(1).astype("int32") if len(above) else [], pa.int32()), pa.array(above[:, 0] > 0.5)]

    return with_arrow(df, "severity double, grade int, toxic boolean", make)
