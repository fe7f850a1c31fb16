"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves with a codebook each; pairs of codewords are the cells of a product grid. A
vector lives in one cell and traverses the grid from both halves' sorted sequences at once: the next cell is
the least sum of two squared distances to codewords' regions, until that sum passes what a fitted sample needs
for the target recall. In a cell, visitors and residents meet in blocks of bounded size and are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, unstage
from .components import components
from .vectors import matrix, usable

#: Numbers in the sample that codebooks are fitted on, and its most rows; vectors of a cell on average; most codewords of a half.
SAMPLE_NUMBERS, SAMPLE_ROWS, PER_CELL, CODEWORDS = 4_000_000, 16_384, 256, 1024
#: Share of vectors whose visits meet a vector at the least linked cosine: a pair is lost only if both ends' visits miss, about (1 - RECALL) ** 2 of them; rows of a block.
RECALL, BLOCK = 0.985, 1024
#: Seeds of the keys of vectors that are tried until no two vectors have one key.
SEEDS = 4


def traverse(left, right, bound: float):
    """Places (i, j) of a grid of sums of two ascending sequences, in ascending order of ``left[i] + right[j]``, up to ``bound``."""
    ahead = [(left[0] + right[0], 0, 0)] if len(left) and len(right) else []
    out = []
    while ahead and ahead[0][0] <= bound:
        _, i, j = heappop(ahead)
        out.append((i, j))
        if j + 1 < len(right):
            heappush(ahead, (left[i] + right[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(left):
            heappush(ahead, (left[i + 1] + right[0], i + 1, 0))
    return out


@dataclass
class Codebooks:
    """Codewords of both halves, their distances, and the squared bound of a traversal."""

    books: list
    gaps: list
    bound: float = 0.0

    @property
    def width(self) -> int:
        return len(self.books[1])

    def nearness(self, x):
        """For each half: each vector's codeword, and its least squared distance to every codeword's region."""
        import numpy as np

        out, at = [], 0
        for book, gap in zip(self.books, self.gaps, strict=True):
            half = x[:, at : at + book.shape[1]]
            at += book.shape[1]
            d = np.maximum((half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1)[None], 0)
            own = d.argmin(1)
            least = (d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])
            out.append((own, np.square(np.maximum(least, 0))))
        return out

    def cells(self, x):
        (a, _), (b, _) = self.nearness(x)
        return a * self.width + b

    def visits(self, x):
        """(cell, visited cells nearest first) of each vector."""
        import numpy as np

        (a, la), (b, lb) = self.nearness(x)
        out = []
        for i in range(len(x)):
            near = []
            for least in (la[i], lb[i]):
                order = np.flatnonzero(least <= self.bound)
                order = order[np.argsort(least[order], kind="stable")]
                near.append((order.tolist(), least[order].tolist()))
            (wa, sa), (wb, sb) = near
            out.append(np.array([wa[j] * self.width + wb[k] for j, k in traverse(sa, sb, self.bound)], "int32"))
        return (a * self.width + b).astype("int32"), out


def _codebook(x, k: int, rng, rounds: int = 12):
    import numpy as np

    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        book[n > 0] = sums[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            book[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return np.unique(book, axis=0)


def fit(sample, count: int, cosine: float, recall: float = RECALL) -> Codebooks:
    """Codebooks of the unit vectors ``sample`` for an index of ``count`` vectors.

    The bound is the one that, for a share ``recall`` of sampled vectors moved in a random direction to
    exactly ``cosine``, covers the cell that the moved vector lies in.
    """
    import numpy as np

    rng = np.random.default_rng(17)
    k = int(min(CODEWORDS, max(2, round((count / PER_CELL) ** 0.5))))
    cut = max(1, sample.shape[1] // 2)
    halves = [sample[:, :cut], sample[:, cut:]] if sample.shape[1] > 1 else [sample, np.zeros((len(sample), 1))]
    books = [_codebook(h, k, rng) for h in halves]
    gaps = []
    for b in books:
        gap = np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(2), 1e-18)) if len(b) * len(b) * b.shape[1] < 2e7 else np.sqrt(np.maximum((b**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * b @ b.T, 1e-18))
        np.fill_diagonal(gap, 1.0)
        gaps.append(gap)
    made = Codebooks(books, gaps)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(1)[:, None] * sample
    size = np.sqrt((noise**2).sum(1))[:, None]
    moved = cosine * sample + np.sqrt(max(0.0, 1 - cosine**2)) * noise / np.where(size > 0, size, 1)
    (_, la), (_, lb) = made.nearness(sample)
    (a, _), (b, _) = made.nearness(moved)
    at = np.arange(len(sample))
    made.bound = float(np.quantile(la[at, a] + lb[at, b], recall)) + 1e-12
    return made


def normal(x):
    """Rows scaled to length 1, in doubles; scaling by the largest component first keeps squares from running over or under."""
    import numpy as np

    x = x.astype("float64")
    x /= np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _links(units: DataFrame, width: int, kind: str, cosine: float, recall: float) -> DataFrame:
    """(key, links, label) from every meeting: how many vectors a class was newly linked to there, and the least key it was connected to."""
    import numpy as np

    spark = units.sparkSession
    count = units.count()
    rows = min(SAMPLE_ROWS, max(64, SAMPLE_NUMBERS // width))
    drawn = units.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < min(1.0, rows / max(1, count)) * (1 << 20)).select("unit").toPandas().unit
    if len(drawn) < 2:
        drawn = units.select("unit").limit(64).toPandas().unit
    sample = normal(np.frombuffer(b"".join(drawn), kind).reshape(-1, width))
    model = spark.sparkContext.broadcast(fit(sample, count, cosine, recall))

    def assign(batches):
        import pyarrow as pa

        for batch in slices(batches):
            cells, visits = model.value.visits(normal(matrix(batch.column("unit"), width, kind)))
            ends = np.cumsum([0, *map(len, visits)]).astype("int32")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "unit")), pa.array(cells), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits)))], names=["key", "n", "unit", "cell", "visits"])

    placed = stage(units.select("key", "n", "unit").mapInArrow(assign, "key long, n long, unit binary, cell int, visits array<int>"), "cells")
    # Blocks of a cell: at most as many rows as the grid has cells, CODEWORDS ** 2 of 12 bytes (12 MB).
    homes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("o"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    blocks = F.broadcast(homes.join(guests, "cell").select(F.col("cell").alias("at"), "o", "g"))

    def spread(rows, own, other):
        """A row for each unit (at, o, g) that it belongs to."""
        mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.select("*", mine.alias("mine"), every.alias("every")).drop("o", "g").withColumnsRenamed({"mine": own, "every": other})

    residents = spread(placed.select(F.col("cell").alias("at"), "key", "n", "unit", "cell", "visits").join(blocks, "at"), "o", "g").withColumn("guest", F.lit(False))
    visitors = spread(placed.select(F.explode("visits").alias("at"), "key", "n", "unit", "cell").join(blocks, "at"), "g", "o").withColumns({"guest": F.lit(True), "visits": F.lit(None).cast("array<int>")})
    names = ["at", "o", "g", "key", "n", "unit", "cell", "visits", "guest"]

    def meet(table):
        import pyarrow as pa

        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        key, n, cell = (np.asarray(table.column(c).to_numpy()) for c in ("key", "n", "cell"))
        x = normal(matrix(table.column("unit"), width, kind))
        xi, yi = np.flatnonzero(guest), np.flatnonzero(~guest)
        linked = (x[xi] @ x[yi].T >= cosine) & (key[xi][:, None] != key[yi][None])
        if not linked.any():
            return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        # A pair that meets the other way round too is counted by each visitor; else here for both.
        homes_here, home = np.unique(cell[xi], return_inverse=True)
        back = np.zeros((len(yi), len(homes_here)), bool)
        visits = table.column("visits").combine_chunks()
        for j, i in enumerate(yi.tolist()):
            seen = visits[i].values.to_numpy()
            at = np.searchsorted(homes_here, seen)
            at[at == len(homes_here)] = 0
            back[j, at[homes_here[at] == seen]] = True
        alone = linked & ~back[:, home].T
        links = np.zeros(len(key), "int64")
        links[xi] = linked @ n[yi]
        links[yi] = n[xi] @ alone
        label, top = key.copy(), np.iinfo("int64").max
        while True:
            old = label.copy()
            label[xi] = np.minimum(label[xi], np.where(linked, label[yi][None], top).min(1))
            label[yi] = np.minimum(label[yi], np.where(linked, label[xi][:, None], top).min(0))
            if (old == label).all():
                break
        own = (links > 0) | (label != key)
        return pa.table({"key": pa.array(key[own]), "links": pa.array(links[own]), "label": pa.array(label[own])})

    met = residents.select(names).unionByName(visitors.select(names)).groupBy("at", "o", "g").applyInArrow(meet, "key long, links long, label long")
    out = stage(met, "met")
    unstage(placed)
    return out


def similar_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, n_links, component_id, kept.

    Cosines are taken in double precision; vectors of one length are compared with each other. Null,
    empty and zero vectors and those with null or non-finite components link with nothing: they have 0
    links and their own id as component, and are kept. Equal vectors are one class and linked. Rows with a
    null id are linked as others, never give the component its id, and have a null ``kept``; a component
    without any id has a null one. Repeated rows count as rows. An empty table gives an empty one; other
    columns of ``df`` are ignored.
    """
    # Vectors travel as they are, in four bytes a component if that is their type, and are scaled where they are compared.
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.transform("v", lambda x: x + F.lit(0).cast("float" if single else "double"))))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            columns = batch.column("v")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array([len(u) for u in columns], pa.int32()), pa.array([u.values.to_numpy().astype(kind).tobytes() for u in columns], pa.binary())], names=["key", "n", "width", "unit"])

    for seed in range(SEEDS):
        keyed = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v")).alias("key"))
        info = stage(keyed.select("id", "key"), "ids")
        unit = keyed.where("v is not null").groupBy("v").agg(F.first("key").alias("key"), F.count("*").alias("n"))
        units = stage(unit.select("key", "n", "v").mapInArrow(pack, "key long, n long, width int, unit binary"), "units")
        if units.groupBy("key").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"vectors with equal 64-bit keys under {SEEDS} seeds")
    widths = [r["width"] for r in units.select("width").distinct().collect()]
    spark = df.sparkSession
    met = [_links(units.where(F.col("width") == w), w, kind, cosine, recall) for w in widths]
    parts = met
    met = reduce(DataFrame.union, met) if met else spark.createDataFrame([], "key long, links long, label long")
    roots = components(met.select(F.col("key").alias("a"), F.col("label").alias("b")))
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    classes = info.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = classes.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    classes = stage(classes.select("key", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "classes")
    unstage(units, roots, *parts)
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = classes.join(least, "root").select("key", "n_links", "component_id")
    out = info.join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
