"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks; each block keeps, for every dimension, its rows sorted by that component.
A query reads the lists that its own components favour in step, scores each row when it is first seen, and
stops once the sum of what all lists can still offer is below its k-th score. Blocks' results are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .vectors import usable

#: Rows of a block of candidates and of queries, and how many entries of each list are read first.
CANDIDATES, QUERIES, FIRST = 8192, 2048, 8


class SortedLists:
    """The rows of a block, sorted by each dimension."""

    def __init__(self, ids, rows):
        self.ids, self.rows = ids, rows
        self.order = rows.argsort(axis=0, kind="stable")  # ascending by column

    def top(self, query, own, k: int, floor: int | None = None):
        """(positions, scores) of the k best rows but those with the id ``own``, or of those of them that reach ``floor``; ties go to smaller ids."""
        import numpy as np

        n, width = self.rows.shape
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is 0
            found = np.flatnonzero(self.ids != own)
            found = found[np.argsort(self.ids[found], kind="stable")[:k]]
            return found, np.zeros(len(found), query.dtype)
        down = query[dims] > 0
        seen = self.ids == own
        best, scores = np.zeros(0, "int64"), np.zeros(0, query.dtype)
        depth, step = 0, FIRST
        while depth < n:
            last = min(n, depth + step)
            ranks = np.arange(depth, last)
            entries = self.order[np.where(down[None], n - 1 - ranks[:, None], ranks[:, None]), dims[None]]
            fresh = np.zeros(n, bool)
            fresh[entries.ravel()] = True
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            best, scores = np.concatenate([best, fresh]), np.concatenate([scores, self.rows[fresh] @ query])
            if len(best) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                best, scores = best[keep], scores[keep]
            offer = (self.rows[entries[-1], dims] * query[dims]).sum()
            if floor is not None and offer < floor or len(best) >= k and offer < scores.min():
                break
            depth, step = last, step * 2
        order = np.lexsort((self.ids[best], -scores))[:k]
        return best[order], scores[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, ``id_col``, score) of every query's ``k`` highest scores, all if fewer.

    Components become ``floor(scale * x)`` of x as double; scores are integer inner products, exact while
    they fit a long. Rows with a query's id are not its candidates. Ties go to the smaller id. Rows with a
    null id, and vectors that are null, empty, or hold null or non-finite components, take no part; nor do
    candidates of another length than the query. Repeated candidates are candidates each; repeated queries
    are answered once. Without queries or candidates the result is empty; other columns are ignored.

    The first block of candidates is searched before the others; what it gives as a query's k-th score is
    the floor below which the lists of every other block are read no further.
    """

    def whole(df):
        v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    q, c = stage(whole(queries).dropDuplicates(["id", "v"]), "queries"), stage(whole(candidates), "candidates")
    nq, nc = max(1, -(-q.count() // QUERIES)), max(1, -(-c.count() // CANDIDATES))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda a, n: F.explode(F.sequence(F.lit(a), F.lit(n - 1)))
    q = q.select("id", "v", F.size("v").alias("width"), deal(nq).alias("qb"))
    c = c.select("id", "v", F.size("v").alias("width"), deal(nc).alias("cb"))

    def search(table):
        import numpy as np
        import pyarrow as pa

        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = np.asarray(table.column("id").to_numpy())
        width = table.column("width")[0].as_py()
        values = np.asarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), "int64").reshape(-1, width)
        # Doubles hold these integers and their sums exactly below 2**53.
        top = float(np.abs(values[asks]).max(initial=0)) * float(np.abs(values[~asks]).max(initial=0)) * width
        if top < 2.0**53:
            values = values.astype("float64")
        lists = SortedLists(ids[~asks], values[~asks])
        floor = table.column("floor").to_pylist()
        out = []
        if len(lists.ids):
            for i in np.flatnonzero(asks):
                at, scores = lists.top(values[i], ids[i], k, floor[i])
                out.append((np.full(len(at), ids[i]), lists.ids[at], scores.astype("int64")))
        cols = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, "int64") for j in range(3)]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "id", "score"])

    def searched(asked, offered):
        rows = asked.withColumn("asks", F.lit(True)).unionByName(offered.withColumns({"floor": F.lit(None).cast("long"), "asks": F.lit(False)}))
        return rows.groupBy("width", "qb", "cb").applyInArrow(search, "query_id long, id long, score long")

    first = q.withColumns({"cb": F.lit(0), "floor": F.lit(None).cast("long")})
    found = stage(searched(first, c.where("cb = 0").withColumn("qb", every(0, nq))), "found")
    if nc > 1:
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
        rest = q.join(kth, "id", "left").withColumn("cb", every(1, nc))
        found = found.union(searched(rest, c.where("cb > 0").withColumn("qb", every(0, nq))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
