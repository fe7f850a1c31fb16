"""Jaccard self-join of documents on word n-grams: rare-first prefixes, then length, positional and suffix filters.

1. Each text becomes its set of 64-bit shingle hashes; documents with one set are one class.
2. Shingles are counted over all classes: tasks send them, packed in binary rows, to buckets by hash; a
   bucket sends back those that two or more classes hold, with their counts. Others cannot be shared. Of a
   shingle that many classes of one task hold, its bucket gets one mark, and the classes need no answer.
3. A class orders its shingles from rare to frequent. Two sets that are similar enough share a shingle of
   their prefixes. Classes whose prefixes hold unshared shingles alone are done.
4. Prefix shingles are joined in passes, so that groups of copies cost their size and not its square: first
   each list's classes with a few pivots of the list; then, while lists that the links found so far leave in
   several components hold many pairs, the classes outside a list's main component with a few of its
   classes; at last those with all classes of other components. No pair that could link is left out.
5. The length and positional filters go into the joins; in the last one so does a suffix filter, the bits
   in which two sets' parities by hash differ. Pairs that pass are verified once, on whole sets.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_BASE, held, mix, parts, slices, stage, text_bytes, unstage, unused, with_arrow
from .components import components

#: Words that are shingled at once; shingles that a task packs before it sends; shingles of a bucket on average and least buckets; parts in which a bucket is counted.
CHUNK_WORDS, FLUSH, BUCKET, BUCKETS, PARTS = 1 << 16, 500_000, 2_000_000, 64, 4
#: Most words that a process remembers, and the longest one in bytes; both bound memory and never change hashes.
CACHE, LONGEST = 150_000, 48


class Shingler:
    """Sets of shingle hashes of many texts at once: words by BLAKE2b, runs of words mixed in numpy."""

    def __init__(self, words: int, seed: int = 0):
        from hashlib import blake2b

        self.words = words
        salt = seed.to_bytes(8, "little")

        class Hashes(dict):
            def __missing__(self, word):
                value = int.from_bytes(blake2b(word, digest_size=8, salt=salt).digest(), "little")
                if len(self) < CACHE and len(word) <= LONGEST:
                    self[word] = value
                return value

        self.hashes = Hashes()

    def sets(self, texts: list[bytes]):
        """(sorted distinct hashes of all texts, how many each text has)."""
        import numpy as np

        hashes, sizes, held, total = [], [], [], 0
        for i, text in enumerate(texts):
            # Exactly 0x20 and 0x09-0x0D part words, and exactly A-Z are lower-cased, in bytes.
            held.append(text.lower().split())
            total += len(held[-1])
            if total > CHUNK_WORDS or i + 1 == len(texts):
                h, n = self._chunk(held)
                hashes.append(h)
                sizes.append(n)
                held, total = [], 0
        if not hashes:
            return np.zeros(0, "uint64"), np.zeros(0, "int64")
        return np.concatenate(hashes), np.concatenate(sizes)

    def _chunk(self, texts: list[list[bytes]]):
        import numpy as np

        count, k = np.array([len(t) for t in texts], "int64"), self.words
        total = int(count.sum())
        word = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(texts)), "uint64", total)
        text = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        # Where a shingle begins, and how many words it has: all of them in a shorter text.
        length = np.where(np.arange(total) + k <= (first + count)[text], k, 0)
        length[first[(count > 0) & (count < k)]] = count[(count > 0) & (count < k)]
        at = np.flatnonzero(length)
        length, value = length[at], mix(length[at].astype("uint64"))
        for j in range(min(k, int(length.max(initial=0)))):
            if (length > j).all():
                value = mix(value * np.uint64(HASH_BASE) ^ word[at + j])
            else:
                own = length > j
                value[own] = mix(value[own] * np.uint64(HASH_BASE) ^ word[at[own] + j])
        h, text = value, text[at]
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a > 1:
                h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        return h[new], np.bincount(text[new], minlength=len(texts))


def shingler(words: int, seed: int = 0) -> Shingler:
    return held(Shingler, words, seed)


def class_keys(hashes, sizes, salt: int = HASH_BASE):
    """A 64-bit digest of each set, which must not be empty."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    return mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts) + sizes.astype("uint64")) if len(sizes) else np.zeros(0, "uint64")


def with_classes(df: DataFrame, text_col: str = "text", words: int = 5, size_col: str = "n_shingles", key_col: str = "class_key", check_col: str = "class_check", seed: int = 0) -> DataFrame:
    """``df`` with the size of each text's shingle set and two independent digests of the set (null for an empty set)."""

    def make(batch):
        import numpy as np
        import pyarrow as pa

        hashes, sizes = shingler(words, seed).sets(text_bytes(batch, text_col))
        out = [pa.array(sizes, pa.int64())]
        for salt in (HASH_BASE, CHECK_SALT):
            keys = np.zeros(len(sizes), "int64")
            keys[sizes > 0] = class_keys(hashes, sizes[sizes > 0], salt).view("int64")
            out.append(pa.array(keys, pa.int64(), mask=sizes == 0))
        return out

    return with_arrow(df, f"`{size_col}` long, `{key_col}` long, `{check_col}` long", make)


CHECK_SALT = 0xD6E8FEB86659FD93


def _shares(values, by, n_parts: int):
    """Order by part and, for each part that has rows, (part, first, end) in that order."""
    import numpy as np

    order = np.argsort(by, kind="stable")
    edges = np.searchsorted(by[order], np.arange(n_parts + 1))
    return order, [(p, int(edges[p]), int(edges[p + 1])) for p in np.unique(by).tolist()]


def _runs(data, kinds):
    """Arrays of the dtypes ``kinds``, concatenated over packed payloads; each payload is its arrays' lengths, then the arrays."""
    import numpy as np

    parts = [[] for _ in kinds]
    for p in data:
        lengths = np.frombuffer(p, "<u4", len(kinds))
        at = 4 * len(kinds)
        for i, (kind, n) in enumerate(zip(kinds, lengths.tolist(), strict=True)):
            parts[i].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(parts, kinds, strict=True)]


def _payload(*arrays) -> bytes:
    import numpy as np

    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


#: Arrays of a bucket's payload: classes' keys, their set sizes and shingles here; the shingles' low words and next bits; and the marks of hot shingles likewise.
TO_BUCKET = ("<u8", "<u4", "<u4", "<u4", "<u2", "<u4", "<u2")
#: Arrays of an answer: classes' keys, set sizes, shared shingles and buckets; the shingles' low words and next bits, and their counts.
TO_CLASS = ("<u8", "<u4", "<u4", "<u4", "<u4", "<u2", "u1")
#: Bits of a shingle's identity besides its bucket.
TOKEN_BITS = 48
#: Classes of one task that make a shingle hot. Counts are told apart below MOST, which hot shingles have; equal counts are ordered by hash.
HOT, MOST = 64, 255
#: Longs of the suffix filter's parities.
MARKS = 8
#: Pairs that a task verifies on average.
PAIRS = 3000
#: Pivots of a list in a pass; most passes with pivots; pairs to compare, for each prefix row, that pivots are no longer needed for; and the share of the last pass's pairs above which they no longer help.
PIVOTS, PASSES, FEW, SLOW = 4, 6, 4, 0.7


def _split(tokens):
    """Low words and next 16 bits of shingles."""
    import numpy as np

    return tokens.astype("<u4"), (tokens >> np.uint64(32)).astype("<u2")


def _join(low, high):
    import numpy as np

    return high.astype("uint64") << np.uint64(32) | low


def _owners(owner, keys, sizes, place=None):
    """Keys and set sizes of the runs of one owner (and place) in ``owner``, and how long the runs are."""
    import numpy as np

    new = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    if place is not None:
        new |= np.r_[True, place[1:] != place[:-1]][: len(owner)]
    first = np.flatnonzero(new)
    at = owner[first]
    return keys[at], sizes[at].astype("<u4"), np.diff(np.r_[first, len(owner)]).astype("<u4")


def shared_sets(df: DataFrame, text_col: str, words: int, percent: int, buckets: int, seed: int = 0) -> DataFrame:
    """(class_key, n, own, rare, tokens, marks) of every class whose prefix holds a shared shingle.

    ``own`` is the number of shingles that no other class has; ``rare`` holds the rest of the prefix
    (unsigned 64-bit, rare first), ``tokens`` all shared shingles, and ``marks`` the parities of their
    number by hash, 64 * MARKS bits.
    """
    shift = 64 - TOKEN_BITS - (buckets.bit_length() - 1)

    def send(batches):
        import numpy as np
        import pyarrow as pa

        own_hashes = shingler(words, seed)
        held: list[tuple] = []

        def flush():
            hashes, sizes = np.concatenate([h for h, _ in held]), np.concatenate([s for _, s in held])
            held.clear()
            sizes = sizes[sizes > 0]
            keys = class_keys(hashes, sizes)
            _, firsts = np.unique(keys, return_index=True)
            keep = np.zeros(len(keys), bool)
            keep[firsts] = True  # copies in one task go once
            hashes = hashes[np.repeat(keep, sizes)] >> np.uint64(shift)
            keys, sizes = keys[keep], sizes[keep]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            names, count = np.unique(hashes, return_counts=True)
            marks = names[count >= HOT]
            hot = np.zeros(len(hashes), bool)
            if len(marks):
                at = np.searchsorted(marks, hashes)
                at[at == len(marks)] = 0
                hot = marks[at] == hashes
            deal = lambda h: (h % np.uint64(buckets)).astype("int64")
            order, shares = _shares(hashes[~hot], deal(hashes[~hot]), buckets)
            rest, owned = (hashes[~hot] // np.uint64(buckets))[order], owner[~hot][order]
            mark_order, mark_shares = _shares(marks, deal(marks), buckets)
            mark_rest = (marks // np.uint64(buckets))[mark_order]
            mark_shares = {p: (a, b) for p, a, b in mark_shares}
            shares = {p: (a, b) for p, a, b in shares}
            for p in sorted({*shares, *mark_shares}):
                a, b = shares.get(p, (0, 0))
                x, y = mark_shares.get(p, (0, 0))
                yield p, _payload(*_owners(owned[a:b], keys, sizes), *_split(rest[a:b]), *_split(mark_rest[x:y]))
            # Hot shingles' classes need no answer: it goes past the buckets to the part that gathers the class.
            at = np.flatnonzero(hot)
            order, shares = _shares(at, (keys[owner[at]] % np.uint64(buckets)).astype("int64"), buckets)
            at = at[order]
            for p, a, b in shares:
                own = at[a:b]
                own = own[np.lexsort((deal(hashes[own]), owner[own]))]
                place = deal(hashes[own])
                group, n, counts = _owners(owner[own], keys, sizes, place)
                here = place[np.cumsum(counts) - counts].astype("<u4")
                yield buckets + p, _payload(group, n, counts, here, *_split(hashes[own] // np.uint64(buckets)), np.full(b - a, MOST, "u1"))

        def rows(made):
            made = list(made)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["bucket", "payload"])

        size = 0
        for batch in slices(batches):
            held.append(own_hashes.sets(text_bytes(batch, text_col)))
            size += len(held[-1][0])
            if size > FLUSH:
                yield rows(flush())
                size = 0
        if size:
            yield rows(flush())

    def answer(key, table):
        import numpy as np
        import pyarrow as pa

        bucket = key[0].as_py()
        if bucket >= buckets:  # answers that tasks have given themselves
            payload = table.column("payload").combine_chunks()
            return pa.table([pa.array(np.full(len(payload), bucket - buckets, "int32")), payload], names=["part", "payload"])
        keys, n, counts, low, high, mark_low, mark_high = _runs([x.as_buffer() for x in table.column("payload")], TO_BUCKET)
        marks = np.unique(_join(mark_low, mark_high))
        _, firsts = np.unique(keys, return_index=True)
        keep = np.zeros(len(keys), bool)
        keep[firsts] = True  # copies of other tasks; what was hot in a copy's task has gone past here
        each = np.repeat(keep, counts)
        tokens = _join(low[each], high[each])
        keys, n, counts = keys[keep], n[keep], counts[keep]
        owner = np.repeat(np.arange(len(keys), dtype="int32"), counts)
        del low, high, each
        found = []
        for part in range(PARTS):
            own = np.flatnonzero(tokens % np.uint64(PARTS) == part)
            own = own[np.argsort(tokens[own], kind="stable")]
            t = tokens[own]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, "int64")
            size = np.diff(np.r_[first, len(t)])
            size = np.minimum(np.repeat(size, size), MOST - 1)
            if len(marks) and len(t):
                at = np.searchsorted(marks, t)
                at[at == len(marks)] = 0
                size[marks[at] == t] = MOST
            shared = size > 1
            found.append((own[shared], size[shared].astype("u1")))
        at, much = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(at)
        tokens, owner, much = tokens[at[order]], owner[at[order]], much[order]
        order, shares = _shares(tokens, (keys[owner] % np.uint64(buckets)).astype("int64"), buckets)
        tokens, owner, much = tokens[order], owner[order], much[order]
        out = []
        for p, a, b in shares:
            group, size, counts = _owners(owner[a:b], keys, n)
            out.append((p, _payload(group, size, counts, np.full(len(group), bucket, "<u4"), *_split(tokens[a:b]), much[a:b])))
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "payload"])

    def gather(table):
        import numpy as np
        import pyarrow as pa

        keys, n, counts, bucket, low, high, much = _runs([x.as_buffer() for x in table.column("payload")], TO_CLASS)
        tokens = _join(low, high) * np.uint64(buckets) + np.repeat(bucket, counts)
        owner = np.repeat(keys, counts)
        order = np.lexsort((tokens, much, owner))
        tokens, owner = tokens[order], owner[order]
        if len(tokens):  # copies of several tasks may bring a hot shingle twice
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[new], owner[new]
        names, at = np.unique(keys, return_index=True)
        n = n[at].astype("int64")
        starts = np.searchsorted(owner, names)
        ends = np.searchsorted(owner, names, "right")
        own = n - (ends - starts)
        reach = prefix(n, percent) - own
        rows = np.flatnonzero(reach > 0)
        place = (mix(tokens) & np.uint64(64 * MARKS - 1)).astype("int64")
        parity = lambda i: np.packbits(np.bincount(place[starts[i] : ends[i]], minlength=64 * MARKS).astype("u1") & 1).view("<i8")
        return pa.table(
            [
                pa.array(names[rows].view("int64")),
                pa.array(n[rows].astype("int32")),
                pa.array(own[rows].astype("int32")),
                pa.array([tokens[starts[i] : min(ends[i], starts[i] + reach[i])].astype("<u8").tobytes() for i in rows], pa.binary()),
                pa.array([tokens[starts[i] : ends[i]].view("int64") for i in rows], pa.list_(pa.int64())),
                pa.array([parity(i) for i in rows], pa.list_(pa.int64())),
            ],
            names=["class_key", "n", "own", "rare", "tokens", "marks"],
        )

    sent = df.select(text_col).mapInArrow(send, "bucket int, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "part int, payload binary")
    return answers.groupBy("part").applyInArrow(gather, "class_key long, n int, own int, rare binary, tokens array<long>, marks array<long>")


def prefix(n, percent: int):
    """Length of the prefixes that two sets must share a shingle of, for sets of ``n``."""
    return n - (percent * n + 99) // 100 + 1


def _overlap(n1, n2, percent: int):
    """Least intersection of linked sets: ceil(percent * (n1 + n2) / (100 + percent))."""
    return F.ceil((n1 + n2) * percent / (100.0 + percent) - 1e-9)


#: Columns of the suffix filter.
MARK_NAMES = [f"m{i}" for i in range(MARKS)]


def _possible(a: str, b: str, percent: int, suffix: bool):
    """Length and positional filters, and with ``suffix`` the suffix filter, for prefix rows a and b that hold one shingle.

    The suffix filter: shingles that only one of the sets has are at least its own ones and as many shared
    ones as parities differ, and the least intersection bounds them from above.
    """
    n1, n2, p1, p2 = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    least = _overlap(n1, n2, percent)
    fits = length & (F.least(n1 - p1, n2 - p2) >= least)
    if not suffix:
        return fits
    apart = F.col(f"{a}.own") + F.col(f"{b}.own")
    for m in MARK_NAMES:
        apart = apart + F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}")))
    return fits & (apart <= n1 + n2 - 2 * least)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys, with set sizes n1 and n2, whose whole sets are similar enough."""
    tokens = sets.select("class_key", "tokens")
    pairs = pairs.join(tokens.withColumnsRenamed({"class_key": "a", "tokens": "t1"}), "a").join(tokens.withColumnsRenamed({"class_key": "b", "tokens": "t2"}), "b")

    # Row by row in the JVM: whole sets of very long texts are never gathered in a batch.
    both = F.size(F.array_intersect("t1", "t2"))
    return pairs.where(both * 100 >= (F.col("n1") + F.col("n2") - both) * percent).select("a", "b")


#: Columns of a prefix row besides its shingle.
ROW = ["key", "n", "at"]


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect each component of the similarity graph."""

    def prefixes(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = np.array(batch.column("own").to_pylist(), "int64")
            tokens = [np.frombuffer(t.as_buffer(), "<i8") for t in batch.column("rare")]
            size = np.array([len(t) for t in tokens], "int64")
            rows = np.repeat(np.arange(len(own)), size)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + own[rows]
            each = pa.array(rows)
            columns = [pa.array(np.concatenate(tokens)) if tokens else pa.array([], pa.int64()), *(batch.column(c).take(each) for c in ("class_key", "n")), pa.array(at.astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", *ROW])

    postings = stage(sets.select("class_key", "n", "own", "rare").mapInArrow(prefixes, "token long, key long, n int, at int"), "prefixes")
    # A row for each class, where prefix rows are many: the last pass alone needs these.
    marks = sets.select(F.col("class_key").alias("key"), "own", *[F.get("marks", i).alias(m) for i, m in enumerate(MARK_NAMES)])
    total = postings.count()
    near = lambda x, y, suffix=False: (F.col(f"{x}.key") != F.col(f"{y}.key")) & _possible(x, y, percent, suffix)
    swap = F.col("x.key") > F.col("y.key")
    ends = [F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(n) for c, n in (("key", "a"), ("n", "n1"))]
    ends += [F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(n) for c, n in (("key", "b"), ("n", "n2"))]

    def pivots(rows, turn: int):
        """PIVOTS rows of each list at most; lists of one group of copies mostly name the same ones."""
        mixed = F.xxhash64("key", F.lit(turn))
        return rows.groupBy("token", F.pmod(mixed, F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct(mixed.alias("h"), *ROW)).alias("p")).select("token", *(f"p.{c}" for c in ROW))

    # The first pass: every row with its list's pivots.
    tried = postings.alias("x").join(pivots(postings, 0).alias("y"), "token").where(near("x", "y"))
    files = parts(total)
    tried = stage(tried.select(*ends).distinct(), "pairs", files)
    links = stage(verified(tried, sets, percent), "verified", parts(tried.count(), PAIRS))
    held = [postings, tried]
    before = float("inf")
    for turn in range(1, PASSES + 1):
        roots = components(links)
        placed = postings.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        tally = placed.groupBy("token", "root").agg(F.count("*").alias("m"))
        mixed = tally.groupBy("token").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("main.root").alias("main"), "m", (F.col("m") - F.col("main.m")).alias("others"))
        mixed = stage(mixed, "lists", files)
        rest = rest_of_lists = stage(placed.join(mixed, "token").select(*placed.columns, "main"), "mixed", files)
        left = mixed.agg(F.sum(F.col("m") * F.col("others")).alias("n")).first()["n"] or 0
        outside = rest.where("root <> main")
        last = left <= FEW * total or turn == PASSES or left > SLOW * before
        before = left
        if last:  # every row outside its list's main component with all of other components
            rest = rest.join(marks, "key")
            meet = rest.where("root <> main").alias("x").join(rest.alias("y"), "token").where((F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))) & near("x", "y", suffix=True))
        else:  # with pivots of the main component
            meet = outside.alias("x").join(pivots(rest.where("root = main"), turn).alias("y"), "token").where(near("x", "y"))
        fresh = stage(meet.select(*ends).distinct().join(tried, ["a", "b"], "left_anti"), "pairs", files)
        links = links.union(stage(verified(fresh, sets, percent), "verified", parts(fresh.count(), PAIRS)))
        unstage(roots, mixed, rest_of_lists)
        held.append(fresh)
        tried = tried.union(fresh)
        if last:
            break
    unstage(*held)
    return links


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, n_shingles, class_key) of every row; (class_key, component_id, winner): the least id of the class's component and the class that has it; and the seed of the keys."""
    for seed in range(SEEDS):
        info = stage(with_classes(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", words, seed=seed).select("id", "n_shingles", "class_key", "class_check"), "classes")
        # Two sets with one key have two checks; then other hashes are taken.
        keys = info.where("class_key is not null").groupBy("class_key").agg(F.min("id").alias("id"), F.min("class_check").alias("x"), F.max("class_check").alias("y"))
        keys = stage(keys, "keys")
        if keys.where("x <> y").isEmpty():
            break
    else:
        raise RuntimeError(f"sets with equal 64-bit keys under {SEEDS} seeds")
    total = info.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    buckets = max(BUCKETS, -(-total // BUCKET))
    sets = stage(shared_sets(df, text_col, words, percent, buckets, seed), "sets")
    roots = components(class_links(sets, percent))
    unstage(sets)
    classes = keys.select("class_key", "id").join(roots.withColumnRenamed("node", "class_key"), "class_key", "left")
    classes = stage(classes.withColumn("root", F.coalesce("root", "class_key")), "classes")
    unstage(keys, roots)
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "class_key")).alias("w"))
    return info, classes.join(least, "root").select("class_key", F.col("w.id").alias("component_id"), F.col("w.class_key").alias("winner")), seed


#: Seeds of the word hashes that are tried until no two sets have one key.
SEEDS = 4


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, n_shingles, class_key, component_id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a set holds the distinct
    shingles of ``words`` words, or the whole sequence of a shorter text. Documents link where
    ``100 * intersection >= percent * union``; ``component_id`` is the least id reachable by links.
    Null and empty texts and those without words have the size 0, a null class and their own id. Rows with
    a null id take part and never give the id, so it is null where no document of the component has one.
    Repeated rows are linked; an empty table gives an empty one; other columns of ``df`` are ignored.
    Sets are told apart by 128 bits of hashes, shingles in a pair of sets by at least 54 bits.
    """
    info, named, _ = _classes(df, id_col, text_col, words, percent)
    out = info.join(named, "class_key", "left").withColumn("component_id", F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "class_key", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``df`` with one document of each group of similar ones, that of the least id.

    Rows without words are in no group and stay. Of repeated rows with the least id one stays; in a group
    without ids, any one. All columns stay as they are.
    """
    size, key, check, own_id, own_key = unused(df, "set_size", "set_key", "set_check", "least_id", "winner_key")
    _, named, seed = _classes(df, id_col, text_col, words, percent)
    # Rows meet the winners on id and class at once, so that a text with many copies is no hot key.
    winners = named.where("class_key = winner").select(F.col("component_id").alias(own_id), F.col("winner").alias(own_key))
    rows = with_classes(df, text_col, words, size, key, check, seed).drop(size, check)
    kept = rows.where(F.col(key).isNotNull()).join(winners, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left_semi")
    kept = kept.dropDuplicates([id_col, key])
    return kept.select(df.columns).union(rows.where(F.col(key).isNull()).select(df.columns))
