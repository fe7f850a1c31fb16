"""Line deduplication over many documents: two Bloom filters find lines that may repeat, and only those are shuffled.

Every task hashes its lines; hashes go to segments of the hash space, where a once-seen filter tells which
ones come again and a twice-seen filter keeps those. Lines that the twice-seen filter holds are grouped by
their whole key, which confirms the repeats exactly and chooses the document that keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import mix, slices, stage, text_bytes, unstage, unused, with_arrow

#: Hashes of one segment as expected; bits of a filter for each of its hashes, at least; bits that a hash sets.
SEGMENT, BITS, PROBES = 1 << 20, 16, 4
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 20
#: Most bytes of the twice-seen filter, and of confirmed lines, that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a confirmed line in a broadcast: hash, digest, keeper.
EACH = 56


def line_keys(text: bytes, least: int) -> list[bytes]:
    """The key of every line, None where it has fewer than ``least`` code points."""
    return [k if len(k) >= least and (k.isascii() or len(k) >= 4 * least or len(k.decode()) >= least) else None for k in map(bytes.strip, text.lower().split(b"\n"))]


def digests(keys):
    """64-bit hashes of keys."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), "uint64")


def _probes(hashes, size):
    """Places of a hash's bits in a filter of ``size`` bits, a power of two; a filter folded in half keeps them modulo its size."""
    import numpy as np

    step = mix(hashes) | np.uint64(1)
    for k in range(PROBES):
        yield (hashes + np.uint64(k) * step) & (size - np.uint64(1))


class Bloom:
    """One filter of a power of two of bits, a byte each while it is filled."""

    def __init__(self, keys: int):
        import numpy as np

        self.size = np.uint64(1 << max(6, (BITS * keys - 1).bit_length()))
        self.bits = np.zeros(int(self.size), bool)

    def add(self, hashes) -> None:
        for at in _probes(hashes, self.size):
            self.bits[at] = True

    def has(self, hashes):
        import numpy as np

        out = np.ones(len(hashes), bool)
        for at in _probes(hashes, self.size):
            out &= self.bits[at]
        return out

    def packed(self) -> bytes:
        import numpy as np

        return np.packbits(self.bits, bitorder="little").tobytes()


class Segments:
    """The twice-seen filters of all segments, side by side."""

    def __init__(self, shift: int, found: list[tuple[int, bytes]]):
        import numpy as np

        self.shift = shift
        self.start = np.zeros(1 << shift, "int64")
        self.size = np.full(1 << shift, 64, "uint64")
        at, held = 8, [bytes(8)]  # segments without a filter share eight bytes of zeros
        for segment, bits in found:
            self.start[segment], self.size[segment] = at, 8 * len(bits)
            held.append(bits)
            at += len(bits)
        self.bits = np.frombuffer(b"".join(held), "uint8")

    def has(self, hashes):
        import numpy as np

        segment = segment_of(hashes, self.shift)
        start, out = self.start[segment], np.ones(len(hashes), bool)
        for at in _probes(hashes, self.size[segment]):
            out &= (self.bits[start + (at >> np.uint64(3)).astype("int64")] >> (at & np.uint64(7)).astype("uint8") & 1).astype(bool)
        return out


def segment_of(hashes, shift: int):
    import numpy as np

    return (hashes >> np.uint64(64 - shift)).astype("int64") if shift else np.zeros(len(hashes), "int64")


def _survey(df: DataFrame, least: int) -> DataFrame:
    """(once, twice, n): hashes of lines in parts of tasks, by whether a part holds them in one document or in more, sorted."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(held):
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([values[counts == 1].tobytes()], pa.binary()), pa.array([values[counts > 1].tobytes()], pa.binary()), pa.array([len(values)])], names=["once", "twice", "n"])

        held, n = [], 0
        for batch in slices(batches):
            for text in text_bytes(batch, "text"):
                held.append(digests({k for k in line_keys(text, least) if k is not None}))
                n += len(held[-1])
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return df.mapInArrow(run, "once binary, twice binary, n long")


def twice_seen(df: DataFrame, least: int, broadcast_bytes: int = BROADCAST_BYTES) -> Segments:
    """The twice-seen filter of the lines of ``df`` (column text), of ``broadcast_bytes`` at most as a whole (or 8 bytes a segment).

    A filter that would be larger is folded in halves: more lines are then suspected and confirmed, none is missed.
    """
    hashes = stage(_survey(df, least), "line_hashes")
    total = hashes.agg(F.sum("n")).first()[0] or 0
    shift = max(0, (-(-total // SEGMENT) - 1).bit_length())

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        edges = (np.arange(1, 1 << shift, dtype="uint64") << np.uint64(64 - shift)) if shift else np.zeros(0, "uint64")
        for batch in batches:
            for once, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = np.frombuffer(once, "uint64"), np.frombuffer(twice, "uint64")
                x, y = (np.concatenate([[0], np.searchsorted(v, edges), [len(v)]]) for v in (a, b))
                own = np.flatnonzero((np.diff(x) + np.diff(y)) > 0)
                for part in np.array_split(own, -(-len(own) // 4096)) if len(own) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([a[x[i] : x[i + 1]].tobytes() for i in part], pa.binary()), pa.array([b[y[i] : y[i + 1]].tobytes() for i in part], pa.binary())], names=["segment", "once", "twice"])

    def build(table):
        import numpy as np
        import pyarrow as pa

        once, twice = (np.frombuffer(b"".join(table.column(c).to_pylist()), "uint64") for c in ("once", "twice"))
        first, again = Bloom(len(once) + len(twice)), []
        for group, more in ((once, False), (twice, True)):
            for start in range(0, len(group), 1 << 16):
                values, counts = np.unique(group[start : start + (1 << 16)], return_counts=True)
                again.append(values if more else values[first.has(values) | (counts > 1)])
                first.add(values)
        again = np.unique(np.concatenate(again))
        second = Bloom(len(again))
        second.add(again)
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([second.packed()] if len(again) else [b""], pa.binary())})

    filters = hashes.mapInArrow(cut, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(build, "segment long, bits binary").where(F.length("bits") > 0)
    filters = stage(filters, "line_filters")
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    halves = max(0, (-(-size // max(1, broadcast_bytes)) - 1).bit_length())

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for bits in batch.column(1).to_pylist():
                held = np.frombuffer(bits, "uint8")
                for _ in range(halves):
                    if len(held) > 8:
                        held = held[: len(held) // 2] | held[len(held) // 2 :]
                out.append(held.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["segment", "bits"])

    found = [(r.segment, bytes(r.bits)) for r in filters.mapInArrow(fold, "segment long, bits binary").collect()]
    unstage(hashes, filters)
    return Segments(shift, found)


def _suspects(df: DataFrame, shared, least: int) -> DataFrame:
    """(id, hash, key) of every line key that the twice-seen filter holds, once a row of ``df`` (columns id, text)."""
    schema = StructType([df.schema["id"], *StructType.fromDDL("hash long, key binary")])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            keys, rows = [], []
            for i, text in enumerate(text_bytes(batch, "text")):
                own = {k for k in line_keys(text, least) if k is not None}
                keys += own
                rows += [i] * len(own)
            hashes = digests(keys)
            own = np.flatnonzero(shared.value.has(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")).take(pa.array(np.array(rows, "int64")[own])), pa.array(hashes[own].view("int64")), pa.array([keys[j] for j in own], pa.binary())], names=["id", "hash", "key"])

    return df.mapInArrow(run, schema)


class Repeats:
    """Confirmed lines by hash: their digests, and the id that keeps each."""

    def __init__(self, hashes, digests_, keepers):
        import numpy as np

        order = np.argsort(hashes, kind="stable")
        self.hashes, self.digests, self.keepers = hashes[order], [digests_[i] for i in order], keepers.take(order)

    def lost(self, hashes, keys, ids):
        """Whether each line goes: its key is confirmed and another id keeps it."""
        import hashlib

        import numpy as np

        out = np.zeros(len(hashes), bool)
        if not len(self.hashes):
            return out
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, len(self.hashes) - 1)
        for i in np.flatnonzero(self.hashes[near] == hashes):
            digest = hashlib.sha256(keys[i]).digest()
            for j in range(at[i], len(self.hashes)):
                if self.hashes[j] != hashes[i]:
                    break
                if self.digests[j] == digest:
                    out[i] = self.keepers[j].as_py() != ids[i]
                    break
        return out


def drop_repeated_lines(df: DataFrame, documents: int = 5, least: int = 40, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    r"""``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is split at \n. A line's key is the line without white space ``[\x20\x09-\x0D]`` at both ends,
    A-Z lower-cased. Keys of at least ``least`` code points that at least ``documents`` rows hold lose all
    their lines but those in rows with the greatest id that holds them; the rest is joined by \n.

    Null and empty texts are one empty line. A line that occurs twice in a row counts it once. Repeated rows
    count each, and rows of the keeping id keep their lines, all of them. A null id is less than any other; where
    only null ids hold a key, those rows keep it. Every row stays; an empty table gives an empty one; columns of
    ``df`` named as new ones are replaced. Texts of any length are whole.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    filters = twice_seen(rows.select("text"), least, broadcast_bytes)
    shared = df.sparkSession.sparkContext.broadcast(filters)
    suspects = _suspects(rows, shared, least)
    counted = suspects.groupBy("hash", "key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= max(2, documents))
    repeats = stage(counted.select("hash", F.unhex(F.sha2("key", 256)).alias("digest"), "keeper"), "repeated_lines")
    n = repeats.count()
    fields = "n_lines long, n_dropped long, kept_text string"

    def drop(texts, ids, lost):
        """Columns of the result; ``lost(hashes, keys, places)`` tells which of the long lines go, with the row of each."""
        import numpy as np
        import pyarrow as pa

        lines = [t.split(b"\n") for t in texts]
        keys, rows, places = [], [], []
        for i, t in enumerate(texts):
            own = line_keys(t, least)
            at = [j for j, k in enumerate(own) if k is not None]
            keys += [own[j] for j in at]
            rows += [i] * len(at)
            places += at
        gone = [set() for _ in texts]
        for k in np.flatnonzero(lost(digests(keys), keys, rows)):
            gone[rows[k]].add(places[k])
        kept = [b"\n".join([x for j, x in enumerate(own) if j not in g] if g else own) for own, g in zip(lines, gone, strict=True)]
        return [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    if n * EACH <= broadcast_bytes:
        import numpy as np
        import pyarrow as pa

        held = repeats.toArrow()
        known = df.sparkSession.sparkContext.broadcast(Repeats(held.column("hash").to_numpy().view("uint64"), held.column("digest").to_pylist(), pa.array(held.column("keeper").combine_chunks()) if n else pa.array([], pa.null())))
        unstage(repeats)

        def make(batch):
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            return drop(text_bytes(batch, text_col), ids, lambda h, keys, at: known.value.lost(h, keys, [ids[i] for i in at]))

        return with_arrow(df, fields, make)

    # Too many to broadcast: each row's lost lines are brought to it by its id.
    lost = suspects.select("id", "hash", F.unhex(F.sha2("key", 256)).alias("digest")).join(repeats, ["hash", "digest"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "digest").distinct()
    known_id, gone = unused(df, "lost_id", "lost_lines")
    by_id = lost.groupBy(F.col("id").alias(known_id)).agg(F.collect_list("digest").alias(gone))

    def make(batch):
        import hashlib

        own = [set(x or ()) for x in batch.column(batch.schema.get_field_index(gone)).to_pylist()]
        return drop(text_bytes(batch, text_col), None, lambda h, keys, at: [bool(own[i]) and hashlib.sha256(k).digest() in own[i] for k, i in zip(keys, at, strict=True)])

    return with_arrow(df.join(by_id, F.col(id_col).eqNullSafe(F.col(known_id)), "left"), fields, make).drop(known_id, gone)
