"""Best-fit packing of tokenized documents into sequences of a fixed size.

Documents become token pieces in one pass over the texts. The pieces' lengths alone are then dealt out and
packed online: a fixed number of open bins, kept in a bitset by their free space, takes each piece into the
fullest bin that still holds it; if all bins are open, the fullest closes first.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, stage, text_bytes, unused, with_arrow

#: Most words that a process remembers, and the longest one in bytes; both bound memory and never change ids.
CACHE, LONGEST = 600_000, 48
#: Open bins of a packer, and pieces that one packer takes on average.
OPEN_BINS, PACK_ROWS = 4096, 50_000


#: Texts that a vocabulary must encode as the words one by one give them.
PROBES = ("Ab cD  the\tTHE\n", "don't stop, (now)! x.y a-b 12,5 $3", "É é ß İ ΟΔΟΣ 東京 😀 naïve", "word \u00a0 next\x1cx")


class WordCodec:
    """Ids by a word-level BPE file whose normalizer lower-cases and whose pre-tokenizer drops white space, so words are encoded one by one; other files are refused."""

    def __init__(self, path: str):
        import re

        import numpy as np
        from tokenizers import Tokenizer

        from .bpe import byte_characters

        tokenizer = Tokenizer.from_file(path)
        names = dict(enumerate(byte_characters()))
        # Lower-case Latin words are one piece each and normal already: the model alone does them.
        plain = re.compile("[a-zß-öø-ÿ]+").fullmatch

        class Words(dict):
            def __missing__(self, word):
                text = word.decode()
                if len(word) > 1 and word[-1] in b",.!?" and 97 <= word[-2] <= 122:
                    value = self[word[:-1]] + self[word[-1:]]
                elif plain(text):
                    value = np.array([t.id for t in tokenizer.model.tokenize(word.decode("latin-1").translate(names))], dtype="<u4").tobytes()
                else:
                    value = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                if len(self) < CACHE and len(word) <= LONGEST:
                    self[word] = value
                return value

        self.words = Words()
        for text in PROBES:
            if np.frombuffer(self.encode(text.encode()), "<u4").tolist() != tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path}: its normalizer or pre-tokenizer is of another kind; words of {text!r} cannot be encoded one by one")

    def encode(self, text: bytes) -> bytes:
        # Special tokens are matched before lower-casing, so texts that may hold one keep their case.
        return b"".join(map(self.words.__getitem__, (text if b"<|" in text else text.lower()).split()))


def word_codec(path: str) -> WordCodec:
    return held(WordCodec, path)


def tokenize_pieces(df: DataFrame, path: str, size: int = 4096, end_id: int = 1, text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: ``df``'s columns with piece, start, length and tokens (binary, little-endian unsigned 32-bit ids)."""

    def make(batch):
        import numpy as np
        import pyarrow as pa

        own, end = word_codec(path), np.array([end_id], dtype="<u4").tobytes()
        coded = [own.encode(t) + end for t in text_bytes(batch, text_col)]
        cut = [[c[i : i + 4 * size] for i in range(0, len(c), 4 * size)] for c in coded]
        return [pa.array(cut, pa.list_(pa.binary()))]

    cuts, at, piece = unused(df, "cuts", "at", "piece_tokens")
    taken = [c for c in df.columns if c.lower() not in ("piece", "start", "length", "tokens")]
    rows = with_arrow(df, f"`{cuts}` array<binary>", make).select(*taken, F.posexplode(cuts).alias(at, piece))
    return rows.select(*taken, F.col(at).alias("piece"), (F.col(at).cast("long") * size).alias("start"), (F.length(piece) / 4).cast("long").alias("length"), F.col(piece).alias("tokens"))


class Packer:
    """Online best fit with a fixed number of open bins."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit, self.mask, self.open, self.made = size, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free space

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        if not own:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of a piece."""
        fits = self.mask >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        return number, self.size - free


def pack(pieces: DataFrame, size: int = 4096, open_bins: int = OPEN_BINS, pack_rows: int = PACK_ROWS, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, the place in the sequence, gapless from 0.

    Pieces are dealt at random over as many packers as their count asks for and come to each longest
    first; no sequence holds more than ``size``. Lengths must be 1 to ``size``; a null or other length
    gets a null sequence and offset. Repeated rows are pieces of their own; an empty table gives an empty
    one; columns of ``pieces`` named sequence_id or offset are replaced.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    count = pieces.count()
    packers = max(1, -(-count // pack_rows))
    keep = [f for f in pieces.schema if f.name.lower() not in ("sequence_id", "offset")]
    schema = StructType([*keep, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        first = TaskContext.get().partitionId() << 40
        out, packer = to_arrow_schema(schema), Packer(size, open_bins)
        for batch in batches:
            placed = [packer.put(n) if n is not None and 0 < n <= size else None for n in batch.column(length_at).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array([None if p is None else first + p[0] for p in placed], pa.int64()), pa.array([None if p is None else p[1] for p in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, out, strict=True)], names=out.names)

    length_at = names.index(length_col)
    dealt = pieces.select(*names).repartition(packers).sortWithinPartitions(F.col(length_col).desc(), *([F.col(n) for n in ("doc_id", "piece") if n in names]))
    return dealt.mapInArrow(run, schema)


def pack_documents(df: DataFrame, path: str, size: int = 4096, end_id: int = 1, text_col: str = "text", tokens: bool = False, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents as pieces with their places: ``columns``, piece, start, length, ids_crc32, sequence_id and offset (with ``tokens``, the ids too).

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Only documents longer
    than ``size`` are cut. Nulls in ``columns`` stay; repeated documents are packed each; an empty table
    gives an empty one; of ``columns``, those with the names of new ones are replaced.
    """
    made = ("piece", "start", "length", "tokens", "ids_crc32", "sequence_id", "offset")
    chosen = [c for c in columns if c != text_col and c.lower() not in made]
    pieces = tokenize_pieces(df.select(*chosen, text_col), path, size, end_id, text_col).withColumn("ids_crc32", F.crc32("tokens"))
    kept = ["tokens"] if tokens else []
    narrow = stage(pieces.select(*chosen, "piece", "start", "length", "ids_crc32", *kept), "pieces")
    return pack(narrow, size)
