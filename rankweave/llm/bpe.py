"""Byte-level BPE over Arrow batches: ids by the ranks of a vocabulary file, offsets, and decoding.

The ranks become a BPE model of the tokenizers library, over the printable characters that stand for the
256 bytes. Texts are cut by the vocabulary's pattern; each piece is looked up or merged by itself, and
pieces met before come from a bounded cache of the task's process.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame

from .common import held, text_bytes, with_arrow

#: Most pieces that a process remembers, and the longest one in bytes; both bound memory and never change ids.
CACHE, LONGEST = 600_000, 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in own else free))
        free += b not in own
    return out


class Codec:
    """Encoding and decoding by a rank file; ``encode`` gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex
        from tokenizers.models import BPE

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.chars = byte_characters()
        name = lambda b: "".join([self.chars[x] for x in b])
        merges = []
        for token in sorted(ranks, key=ranks.get):
            ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(name(a), name(b)) for a, b in sorted(ways, key=lambda w: (ranks[w[0]], ranks[w[1]]))]
        self.model = BPE(vocab={name(b): r for b, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.table = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.table[r] = b
        self.lengths = np.array([len(b) for b in self.table], dtype="int64")
        # Unicode's own white space; the short form takes four control characters more here.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.names = dict(enumerate(self.chars))
        codec, known = self, {}

        class Pieces(dict):
            def __missing__(self, piece):
                mapped = piece.encode().decode("latin-1").translate(codec.names)
                value = np.array([t.id for t in codec.model.tokenize(mapped)], dtype="<u4").tobytes()
                if len(self) < CACHE and len(value) <= 4 * LONGEST:
                    self[piece] = value
                return value

        self.pieces = Pieces(known)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text.decode())))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    return held(Codec, path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, with ``offsets``, the place of each token.

    ``byte_start`` and ``byte_end`` count UTF-8 bytes; ``char_start`` and ``char_end`` count code points and
    cover every character that a token holds a byte of, so tokens that share a character overlap there.
    Null and empty texts have no ids; rows, repeated ones too, stay as they are; an empty table gives an
    empty one; columns of ``df`` with the names of new ones are replaced. Texts of any length are whole.
    """
    places = ("byte_start", "byte_end", "char_start", "char_end") if offsets else ()

    def make(batch):
        import numpy as np
        import pyarrow as pa

        own = codec(path, pattern)
        texts = text_bytes(batch, text_col)
        coded = [own.encode(t) for t in texts]
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype("int32")
        ids = np.frombuffer(b"".join(coded), dtype="<u4")
        columns = [ids.astype("int32")]
        if offsets:
            size = own.lengths[ids]
            base = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], np.diff(ends))
            end = np.cumsum(size)
            start = end - size
            first = (np.frombuffer(b"".join(texts), dtype="uint8") & 0xC0) != 0x80
            char = np.cumsum(first) - 1 if len(first) else np.zeros(0, "int64")
            char_base = char[base] if len(base) else base
            columns += [start - base, end - base, char[start] - char_base, char[end - 1] + 1 - char_base]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype("int32"))) for c in columns]

    fields = ", ".join(f"{n} array<int>" for n in ("ids", *places))
    return with_arrow(df, fields, make)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (the tokens' bytes) and ``decoded_text``.

    A character split over tokens is whole again once their bytes stand together; bytes that form no
    character are U+FFFD in ``decoded_text`` only. Null ids give nulls; an empty array gives empty values;
    ids outside the vocabulary and null ids inside an array add no bytes.
    """

    def make(batch):
        import numpy as np
        import pyarrow as pa

        own = codec(path, pattern)
        out = []
        column = batch.column(batch.schema.get_field_index(ids_col))
        for row in column:
            if not row.is_valid:
                out.append(None)
                continue
            ids = row.values.drop_null().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(own.table)):
                ids = ids[(ids >= 0) & (ids < len(own.table))]
            out.append(own.decode(np.asarray(ids).tolist()))
        return [pa.array(out, pa.binary()), pa.array([None if b is None else b.decode(errors="replace") for b in out], pa.string())]

    return with_arrow(df, "decoded binary, decoded_text string", make)
