"""Periodic runs of words by Kolpakov and Kucherov, and texts without their repetitions.

A suffix automaton gives the LZ factors of a stretch of words; Main's algorithm finds the runs that touch a
factor's border; runs inside a factor are copied from where the factor stood before. Only stretches that
repeated word n-grams cover are factored: no run reaches outside of them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

from pyspark.sql import DataFrame

from .common import mix, text_bytes, with_arrow


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the first occurrence or -1) of the LZ factors of ``w``; occurrences may overlap their factor.

    A state of the automaton holds its first transition in arrays, further ones in a dictionary.
    """
    n = len(w)
    letter, target, link, length, first = (array("i", bytes(8 * n + 4)) for _ in range(5))
    more: dict[int, dict[int, int]] = {}
    letter[0], link[0] = -1, -1
    size, last = 1, 0
    for i, c in enumerate(w):
        here, size = size, size + 1
        length[here], first[here], letter[here] = i + 1, i, -1
        p = last
        while p >= 0:
            if letter[p] == c:
                q = target[p]
                break
            if letter[p] < 0:
                letter[p], target[p] = c, here
            else:
                own = more.get(p)
                if own is None:
                    more[p] = {c: here}
                elif c in own:
                    q = own[c]
                    break
                else:
                    own[c] = here
            p = link[p]
        if p < 0:
            link[here] = 0
        elif length[p] + 1 == length[q]:
            link[here] = q
        else:
            copy, size = size, size + 1
            length[copy], first[copy], link[copy], letter[copy], target[copy] = length[p] + 1, first[q], link[q], letter[q], target[q]
            if q in more:
                more[copy] = dict(more[q])
            link[q] = link[here] = copy
            while p >= 0:
                if letter[p] == c:
                    if target[p] != q:
                        break
                    target[p] = copy
                elif p in more and more[p].get(c) == q:
                    more[p][c] = copy
                else:
                    break
                p = link[p]
        last = here
    out, i = [], 0
    while i < n:
        state, size, before = 0, 0, -1
        while i + size < n:
            c = w[i + size]
            state = target[state] if letter[state] == c else more[state][c]
            if first[state] - size >= i:
                break
            before = first[state] - size
            size += 1
        out.append((i, max(1, size), before))
        i += max(1, size)
    return out


def prefix_matches(s: list[int]) -> list[int]:
    """At each place of ``s``, how many letters there equal its beginning; 0 at place 0."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def runs(w: list[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal runs of ``w`` with length >= max(least, 2 * period), by start, then period; ends are inclusive."""
    n = len(w)
    found: dict[tuple[int, int], int] = {}
    at: dict[int, list[int]] = {}
    starts: list[int] = []

    def add(s: int, e: int, p: int) -> None:
        known = found.get((s, e))
        if known is None:
            if s not in at:
                at[s] = []
                insort(starts, s)
            at[s].append(e)
        if known is None or p < known:
            found[s, e] = p

    previous = 0
    for b, size, before in [*factors(w), (n, 0, -1)]:
        end = b + size
        low = max(0, b - 2 * previous - max(1, size))
        if end - low >= least and b:
            left, right = w[low:b], w[b:end]
            back = prefix_matches([*reversed(left), -1, *reversed(right), *reversed(left)])
            ahead = prefix_matches([*right, -1, *left, *right])
            m = b - low
            candidates = []
            # One period at least lies right of the border ...
            for p in range(1, size + 1):
                x, y = back[m + 1 + size - p], ahead[p] if p < size else 0
                if x + y >= p and x + y + p >= least:
                    candidates.append((b - x, b + p + y - 1, p))
            # ... or left of it.
            for p in range(1, m + 1):
                x, y = back[p] if p < m else 0, ahead[size + 1 + m - p]
                if x + y >= p and x + y + p >= least:
                    candidates.append((b - p - x, b + y - 1, p))
            for s, e, p in candidates:
                # Cut off by what is looked at: found whole at another border.
                if s == low and low and w[s - 1] == w[s - 1 + p] or e == end - 1 and e + 1 < n and w[e + 1] == w[e + 1 - p]:
                    continue
                add(s, e, p)
        if before >= 0:
            k = bisect_right(starts, before)
            while k < len(starts) and starts[k] < before + size - 1:
                s = starts[k]
                for e in at[s]:
                    if e < before + size - 1:
                        add(s + b - before, e + b - before, found[s, e])
                k += 1
        previous = size
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def stretches(codes, ends, gram: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of at least ``least`` words, within texts that end at ``ends``, all of whose words stand in an n-gram that its text holds again."""
    import numpy as np

    n = len(codes) - gram + 1
    if n <= 0:
        return []
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    h = text.astype("uint64")
    with np.errstate(over="ignore"):
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(gram):
            h = (h ^ codes[k : k + n].astype("uint64")) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    h = mix(h)
    whole = text[:n] == text[gram - 1 :]
    ordered = np.sort(h[whole])
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return []
    near = np.minimum(np.searchsorted(again, h), len(again) - 1)
    hit = np.flatnonzero((again[near] == h) & whole)
    step = np.zeros(len(codes) + 1, "int64")
    np.add.at(step, hit, 1)
    np.add.at(step, hit + gram, -1)
    inside = np.cumsum(step[:-1]) > 0
    begins = inside & (np.concatenate([[True], ~inside[:-1]]) | np.concatenate([[True], text[1:] != text[:-1]]))
    stops = inside & (np.concatenate([~inside[1:], [True]]) | np.concatenate([text[1:] != text[:-1], [True]]))
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def word_runs(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    r"""``df`` with ``runs`` (array of start, length, period by start, then period) and ``collapsed``.

    Words are ``[^\x20\x09-\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q, of at
    least max(``least``, 2 q) words, that no neighbour extends. ``collapsed`` are the words, joined by one
    space, without those that a run contains after its first q words. ``rewrite(id, words)`` may change a row's
    words (a list of bytes) first.

    Null and empty texts and those without words have no runs and an empty ``collapsed``. Every row stays,
    repeated ones too, whatever its id; an empty table gives an empty one; columns of ``df`` named runs or
    collapsed are replaced. Texts are read whole; memory grows with the longest one, by about 0.2 KB a word of
    its repeated stretches.
    """
    # A run of length m and period q repeats its first m - q >= least / 2 words.
    gram = max(1, -(-least // 2))

    def make(batch):
        from collections import defaultdict
        from itertools import count

        import numpy as np
        import pyarrow as pa

        texts = text_bytes(batch, text_col)
        words = [t.split() for t in texts]
        if rewrite is not None:
            words = [rewrite(i, x) for i, x in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), words, strict=True)]
        names = defaultdict(count().__next__)
        ends = np.cumsum([len(x) for x in words], dtype="int64")
        codes = np.fromiter((names[x] for own in words for x in own), "int64", int(ends[-1]) if len(ends) else 0)
        found = [[] for _ in words]
        for a, b in stretches(codes, ends, gram, least):
            own = int(np.searchsorted(ends, a, "right"))
            base = a - int(ends[own]) + len(words[own])
            found[own] += [(s + base, e - s + 1, p) for s, e, p in runs(codes[a:b].tolist(), least)]
        collapsed = []
        for own, held in zip(words, found, strict=True):
            if held:
                lost = np.zeros(len(own) + 1, "int64")
                for s, size, p in held:
                    lost[s + p] += 1
                    lost[s + size] -= 1
                own = [x for x, k in zip(own, np.cumsum(lost).tolist(), strict=False) if not k]
            collapsed.append(b" ".join(own))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in held] for held in found], kind), pa.array(collapsed, pa.binary()).cast(pa.string())]

    return with_arrow(df, "runs array<struct<start: long, length: long, period: long>>, collapsed string", make)
