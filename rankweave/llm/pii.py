"""Personal data by regular expressions, checksums and context words, with DataFrame operations only.

A kind's expression proposes spans; a validator (octets of an address, Luhn, mod-97, digit counts)
confirms them; words near a span raise its score. Positions come from two built-ins: the matches of an
expression and the gaps that splitting by the same expression leaves; their lengths add up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Elements that running values are made of at once; code points of a block that parts of a text are cut from.
CHUNK, BLOCK = 256, 512
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"
#: Code points before and after a span that are searched for its context words.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """A kind of span: where texts may hold one (``hint``), its expression, its validator, its score without context words, and those words.

    Spans of ``base`` kinds are reported once valid; others need ``THRESHOLD``, and may not overlap a span of
    the kind ``unless``.
    """

    name: str
    hint: str
    pattern: str
    valid: object
    score: float
    words: str
    base: bool = True
    unless: str = ""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(m))
    n = F.length(d)

    def step(acc, i):
        v = F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def mod97(m: Column) -> Column:
    """15 to 34 letters and digits that are 1 modulo 97 once the first four stand last and letters are 10 to 35."""
    c = F.replace(m, F.lit(" "), F.lit(""))
    n = F.length(c)
    moved = F.concat(F.substring(c, F.lit(5), n), F.substring(c, 1, 4))

    def step(acc, i):
        a = F.ascii(F.substring(moved, i, F.lit(1)))
        v = F.when(a >= 65, a - 55).otherwise(a - 48)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.when(n.between(15, 34), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == 1).otherwise(False)


#: Every expression starts at the first character of a run or where the last match ended, and holds on to what it
#: took, which finds the same matches as the plain form but reads a long run once only.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "mail|contact|contacto|kontakt|write to"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_octets, 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", luhn, 0.7, "card|visa|mastercard|karte|carte|tarjeta|credit"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|tel|call|fax|mobile|llame|anruf"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", mod97, 0.8, "iban|account|konto|compte|cuenta", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social security", base=False),
    # A number that the wide forms above join with what follows it, so that they fail, is found alone.
    Kind("card_alone", r"[0-9]{4}[\x20-]?[0-9]{4}", r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])", luhn, 0.7, "card|visa|mastercard|karte|carte|tarjeta|credit", base=False, unless="card"),
    Kind("phone_alone", r"\+[0-9]", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|tel|call|fax|mobile|llame|anruf", base=False, unless="phone"),
)
BASE = tuple(k.name for k in KINDS if k.base)
CONTEXT_BONUS, THRESHOLD = 0.25, 0.5


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a one-element array makes it a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, zero: Column, add) -> Column:
    """For each element, what ``add`` makes of ``zero`` and all elements before it: first over chunks of CHUNK, then within them, so that many elements cost no square."""
    empty = F.array(zero)

    def scan(items, first, step):
        start = F.struct(first.alias("at"), F.slice(empty, 1, 0).alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(step(a.at, x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out"))).out

    def by_chunk(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda c: F.slice(s, c * CHUNK + 1, F.lit(CHUNK)))
        return _once(chunks, lambda cs: F.flatten(F.zip_with(cs, scan(cs, zero, lambda at, c: F.aggregate(c, at, add)), lambda c, b: scan(c, b, add))))

    return F.when(F.size(values) > 0, _once(values, by_chunk)).otherwise(F.slice(empty, 1, 0))


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts, from 0: lengths of the gaps and matches before it, and of its own gap."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m")))
    return F.zip_with(_before(steps, F.lit(0).cast("long"), lambda at, x: at + x.g + x.m), steps, lambda at, x: at + x.g)


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, from which parts are cut without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    whole = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(whole, (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _confirmed(spans: Column, k: Kind, text: Column) -> Column:
    """The spans (v, a) that the kind's validator confirms, with scores."""

    def scored(blocks: Column):
        def score(x: Column) -> Column:
            end = x.a + F.length(x.v)
            before = _cut(blocks, F.greatest(x.a - CONTEXT, F.lit(0)), x.a)
            near = F.concat(before, F.lit("\n"), _cut(blocks, end, end + CONTEXT))
            value = F.lit(k.score) + F.when(near.rlike(f"(?i){k.words}"), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), x.a.alias("start"), end.alias("end"), x.v.alias("value"), F.least(value, F.lit(1.0)).alias("score"))

        return score

    found = F.filter(spans, lambda x: k.valid(x.v))
    none = F.array().cast(SPANS)
    return F.when(F.size(spans) > 0, _once(found, lambda own: F.when(F.size(own) > 0, _once(_blocks(text), lambda b: F.transform(own, scored(b)))).otherwise(none))).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; both ascend and are free of overlaps among themselves.

    Both are put in one order; from the left, others that started earlier must have ended, and from the
    right, the next other must start later.
    """

    def by_order(both: Column) -> Column:
        ends = _before(both, F.lit(-1).cast("long"), lambda at, x: F.when(x.other, F.greatest(at, x.end)).otherwise(at))
        last = F.lit(2**62).cast("long")
        starts = F.reverse(_before(F.reverse(both), last, lambda at, x: F.when(x.other, x.start).otherwise(at)))
        kept = F.zip_with(both, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, o: F.struct(x.alias("x"), ((o.e <= x.start) & (o.s >= x.end) & ~x.other).alias("ok")))
        return F.transform(F.filter(kept, lambda k: k.ok), lambda k: k.x.span)

    mark = lambda s, other: F.transform(s, lambda x: F.struct(x.start.alias("start"), F.lit(other).alias("other"), x.end.alias("end"), x.alias("span")))
    both = F.array_sort(F.concat(mark(spans, False), mark(others, True)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _once(both, by_order)).otherwise(spans)


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "spans", kinds=KINDS) -> DataFrame:
    """``df`` with ``spans_col``: an array of (kind, start, end, value, score), by kind as listed, then by start.

    Positions are code points of the whole text, ends exclusive; matches of a kind never overlap, those
    of different kinds may. Null and empty texts have no spans. Every row stays, once; repeated rows get
    equal spans; a column of ``df`` named ``spans_col`` is replaced; an empty table gives an empty one.
    """
    doc, *names = unused(df, "doc_text", *(f"{p}_{k.name}" for k in kinds for p in ("m", "g", "s")))
    out = df.withColumn(doc, F.coalesce(F.col(text_col), F.lit("")))
    found = []
    for i, k in enumerate(kinds):
        m, g, s = names[3 * i : 3 * i + 3]
        text = F.col(doc)
        none = F.array().cast("array<string>")
        hint = F.contains(text, F.lit("@")) if k.hint == "@" else text.rlike(k.hint)
        out = out.withColumn(m, F.when(hint, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none))
        out = out.withColumn(g, F.when(F.size(m) > 0, F.split(text, k.pattern, -1)).otherwise(none))
        at = F.when(F.size(m) > 0, _starts(F.col(g), F.col(m))).otherwise(F.array().cast("array<bigint>"))
        span = F.zip_with(F.col(m), at, lambda v, a: F.struct(v.alias("v"), a.alias("a")))
        spans = _confirmed(span, k, text)
        if not k.base:
            spans = F.filter(spans, lambda x: x.score >= THRESHOLD)
        if k.unless:
            spans = _apart(spans, F.col(names[3 * [o.name for o in kinds].index(k.unless) + 2]))
        out = out.withColumn(s, spans)
        found.append(s)
    return out.withColumn(spans_col, F.concat(*found)).drop(doc, *names)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``df`` with every span in the text replaced by ``<KIND>``; of overlapping spans, the union is replaced under the first's kind.

    Null texts stay null; texts without spans stay as they are. The work grows with the text and its spans,
    not with their product.
    """
    by_start = F.array_sort(F.transform(spans_col, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.upper(s.kind).alias("kind"))))
    text = F.col(text_col)

    def cut(spans: Column, blocks: Column) -> Column:
        # What is kept lies between the furthest end so far and the next start.
        ends = _before(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s.end))
        pieces = F.zip_with(spans, ends, lambda s, at: F.when(s.start >= at, F.concat(_cut(blocks, at, s.start), F.lit("<"), s.kind, F.lit(">"))).otherwise(""))
        furthest = F.array_max(F.transform(spans, lambda s: s.end))
        return F.concat(F.array_join(pieces, ""), _cut(blocks, furthest, F.greatest(furthest, F.length(text).cast("long"))))

    whole = _once(by_start, lambda spans: _once(_blocks(text), lambda blocks: cut(spans, blocks)))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, whole).otherwise(text))
