"""Names, events and dates out of free text, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import bound, first_rule

#: Entities that names may hold.
ENTITIES = {"&amp;": "&", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " "}
#: Phase by words.
PHASE_WORDS = (("Playoffs", r"playoff|final|knockout|bracket"), ("Play-in", r"play.?in"), ("Swiss", r"swiss"))
SPLIT_WORDS = r"\b(winter|spring|summer|fall|autumn|split [1-3])\b"


#: White space that cleaning folds: more than one, or other than a space.
UNFOLDED = ("  ", "\t", "\n", "\x0b", "\f", "\r")


def clean_name(name: Column) -> Column:
    """Entities decoded and white space folded; blank becomes null."""
    for entity, text in ENTITIES.items():
        name = F.replace(name, F.lit(entity), F.lit(text))
    uneven = lambda n: reduce(or_, [F.contains(n, F.lit(space)) for space in UNFOLDED])
    folded = bound(name, lambda n: F.trim(F.when(uneven(n), F.regexp_replace(n, r"\s+", " ")).otherwise(n)))
    return bound(folded, lambda n: F.when(n != "", n))


def name_key(name: Column) -> Column:
    """What two spellings of one name share: lower-case letters and digits."""
    return F.regexp_replace(F.lower(clean_name(name)), r"[^\p{L}\p{N}]", "")


def acronym(name: Column) -> Column:
    """First letters of the words, upper case; of a single word its first three letters."""
    words = F.filter(F.split(clean_name(name), " "), lambda w: w != "")
    many = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.size(words) > 1, many).otherwise(F.upper(F.substring(words[0], 1, 3)))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def event_phase(event: Column) -> Column:
    return first_rule(F.lower(F.coalesce(event, F.lit(""))), PHASE_WORDS, "Regular season")


def split_label(event: Column) -> Column:
    found = F.regexp_extract(F.lower(event), SPLIT_WORDS, 1)
    return F.when(found != "", found)


def patch_bucket(patch: Column) -> Column:
    """``major.minor`` of a patch; other texts are null."""
    found = F.regexp_extract(F.trim(patch), r"^(\d+\.\d+)", 1)
    return F.when(found != "", found)


def game_seconds(length: Column) -> Column:
    """Seconds from ``m:ss`` or a plain number; other texts are null."""
    part = lambda n, i: F.try_element_at(F.split(n, ":"), F.lit(i)).try_cast("long")
    clock = lambda n: F.when(n.rlike(r"^\d+:[0-5]\d$"), part(n, 1) * 60 + part(n, 2)).otherwise(F.round(number_or_null(n)).cast("long"))
    return bound(F.trim(length), clock)


#: What every text of a number holds. Texts without it are not cast: a failed cast builds an exception, which costs many casts.
NUMERIC = r"[0-9]|(?i:nan|inf)"


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number_or_null(text), F.lit(0.0))


def number_or_null(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def idle_days(last: Column, now: Column) -> Column:
    return F.greatest(F.datediff(now, last), F.lit(0))


def day_of(text: Column) -> Column:
    """The date of a text with or without a time: ISO, or day and month after a slash; others are null."""
    clean = F.trim(text)
    iso = F.try_to_date(F.substring(clean, 1, 10), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(clean, "M/d/yyyy"))


def scope_key(*parts: Column) -> Column:
    """Parts of a scope as one text: url-encoded, joined by two underscores; null parts are ``All``."""
    return F.concat_ws("__", *[F.replace(F.url_encode(F.coalesce(p.cast("string"), F.lit("All"))), F.lit("_"), F.lit("%5F")) for p in parts])


def scope_parts(key: Column) -> Column:
    """The parts that a scope's text was made of."""
    return F.transform(F.split(key, "__"), lambda p: F.url_decode(p))


def sorted_roles(players: Column, order: list[str]) -> Column:
    """An array of structs with ``role``, in the order of ``order``; the first of a role stays, and unknown roles come last."""
    place = lambda p: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in order]), p.role), F.lit(0)), F.lit(len(order) + 1))
    numbered = F.transform(players, lambda p, i: F.struct(place(p).alias("place"), i.alias("i"), p.alias("p")))
    ordered = F.array_sort(numbered)
    first = F.filter(ordered, lambda x, i: (i == 0) | (x.p.role != F.get(ordered, i - 1).p.role))
    return F.transform(first, lambda x: x.p)
