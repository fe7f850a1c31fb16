"""Ordered rules over texts, as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_CASE = "(?i)"


def needed(pattern: str) -> list[str]:
    """For each alternative of a pattern the longest text that is in all that it finds, in lower case where case does not count; an empty one where none is seen.

    Groups, classes, escapes, and characters that may be missing or repeated count as unknown.
    """
    any_case = pattern.startswith(ANY_CASE)
    plain = re.sub(r"\\.", "\0", pattern.removeprefix(ANY_CASE))
    plain = re.sub(r"\[[^\]]*\]", "\0", plain)
    while (flat := re.sub(r"\([^()]*\)", "\0", plain)) != plain:
        plain = flat
    plain = re.sub(r".(?:[?*]|\{[^}]*\})", "\0", plain)
    found = [max(re.split(r"[\0.+^$]", part), key=len) for part in plain.split("|")]
    return [text.lower() for text in found] if any_case else found


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` reads it.

    It also keeps its select out of the one generated method of a stage, which is not compiled beyond 8000 bytes: rules and
    names are more.
    """
    return F.transform(F.array(value), use)[0]


def first_rule(text: Column, rules, default, folded: Column | None = None) -> Column:
    """The value of the first (value, pattern) whose pattern is found in ``text``; values and ``default`` may be columns.

    A pattern is tried only on texts that hold what it cannot do without. ``folded`` is the text in lower case, where it is made
    already. A third item of a rule is a condition that it has besides.
    """
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F
    for value, pattern, *also in rules:
        own = text if not pattern.startswith(ANY_CASE) else F.lower(text) if folded is None else folded
        holds = [F.contains(own, F.lit(t)) for t in needed(pattern)]
        out = out.when(reduce(and_, [reduce(or_, holds), text.rlike(pattern), *also]), column(value))
    return column(default) if out is F else out.otherwise(column(default))
