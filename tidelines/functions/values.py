"""Scalar functions on values, ids and intervals.

A history's entry is (value, wc): wc names the kind of a missing-value marker, else it is null. A null value with a null wc is a
real value that equals itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of missing-value markers.
MARKERS = ("R", "C", "D", "CE", "V", "DE")
LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def is_wildcard(wc: Column) -> Column:
    return wc.isNotNull()


def same_raw(v1: Column, w1: Column, v2: Column, w2: Column) -> Column:
    """Equality of raw entries: markers equal those of their own kind only."""
    return w1.eqNullSafe(w2) & v1.eqNullSafe(v2)


def compatible(v1: Column, w1: Column, v2: Column, w2: Column) -> Column:
    """Equal, or at least one side unknown."""
    return w1.isNotNull() | w2.isNotNull() | v1.eqNullSafe(v2)


def contained(v1: Column, w1: Column, v2: Column, w2: Column) -> Column:
    """Compatible, or one value's set of words contains the other's; a null value is the word null."""
    words = lambda v: F.array_distinct(F.split(F.coalesce(v, F.lit("null")), r"\s"))
    a, b = words(v1), words(v2)
    return compatible(v1, w1, v2, w2) | (F.size(F.array_union(a, b)) == F.greatest(F.size(a), F.size(b)))


def merged_value(v1: Column, w1: Column, v2: Column) -> Column:
    """The known one of two compatible values."""
    return F.when(w1.isNotNull(), v2).otherwise(v1)


def informative(v: Column, w: Column) -> Column:
    return w.isNull() & v.isNotNull() & (v != "")


def shown(v: Column, w: Column) -> Column:
    """An entry as text."""
    return F.when(w.isNotNull(), F.concat(F.lit("⊥"), w)).otherwise(F.coalesce(v, F.lit("null")))


def csv_safe(v: Column) -> Column:
    return F.translate(F.coalesce(v, F.lit("null")), "\r\n,", "   ")


def ml_safe(v: Column) -> Column:
    return F.translate(F.coalesce(v, F.lit("null")), "\r\n,\t ", "_____")


def id_part(role_id: Column, name: str) -> Column:
    """template, page, key or property of an id of the form template||page||key||property; a leading || means no template."""
    place = {"template": 1, "page": 2, "key": 3, "property": -1}[name]
    return F.try_element_at(F.split(role_id, r"\|\|"), F.lit(place))


def links(v: Column, most: int = 10) -> Column:
    """The first link targets inside a value."""
    return F.slice(F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(LINK), F.lit(1)), 1, most)


def overlap(f1: Column, t1: Column, f2: Column, t2: Column) -> tuple[Column, Column, Column]:
    """Common part [from, to) of two half-open intervals, and whether there is one."""
    a, b = F.greatest(f1, f2), F.least(t1, t2)
    return a, b, a < b


def within(f1: Column, t1: Column, f2: Column, t2: Column) -> Column:
    """True if the first interval lies in the second."""
    return (f1 >= f2) & (t1 <= t2)


def normalised_confidence(match: Column, confidence: Column) -> Column:
    """The chance of a match, whatever the predicted class."""
    return F.when(match == 1, confidence).otherwise(1 - confidence)
