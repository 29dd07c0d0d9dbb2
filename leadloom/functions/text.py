"""Column helpers with the text semantics of the data: Unicode white space, empty for null, containment of phrases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """'' for null."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def fold(c: Column | str) -> Column:
    return F.lower(strip(c))


def collapse(c: Column | str) -> Column:
    """Stripped, and one space for each run of white space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def some(c: Column | str) -> Column:
    """null for ''."""
    return F.nullif(col(c), F.lit(""))


def phrases_in(c: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur in the text, in their order."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def matches_any(c: Column, patterns: Iterable[str], flags: str = "(?iud)") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def names_matching(c: Column, named: dict[str, tuple[str, ...]]) -> Column:
    """The names one of whose patterns is found in the text, in their order."""
    return F.array_compact(F.array(*(F.when(matches_any(c, ps), F.lit(name)) for name, ps in named.items())))


def label(c: Column, labels: dict[str, str], default: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), default)


def joined(c: Column | str) -> Column:
    """A list in a report: items joined by ' | ', '' for null."""
    return F.coalesce(F.array_join(col(c), " | "), F.lit(""))
