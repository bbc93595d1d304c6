"""Lists, maps and null rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of the predicates that were asked for; true without any."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def one_or_many(column: Column, wanted) -> Column:
    """Equality with a value, or membership in a list."""
    return column.isin(list(wanted)) if isinstance(wanted, (list, tuple, set, frozenset)) else column == wanted


def labels(*rules: tuple[Column, str]) -> Column:
    """Labels of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def first_label(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """Label of the first rule that holds."""
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return out if default is None else out.otherwise(default)


def filled(value: Column, fallback: Column) -> Column:
    """``value`` unless it is null or zero."""
    return F.coalesce(F.nullif(value, F.lit(0)), fallback)


def list_of(text: Column, kind: str = "array<string>") -> Column:
    """A JSON list; null where it can't be read."""
    return F.from_json(text, kind)


def list_size(items: Column) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0))


def holds_all(items: Column, *wanted: str) -> Column:
    return F.coalesce(all_of([F.array_contains(items, w) for w in wanted]), F.lit(False))


def year_of(d: Column, year: int) -> Column:
    """Whether a day is in a year, as a range that files can be pruned by."""
    return (d >= F.lit(f"{year}-01-01").cast("date")) & (d < F.lit(f"{year + 1}-01-01").cast("date"))
