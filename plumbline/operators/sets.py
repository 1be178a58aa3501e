
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalars import ColumnLike, col


def _clean(c: ColumnLike) -> Column:
    return F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


# U01, U02
def ordered_distinct(c: ColumnLike, limit: int | None = None) -> Column:
    """Elements without blanks, each once, in the order of their first occurrence; null reads as empty."""
    out = F.coalesce(F.array_distinct(_clean(c)), F.array().cast("array<string>"))
    return F.slice(out, 1, limit) if limit else out


# U03
def append_unique(c: ColumnLike, added: ColumnLike, limit: int | None = None) -> Column:
    out = F.array_union(ordered_distinct(c), ordered_distinct(added))
    return F.slice(out, 1, limit) if limit else out


# U04
def must_have_missing(required: ColumnLike, found: ColumnLike) -> Column:
    return F.array_except(ordered_distinct(required), ordered_distinct(found))


def must_not_have_found(forbidden: ColumnLike, found: ColumnLike) -> Column:
    return F.array_intersect(ordered_distinct(forbidden), ordered_distinct(found))


# U05
def first_wins(*maps: ColumnLike) -> Column:
    """The union of maps; of a key in several the value of the first that has it."""
    out = F.coalesce(col(maps[0]), F.create_map().cast("map<string,double>"))
    for m in maps[1:]:
        out = _added(out, F.coalesce(col(m), F.create_map().cast("map<string,double>")))
    return out


def _added(have: Column, more: Column) -> Column:
    return F.map_concat(have, F.map_filter(more, lambda k, _: ~F.map_contains_key(have, k)))
