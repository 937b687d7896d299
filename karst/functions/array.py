"""Arrays. Indexes count from 0; order is kept unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, val


def add(xs, item) -> Column:
    """Appends item unless it is present."""
    return F.when(F.array_contains(col(xs), val(item)), col(xs)).otherwise(F.array_append(col(xs), val(item)))


def append(xs, item) -> Column:
    return F.array_append(col(xs), val(item))


push = append


def concat(*xs) -> Column:
    """Joins arrays, duplicates included."""
    return F.concat(*[col(x) for x in xs])


def contains(xs, item) -> Column:
    return F.array_contains(col(xs), val(item))


def difference(xs, ys) -> Column:
    """Items in exactly one of both."""
    a, b = col(xs), col(ys)
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def distinct(xs) -> Column:
    return F.array_distinct(col(xs))


unique = distinct


def filter(xs, test) -> Column:
    """Items for which test(item) holds, or those equal to a value."""
    return F.filter(col(xs), test if callable(test) else lambda e: e == val(test))


def find(xs, test) -> Column:
    """The first item that ``filter`` keeps, or NULL."""
    return F.get(filter(xs, test), F.lit(0))


def first(xs) -> Column:
    return F.get(col(xs), F.lit(0))


def last(xs) -> Column:
    return F.try_element_at(col(xs), F.lit(-1))


#: The last item; columns are not changed in place.
pop = last


def flatten(xss) -> Column:
    return F.flatten(col(xss))


def group(xss) -> Column:
    """One array of the distinct items of an array of arrays."""
    return F.array_distinct(F.flatten(col(xss)))


def group_agg(xs) -> Column:
    """Aggregate: the distinct items of all arrays of a group, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(col(xs)))))


def intersect(xs, ys) -> Column:
    return F.array_intersect(col(xs), col(ys))


def is_empty(xs) -> Column:
    return F.size(col(xs)) == 0


def join(xs, separator: str = "") -> Column:
    return F.array_join(F.transform(col(xs), lambda e: e.cast("string")), separator)


string_join = join


def length(xs) -> Column:
    return F.size(col(xs))


def map(xs, f: Callable[[Column], Column]) -> Column:
    return F.transform(col(xs), f)


def max(xs) -> Column:
    return F.array_max(col(xs))


def min(xs) -> Column:
    return F.array_min(col(xs))


def prepend(xs, item) -> Column:
    return F.array_prepend(col(xs), val(item))


def remove(xs, index: int) -> Column:
    """Without the item at an index; a negative one counts from the end."""
    at = val(index)
    at = F.when(at < 0, at + F.size(col(xs))).otherwise(at)
    return F.filter(col(xs), lambda e, i: i != at)


def reverse(xs) -> Column:
    return F.reverse(col(xs))


def shuffle(xs) -> Column:
    return F.shuffle(col(xs))


def slice(xs, start: int, count: int | None = None) -> Column:
    """count items from start, or all that follow; a negative start counts from the end."""
    a = col(xs)
    n = F.size(a)
    s = val(start)
    s = F.when(s < 0, F.greatest(s + n, F.lit(0))).otherwise(s)
    return F.slice(a, s + 1, n if count is None else val(count))


def sort(xs, order: str | bool = True) -> Column:
    """Ascending, or descending for "desc" or False."""
    return F.sort_array(col(xs), order not in ("desc", "DESC", False))


def sum(xs) -> Column:
    """0 for an empty array; NULL items count as nothing."""
    return F.aggregate(F.filter(col(xs), lambda e: e.isNotNull()), F.lit(0.0), lambda a, e: a + e.cast("double"))


def union(xs, ys) -> Column:
    return F.array_union(col(xs), col(ys))
