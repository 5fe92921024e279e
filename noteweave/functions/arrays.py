"""Arrays inside a row: runs, first of a key, sweeps (by sorting), and lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions.text import let, scan


def null_of(value: Column) -> Column:
    """A null of the value's type; the value is never worked out."""
    return F.when(F.lit(False), value)


def none_of(items: Column) -> Column:
    """An empty array of the same type."""
    return F.filter(items, lambda x: F.lit(False))


def runs(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """The array cut where the key changes: an array of arrays."""
    def cut(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~key(F.get(s, i)).eqNullSafe(key(F.get(s, i - 1))))
        return let(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s))), lambda x, y: F.slice(s, x + 1, y - x)))

    return let(ordered, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(none_of(F.array(s))))


def firsts(items: Column, key: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order. ``order`` differs for any two items of a key."""
    keyed = F.sort_array(F.transform(items, lambda x: F.struct(key(x).alias("k"), order(x).alias("o"), x.alias("x"))))
    one = let(keyed, lambda s: F.filter(s, lambda x, i: ~x["k"].eqNullSafe(F.get(s, i - 1)["k"]) | (i == 0)))
    return F.transform(F.sort_array(F.transform(one, lambda x: F.struct(x["o"].alias("o"), x["x"].alias("x")))), lambda y: y["x"])


def lookup(keys: Column, known: Column, values: Column) -> Column:
    """For each key the value at the first place of ``known`` that equals it; null without one, and for a null key. A native
    scan for each key: for the graph of a chunk or section, not for large tables."""
    return let(F.struct(known.alias("k"), values.alias("v")), lambda t: F.transform(keys, lambda k: F.get(t["v"], (F.array_position(t["k"], k) - 1).cast("int"))))


def within(values: Column, key: Column) -> Column:
    """Whether the key is among the values; false for null."""
    return F.coalesce(F.array_contains(values, key), F.lit(False))


def outlasting(ordered: Column, end: Callable[[Column], Column]) -> Column:
    """Of items in order those whose end lies behind all earlier ones' ends."""
    def grown(a: Column) -> Column:
        none = null_of(end(F.get(a, F.lit(0))))
        return scan(a, none, lambda s, x: F.greatest(s, end(x)), lambda s, x: F.when(s.isNull() | (end(x) > s), x))[1]

    return let(ordered, lambda a: F.when(F.size(a) > 0, F.array_compact(grown(a))).otherwise(none_of(a)))
