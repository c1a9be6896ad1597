"""Comparisons and arrays as Columns, with the nulls of SQL spelt out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(value: Column, among: Column) -> Column:
    """value = ANY(array): null where the value or the array is null, or where nothing is equal and the array has a null."""
    return F.exists(among, lambda x: x == value)


def distinct_from(a: Column, b: Column) -> Column:
    """a IS DISTINCT FROM b: never null, and two nulls are the same."""
    return ~a.eqNullSafe(b)


def zipped(**arrays: Column) -> Column:
    """Arrays side by side as one array of structs, in order; the shorter ones end in nulls."""
    return F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))


def appended(array: Column, value: Column) -> Column:
    """The array with the value at its end; a null array counts as empty."""
    return F.array_append(F.coalesce(array, F.array().cast("array<string>")), value.cast("string"))
