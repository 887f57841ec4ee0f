"""Derived columns of nested values.  A null input gives null; names are added to the parent's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_idx(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def array_len(c: Column) -> Column:
    return F.array_size(c)


def array_flatten(c: Column) -> Column:
    """Inner arrays joined; a null inner array gives one null element."""
    return F.flatten(F.transform(c, lambda x: F.coalesce(x, F.array(F.get(x, F.lit(0))))))


def array_field(c: Column, field: str) -> Column:
    return F.transform(c, lambda x: x[field])


def array_exists(c: Column, key: str) -> Column:
    """Per map element, whether it has the key; null for a null element."""
    return F.transform(c, lambda x: F.map_contains_key(x, key))


def field(c: Column, name: str) -> Column:
    return c[name]


def map_field(c: Column, key: str) -> Column:
    """A key's value in a map, null if absent."""
    return F.element_at(c, F.lit(key))


def exists(c: Column, key: str) -> Column:
    return F.map_contains_key(c, key)


def dict_key(c: Column) -> Column:
    return F.map_keys(c)


def dict_value(c: Column) -> Column:
    return F.map_values(c)


def array_dict_key(c: Column) -> Column:
    return F.transform(c, lambda x: F.map_keys(x))


def array_dict_value(c: Column) -> Column:
    return F.transform(c, lambda x: F.map_values(x))
