"""Windows on a key, cut into stretches so that no key, however hot, is one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_on(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on columns of equal names, nulls equal; the columns of ``left``, then the others of ``right``."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    return left.alias("l").join(right.alias("r"), same, "left").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in names])


def carried_last(df: DataFrame, keys: list[str], stretch: str, order: list[str], value: Column, name: str, *, own: bool = True) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the key up to each row, or (``own`` false) before it.

    ``order`` are columns to sort by; ``stretch`` is a column that never falls in that order.  The windows over rows are on key and
    stretch, and only one row per key and stretch, aggregated before it is shuffled, meets in a window on the key.
    """
    line = Window.partitionBy(*keys, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    at = F.when(value.isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, stretch).agg(F.max_by(value, at).alias("_end"))
    past = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, stretch, F.last("_end", ignorenulls=True).over(past).alias("_before"))
    within = df.withColumn(name, F.last(value, ignorenulls=True).over(line))
    return joined_on(within, before, [*keys, stretch]).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def numbered(df: DataFrame, key: str, stretch: Column, order: list[str]) -> DataFrame:
    """Adds ``_n``, the place of each row among those of its key, from 0: counted within stretches, and summed over the ones before."""
    own = df.withColumn("_stretch", stretch)
    counts = own.groupBy(key, "_stretch").agg(F.count("*").alias("_rows"))
    past = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "_stretch", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_first"))
    placed = own.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(*order)) - 1)
    return joined_on(placed, before, [key, "_stretch"]).withColumn("_n", F.col("_first") + F.col("_place")).drop("_stretch", "_place", "_first")


def with_context(placed: DataFrame, most: int, rows: int) -> DataFrame:
    """Rows with ``_n`` in blocks of ``rows`` (``_block``), each with the last ``most`` rows of the block before, which are not ``_own``."""
    block = F.floor(F.col("_n") / rows)
    to = F.when(F.pmod("_n", F.lit(rows)) >= rows - most, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.withColumn("_block", F.explode(to)).withColumn("_own", F.col("_block") == block)
