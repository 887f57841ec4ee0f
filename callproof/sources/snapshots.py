"""Snapshots of database tables and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, StructType, TimestampNTZType, TimestampType


def typed(df: DataFrame) -> DataFrame:
    """A table in the types of the data model: times as text, decimals as doubles."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def snapshot_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables that have a row, typed; emptiness is told from one row, not a count."""
    return {name: typed(df) for name, df in tables.items() if not df.limit(1).isEmpty()}


def read_jdbc_tables(spark: SparkSession, url: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """The tables of a database over JDBC."""
    return {n: spark.read.format("jdbc").option("url", url).option("dbtable", n).options(**options).load() for n in names}


def align_to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` by name: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def table_keys(columns: DataFrame) -> DataFrame:
    """``columns(table, column, position, key_position)`` -> primary key and all columns of each table.

    A table without a key has null ``primary_keys``.
    """
    every = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda s: s["column"])
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column")))), lambda s: s["column"])
    out = columns.groupBy("table").agg(keys.alias("primary_keys"), every.alias("all_columns"))
    return out.withColumn("primary_keys", F.when(F.size("primary_keys") > 0, F.col("primary_keys")))


def column_catalogue(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """The ``columns`` input of ``table_keys`` for DataFrames: key columns must be columns."""
    rows = []
    for name, df in tables.items():
        own = keys.get(name, [])
        if missing := set(own) - set(df.columns):
            raise ValueError(f"{name} has no column {sorted(missing)}")
        rows += [(name, c, k, own.index(c) if c in own else None) for k, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "`table` string, `column` string, position int, key_position int")
