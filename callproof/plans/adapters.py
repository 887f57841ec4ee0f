"""The given tables in the shape of the data model: calls, lines, changes, nested values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below the session's checkpoint folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def reread(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives of the folder that ``write`` fills; the folder is removed, and the rows stand in the checkpoint folder."""
    path = scratch(spark)
    write(path)
    back = cut(read(path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return back


def micros(df: DataFrame, column: str) -> Column:
    """A time as microseconds since 1970, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as calls: eight sessions of users share an authorization, properties are the arguments."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), (micros(e, "ts") / F.lit(1e6)).alias("t"), F.col("event_type").alias("api"), (F.col("user_id") % 8).cast("string").alias("auth"),
        "user_id", "value", F.col("props").alias("arguments"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The same in SQL.
CALLS = "calls as (select event_id as seq, epoch_us(ts) / 1e6 as t, event_type as api, cast(user_id % 8 as varchar) as auth, user_id, value, props as arguments, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as enter (even) and exit (odd) lines."""
    return calls(spark, sf_dir).select(F.col("seq").alias("pos"), "api", (F.col("seq") % 2 == 0).alias("is_enter"), "t")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as changes of users' rows: a purchase sets a value, an error deletes the row."""
    from pyspark.sql import Window

    own = calls(spark, sf_dir).where(F.col("api").isin("purchase", "error"))
    after = F.when(F.col("api") == "purchase", F.col("value"))
    out = own.select(F.col("user_id").alias("pk"), F.col("seq").alias("pos"), F.floor("t").alias("ts_s"), after.alias("after"), F.when(F.col("api") == "error", "delete").otherwise("update").alias("type"))
    return out.withColumn("before", F.lag("after").over(Window.partitionBy("pk").orderBy("pos")))


CHANGES = CALLS + ", changes as (select user_id as pk, seq as pos, cast(floor(t) as bigint) as ts_s, case when api = 'purchase' then value end as after, case when api = 'error' then 'delete' else 'update' end as type, lag(case when api = 'purchase' then value end) over (partition by user_id order by seq) as before from calls where api in ('purchase', 'error'))"


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` per order: sorted part numbers, structs, maps of part to quantity, an array of arrays."""
    li = table(spark, sf_dir, "lineitem")
    items = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("qty"))))
    out = li.groupBy("l_orderkey").agg(items.alias("items"))
    maps = F.transform("items", lambda x: F.map_from_entries(F.array(F.struct(F.when(x["qty"] > 25, "many").otherwise("few"), x["part"]))))
    lists = F.transform("items", lambda x: F.when(x["qty"] > 45, F.lit(None)).otherwise(F.array(x["part"], x["supp"])))
    return out.select("l_orderkey", "items", F.transform("items", lambda x: x["part"]).alias("parts"), maps.alias("maps"), lists.alias("lists"))


ORDER_LISTS = "items as (select l_orderkey, list({'part': l_partkey, 'supp': l_suppkey, 'qty': cast(l_quantity as bigint)} order by l_partkey, l_suppkey, cast(l_quantity as bigint)) as items from lineitem group by 1)"


def joined_text(c: Column) -> Column:
    """An array as text, nulls shown."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
