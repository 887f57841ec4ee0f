"""Queries on nested values."""

from pyspark.sql import functions as F

from ..functions import nested
from ..operators import expansion
from .adapters import ORDER_LISTS, joined_text, order_lists
from .registry import query

WITH = f"with {ORDER_LISTS} "
TEXT = "array_to_string(list_transform({}, lambda x: coalesce(cast(x as varchar), '-')), ',')"


@query(WITH + "select l_orderkey, items[2].part as part from items")
def x_array_idx(spark, d):
    return order_lists(spark, d).select("l_orderkey", nested.array_idx(F.col("parts"), 1).alias("part"))


@query(WITH + "select l_orderkey, cast(len(items) as bigint) as n from items")
def x_array_len(spark, d):
    return order_lists(spark, d).select("l_orderkey", nested.array_len(F.col("items")).cast("long").alias("n"))


@query(WITH + "select l_orderkey, " + TEXT.format("flatten(list_transform(items, lambda x: case when x.qty > 45 then [null] else [x.part, x.supp] end))") + " as flat from items")
def x_array_flatten(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(nested.array_flatten(F.col("lists"))).alias("flat"))


@query(WITH + "select l_orderkey, " + TEXT.format("list_transform(items, lambda x: x.supp)") + " as supps from items")
def x_array_field(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(nested.array_field(F.col("items"), "supp")).alias("supps"))


@query(WITH + "select l_orderkey, " + TEXT.format("list_transform(items, lambda x: x.qty > 25)") + " as has_many from items")
def x_array_exists(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(nested.array_exists(F.col("maps"), "many")).alias("has_many"))


@query(WITH + "select l_orderkey, items[1].qty as qty from items")
def x_field(spark, d):
    return order_lists(spark, d).select("l_orderkey", nested.field(F.col("items")[0], "qty").alias("qty"))


@query(WITH + "select l_orderkey, items[1].qty > 25 as has_many, case when items[1].qty > 25 then items[1].part end as many from items")
def x_exists(spark, d):
    first = F.col("maps")[0]
    return order_lists(spark, d).select("l_orderkey", nested.exists(first, "many").alias("has_many"), nested.map_field(first, "many").alias("many"))


@query(WITH + "select l_orderkey, case when items[1].qty > 25 then 'many' else 'few' end as keys from items")
def x_dict_key(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(nested.dict_key(F.col("maps")[0])).alias("keys"))


@query(WITH + "select l_orderkey, cast(items[1].part as varchar) as vals from items")
def x_dict_value(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(nested.dict_value(F.col("maps")[0])).alias("vals"))


@query(WITH + "select l_orderkey, " + TEXT.format("list_transform(items, lambda x: case when x.qty > 25 then 'many' else 'few' end)") + " as keys from items")
def x_array_dict_key(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(F.flatten(nested.array_dict_key(F.col("maps")))).alias("keys"))


@query(WITH + "select l_orderkey, " + TEXT.format("list_transform(items, lambda x: x.part)") + " as vals from items")
def x_array_dict_value(spark, d):
    return order_lists(spark, d).select("l_orderkey", joined_text(F.flatten(nested.array_dict_value(F.col("maps")))).alias("vals"))


@query(WITH + "select l_orderkey, cast(len(items) as bigint) as n, items[1].part as part0, items[1].qty as qty0, " + TEXT.format("list_transform(items, lambda x: x.part)") + " as parts from items")
def expand_table(spark, d):
    out, _ = expansion.expand_table(order_lists(spark, d).select("l_orderkey", "items"), array_max=1, lengths=True)
    return out.select("l_orderkey", F.col("`items#length`").cast("long").alias("n"), F.col("`items[0].part`").alias("part0"), F.col("`items[0].qty`").alias("qty0"), joined_text(F.col("`items[].part`")).alias("parts"))


@query("with o as (select l_orderkey, list(distinct l_orderkey) as same, list(l_partkey order by l_partkey) as parts from lineitem group by 1) select l_orderkey, same[1] as same, cast(len(parts) as bigint) as n from o")
def compress_uniform(spark, d):
    own = order_lists(spark, d)
    own = own.select("l_orderkey", F.transform("parts", lambda x: F.col("l_orderkey")).alias("same[]"), F.col("parts").alias("parts[]"))
    out = expansion.compress_uniform(own, ["same[]", "parts[]"])
    return out.select("l_orderkey", "same", F.size("`parts[]`").cast("long").alias("n"))
