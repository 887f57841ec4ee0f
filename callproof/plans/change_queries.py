"""Queries on row versions."""

from pyspark.sql import functions as F

from ..operators import versions
from .adapters import CHANGES, calls, changes, table
from .registry import query


def _raw(spark, d):
    """The changes as a change log: updates of one row, some of a shard, some of another schema."""
    c = changes(spark, d)
    key = F.col("pk").cast("string")
    row = lambda v: F.create_map(F.lit("id"), key, F.lit("value"), v.cast("string"))
    none = F.lit(None).cast("map<string,string>")
    first = F.col("before").isNull() & (F.col("type") == "update")
    kind = F.when(first, "insert").otherwise(F.col("type"))
    item = F.struct(F.when(kind == "update", row(F.col("before"))).otherwise(none).alias("before_values"), F.when(kind == "update", row(F.col("after"))).otherwise(none).alias("after_values"), F.when(kind != "update", row(F.coalesce("after", "before"))).otherwise(none).alias("values"))
    return c.select("pos", kind.alias("type"), F.when(F.col("pos") % 10 == 0, "other").otherwise("main").alias("schema"), F.when(F.col("pk") % 2 == 0, "orders_other").otherwise("orders").alias("table"), F.col("ts_s").alias("timestamp"), F.array(item).alias("rows"))


@query(f"with {CHANGES} select pos, case when type = 'update' and before is null then 'insert' else type end as type, 'orders' as \"table\", cast(pk as varchar) as pk, ts_s from changes where pos % 10 <> 0")
def changes_normalized(spark, d):
    keys = spark.createDataFrame([("orders", ["id"]), ("pairs", ["a", "b"])], "`table` string, primary_keys array<string>")
    return versions.normalized_changes(_raw(spark, d), keys, schema="main").select("pos", "type", "table", "pk", "ts_s")


VERSIONS = CHANGES + """, numbered as (select *, (select count(*) from changes c where c.pk = changes.pk and c.pos <= changes.pos) as ver from changes),
versions as (select pk, cast(ver as int) as ver, ts_s, after as row, (select max(ts_s) from changes c where c.pk = numbered.pk) as last_ts_s from numbered
  union all select pk, 0, 0, before, (select max(ts_s) from changes c where c.pk = numbered.pk) from numbered where ver = 1)"""


def _versions(spark, d):
    return versions.row_versions(changes(spark, d), keys=("pk",))


@query(f"with {VERSIONS} select * from versions")
def row_versions(spark, d):
    return _versions(spark, d)


def _lookups(spark, d):
    return calls(spark, d).where(F.col("api") == "view").select("seq", "t", F.col("user_id").alias("pk"))


@query(f"""with {VERSIONS}, looked as (select seq, t, user_id as pk from calls where api = 'view'),
met as (select seq, t, pk, (select max(last_ts_s) from versions v where v.pk = l.pk) as last_ts,
  (select coalesce(max(ver) filter (where ts_s < floor(t - 1) and ver > 0), 0) from versions v where v.pk = l.pk) as ver from looked l)
select seq, last_ts is not null and t <= last_ts as found, case when last_ts is not null and t <= last_ts then (select max(row) from versions v where v.pk = met.pk and v.ver = met.ver) end as row from met""")
def asof_row_version(spark, d):
    return versions.version_at(_lookups(spark, d), _versions(spark, d), keys=("pk",)).select("seq", "found", "row")


@query(f"""with {VERSIONS}, s as (select pk, min(ts_s) as low, max(ts_s) as high from changes group by 1), l as (select distinct user_id as pk, t from calls where api = 'view'),
r as (select l.pk, l.t, (select count(*) from changes c where c.pk = l.pk and c.ts_s between floor(l.t - 1) and floor(l.t + 2)) as changes, s.low >= floor(l.t - 1) as none_before from l join s on s.pk = l.pk and l.t <= s.high)
select * from r where changes > 1 or none_before""")
def version_ambiguity(spark, d):
    return versions.ambiguous_versions(_lookups(spark, d), _versions(spark, d), keys=("pk",)).select("pk", "t", "changes", "none_before")


@query(f"""with {CHANGES}, b as (select *, case when pos % 50 = 0 then ts_s - 1000000 else ts_s end as ts, case when pos % 30 = 0 then coalesce(before, 0) + 1 else before end as old from changes),
p as (select *, (select max(pos) from b c where c.pk = b.pk and c.pos < b.pos) as previous from b),
j as (select p.pk, p.pos, p.ts, p.old, q.ts as q_ts, q.after as q_after, p.previous from p left join b q on q.pk = p.pk and q.pos = p.previous)
select pk, pos, 'time goes back' as violation from j where q_ts > ts
union all select pk, pos, 'old value differs' from j where previous is not null and old is distinct from q_after""")
def validate_changes(spark, d):
    own = changes(spark, d)
    own = own.withColumns({"ts_s": F.when(F.col("pos") % 50 == 0, F.col("ts_s") - 1000000).otherwise(F.col("ts_s")), "before": F.when(F.col("pos") % 30 == 0, F.coalesce("before", F.lit(0.0)) + 1).otherwise(F.col("before"))})
    return versions.validate_changes(own, keys=("pk",))


@query("select o_orderkey, o_custkey from orders")
def merge_tables(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return versions.merge_tables([own.where("o_orderkey % 2 = 0"), own.where("o_orderkey % 2 = 1")])


@query(f"with {CHANGES} select pk, pos, type from changes")
def merge_changes(spark, d):
    own = changes(spark, d).select("pk", "pos", "type")
    return versions.merge_changes(own.where("pk % 2 = 0"), own.where("pk % 2 = 1"), keys=("pk",))


@query(f"""with {CHANGES}, r as (select *, type = 'update' and before is null as fresh from changes), u as (select *, type = 'update' and not fresh as up from r)
select cast(pk as varchar) as pk, pos, 'key changed' as violation from u where up and pos % 7 = 0
union all select cast(pk as varchar), pos, 'columns differ' from u where pos % 11 = 0""")
def validate_change_rows(spark, d):
    raw = _raw(spark, d)
    # every seventh update has another key after it, every eleventh row lacks a column
    key = lambda m: F.when(F.col("pos") % 7 == 0, F.transform_values(m, lambda k, v: F.when(k == "id", F.concat(v, F.lit("x"))).otherwise(v))).otherwise(m)
    less = lambda m: F.when(F.col("pos") % 11 == 0, F.map_filter(m, lambda k, v: k != "value")).otherwise(m)
    item = lambda r: F.struct(less(r["before_values"]).alias("before_values"), less(key(r["after_values"])).alias("after_values"), less(r["values"]).alias("values"))
    keys = spark.createDataFrame([("orders", ["id"], ["id", "value"])], "`table` string, primary_keys array<string>, all_columns array<string>")
    own = versions.normalized_changes(raw.withColumn("rows", F.transform("rows", item)), keys)
    return versions.validate_changes(own, catalogue=keys).where(F.col("violation").isin("key changed", "columns differ")).select("pk", "pos", "violation")


@query("select 'orders' as \"table\", 'o_orderkey' as keys, string_agg(column_name, ',' order by column_name) as columns from (describe orders)")
def merge_table_keys(spark, d):
    own = table(spark, d, "orders")
    keys = spark.createDataFrame([(n, ["o_orderkey"], own.columns) for n in ("orders", "orders_other")], "`table` string, primary_keys array<string>, all_columns array<string>")
    return versions.merge_table_keys(keys).select("table", F.array_join("primary_keys", ",").alias("keys"), F.array_join(F.array_sort("all_columns"), ",").alias("columns"))
