"""Queries on profiles, shapes, keys and relations."""

from pyspark.sql import functions as F

from ..operators import keys, profile
from ..sources import logs, snapshots
from .adapters import CALLS, calls, reread, table
from .registry import query

NAMES = ["customer", "orders", "part", "supplier", "nation", "region"]


def _tables(spark, d, names=NAMES):
    return {n: table(spark, d, n) for n in names}


NUMBERS = {"c_custkey": "int", "c_nationkey": "int", "c_acctbal": "float"}
TEXTS = ["c_name", "c_mktsegment"]


def _profile_sql(columns: str) -> str:
    parts = []
    for c in [*NUMBERS, *TEXTS]:
        number = c in NUMBERS
        kind = NUMBERS.get(c, "str")
        parts.append(
            f"select '{c}' as \"column\", '{kind}' as kind, count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", "
            + ("cast(null as bigint) as len_min, cast(null as bigint) as len_max, " if number else f"min(length({c})) as len_min, max(length({c})) as len_max, ")
            + (f"cast(min({c}) as double) as value_min, cast(max({c}) as double) as value_max" if number else "cast(null as double) as value_min, cast(null as double) as value_max")
            + " from customer"
        )
    return f"with p as ({' union all '.join(parts)}) select {columns} from p"


@query(_profile_sql("*"))
def profile_columns(spark, d):
    return profile.profile_columns(table(spark, d, "customer"))


@query("with v as (select json_type(case event_id % 4 when 1 then '1.5e0' when 3 then 'null' else json_extract_string(props, '$.k') end::json) as ty from events), k as (select list(distinct case when ty in ('BIGINT', 'UBIGINT') then 'int' when ty = 'DOUBLE' then 'float' when ty = 'VARCHAR' then 'str' else lower(ty) end) filter (where ty <> 'NULL') as kinds from v) select 'number' as \"column\", case when len(kinds) = 0 then 'null' when len(kinds) = 1 then kinds[1] when list_has_all(['int', 'float'], kinds) then 'float' else 'unknown' end as kind from k")
def column_kind(spark, d):
    # numbers of two kinds, and nulls, are one kind
    text = F.when(F.col("seq") % 4 == 1, "1.5e0").when(F.col("seq") % 4 == 3, "null").otherwise(F.col("k").cast("string"))
    kinds = calls(spark, d).agg(F.array_sort(F.collect_set(profile.json_kind(F.try_parse_json(text)))).alias("kinds"))
    return kinds.select(F.lit("number").alias("column"), profile.merged_kind(F.col("kinds")).alias("kind"))


@query("select 'o_custkey' as \"column\", count(o_custkey) = count(distinct o_custkey) as is_unique from orders union all select 'o_orderkey', count(o_orderkey) = count(distinct o_orderkey) from orders")
def column_unique(spark, d):
    out = profile.profile_columns(table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    return out.select("column", (F.col("rows") - F.col("nulls") == F.col("distinct")).alias("is_unique"))


@query(f"with {CALLS}, v as (select api, unnest([k, k + 1]) as x from calls) select api, count(*) as n, min(x) as low, max(x) as high, count(distinct x) as \"distinct\" from v group by 1")
def profile_array(spark, d):
    values = calls(spark, d).select("api", F.lit("$").alias("path"), F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("x"))
    out = profile.path_level(values.select("api", "path", F.try_parse_json(F.col("x").cast("string")).alias("v")))
    return out.select("api", F.col("rows").alias("n"), F.col("value_min").cast("long").alias("low"), F.col("value_max").cast("long").alias("high"), "distinct")


@query(f"with {CALLS} select api, 'k' as key, count(*) as n, count(*) as objects from calls group by 1")
def profile_object(spark, d):
    values = calls(spark, d).select("api", F.lit("$").alias("path"), F.try_parse_json("arguments").alias("v"))
    return profile.object_keys(values).select("api", "key", "n", "objects")


@query(f"with {CALLS}, k as (select api, 'u' || user_id as key, count(*) as n, (select count(*) from calls c where c.api = calls.api) as objects from calls group by api, user_id) select api, count(*) as keys, count(*) filter (where n < objects) as optional, case when count(*) filter (where n < objects) > 5 or count(*) > 30 then 'dict' else 'object' end as kind from k group by 1")
def object_or_map(spark, d):
    text = F.to_json(F.create_map(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("value")))
    values = calls(spark, d).select("api", F.lit("$").alias("path"), F.try_parse_json(text).alias("v"))
    return profile.object_or_map(profile.object_keys(values)).select("api", "keys", "optional", "kind")


def _schemas_sql() -> str:
    none = "cast(null as bigint)"
    some = "case when k % 2 = 0 then value end"
    rows = [  # path, kind, what is counted, its distinct form, lengths, numbers, from, whether it is a field
        ("$", "object", "1", f"{{'a': user_id, 'b': auth, 'c': k, 'd': {some}}}", None, None, "calls", 0), ("$.who", "object", "1", "{'a': user_id, 'b': auth}", None, None, "calls", 1),
        ("$.who.user_id", "int", "user_id", "user_id", None, "user_id", "calls", 1), ("$.who.auth", "str", "auth", "auth", "length(auth)", None, "calls", 1), ("$.items", "array", "1", "k", "2", None, "calls", 1),
        ("$.items[]", "int", "x", "x", None, "x", "(select api, unnest([k, k + 1]) as x from calls)", 0), ("$.value", "float", some, some, None, some, "calls", 1),
        ('$."who.auth"', "int", "k", "k", None, "k", "calls", 1), ('$."items[]"', "str", "auth", "auth", "length(auth)", None, "calls", 1),
    ]
    ends = lambda c, t: ", ".join(f"cast({f}({c}) as {t})" if c else (none if t == "bigint" else "cast(null as double)") for f in ("min", "max"))
    always = lambda what, field: f"count({what}) = count(*)" if field else "cast(null as boolean)"
    parts = [f"select api, '{p}' as path, '{kind}' as kind, count({what}) as rows, 0 as nulls, count(distinct {form}) as \"distinct\", {ends(size, 'bigint')}, {ends(number, 'double')}, {always(what, field)} from {source} group by 1" for p, kind, what, form, size, number, source, field in rows]
    return f"with {CALLS}, found(api, path, kind, rows, nulls, \"distinct\", len_min, len_max, value_min, value_max, always_exists) as ({' union all '.join(parts)}) select * from found where rows > 0"


def _nested_values(spark, d):
    # keys that look like other paths, and a field that some records lack
    odd = [F.col("k").alias("who.auth"), F.col("auth").alias("items[]")]
    text = F.to_json(F.struct(F.struct("user_id", "auth").alias("who"), F.array("k", F.col("k") + 1).alias("items"), F.when(F.col("k") % 2 == 0, F.col("value")).alias("value"), *odd))
    return calls(spark, d).select("api", F.try_parse_json(text).alias("v"))


@query(_schemas_sql())
def api_schemas(spark, d):
    return profile.api_schemas(_nested_values(spark, d)).drop("steps")


@query(f"select api, path, '<some ' || kind || ' value>' as placeholder from ({_schemas_sql()}) where kind not in ('object', 'array')")
def schema_view(spark, d):
    return profile.schema_view(profile.api_schemas(_nested_values(spark, d)))


#: Kinds of the columns of a query, told by DuckDB.
KIND_SQL = "case when column_type in ('BIGINT', 'INTEGER') then 'int' when column_type = 'DOUBLE' then 'float' else 'str' end"


@query(f"with a as (select column_name as c, {KIND_SQL} as kind from (describe select c_custkey as key, c_name as name, c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment from customer)), b as (select column_name as c, {KIND_SQL} as kind from (describe select s_suppkey as key, s_name as name, cast(s_nationkey as varchar) as nation, s_acctbal as balance, s_suppkey as number from supplier)) select coalesce(a.c, b.c) as \"column\", case when a.c is null then 'right only' when b.c is null then 'left only' else 'differs' end as difference from a full join b on a.c = b.c where a.kind is distinct from b.kind")
def schema_diff(spark, d):
    # the soft comparison: kinds alone
    return profile.schema_diff(*_compared(spark, d), ["kind"])


def _compared(spark, d):
    left = table(spark, d, "customer").toDF("key", "name", "nation", "balance", "segment")
    s = table(spark, d, "supplier")
    right = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("number"))
    return profile.profile_columns(left), profile.profile_columns(right)


def _strict_sql() -> str:
    def of(parts) -> str:
        return " union all ".join(f"select '{c}' as c, {KIND_SQL.replace('column_type', f'typeof(any_value({e}))')} as kind, {f'min(length({e}))' if text else 'null'} as low, {f'max(length({e}))' if text else 'null'} as high, {'null' if text else f'min({e})::double'} as v_low, {'null' if text else f'max({e})::double'} as v_high from {t}" for c, e, text, t in parts)

    left = [("key", "c_custkey", 0, "customer"), ("name", "c_name", 1, "customer"), ("nation", "c_nationkey", 0, "customer"), ("balance", "c_acctbal", 0, "customer"), ("segment", "c_mktsegment", 1, "customer")]
    right = [("key", "s_suppkey", 0, "supplier"), ("name", "s_name", 1, "supplier"), ("nation", "cast(s_nationkey as varchar)", 1, "supplier"), ("balance", "s_acctbal", 0, "supplier"), ("number", "s_suppkey", 0, "supplier")]
    differs = " or ".join(f"a.{c} is distinct from b.{c}" for c in ("kind", "low", "high", "v_low", "v_high"))
    return f"with a as ({of(left)}), b as ({of(right)}) select coalesce(a.c, b.c) as \"column\", case when a.c is null then 'right only' when b.c is null then 'left only' else 'differs' end as difference from a full join b on a.c = b.c where a.c is null or b.c is null or {differs}"


@query(_strict_sql())
def schema_diff_strict(spark, d):
    return profile.schema_diff(*_compared(spark, d), ["kind", "len_min", "len_max", "value_min", "value_max"])


@query("select c as \"column\" from (select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) as c, unnest([count(*) - count(o_orderkey), count(*) - count(o_custkey), count(*) - count(nullif(o_orderstatus, 'F'))]) as n from orders) where n = 0")
def infer_not_null(spark, d):
    return profile.not_null_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus")))


@query("select c as \"column\" from (select unnest(['o_orderkey', 'o_custkey', 'first']) as c, unnest([count(distinct o_orderkey), count(distinct o_custkey), count(distinct nullif(o_orderkey, 0)) + max(case when o_orderkey = 0 then 1 else 0 end)]) as n, count(*) as r from orders) where n = r")
def infer_unique(spark, d):
    return profile.unique_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderkey", F.lit(0)).alias("first")))


@query(f"with {CALLS} select api, case when api = 'view' then '__str__,k' else 'k' end as fields from calls group by 1")
def api_fields(spark, d):
    answer = F.when((F.col("api") == "view") & (F.col("seq") % 2 == 0), F.lit('"text"')).otherwise(F.col("arguments"))
    return profile.api_fields(calls(spark, d).withColumn("response", answer))


SHAPED = f"with {CALLS}, s as (select api, seq, case when k % 3 = 0 then 'k:int' when k % 3 = 1 then 'k:int,v:float' else 'k:int,name:str' end as signature from calls), g as (select api, signature, count(*) as n_calls, min(seq) as first_seq from s group by 1, 2)"


def _shaped(spark, d):
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"k":'), k, F.lit("}"))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"v":1.5,"k":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"name":"x","k":'), k, F.lit("}")))
    return profile.shape_groups(calls(spark, d), profile.flat_signature(text))


@query(SHAPED + " select * from g")
def shape_groups(spark, d):
    return _shaped(spark, d)


@query(SHAPED + " select api, signature, n_calls, rank from (select *, row_number() over (partition by api order by length(signature) desc, signature) as rank from g) where rank <= 2")
def shape_topk(spark, d):
    return profile.shape_topk(_shaped(spark, d), 2).select("api", "signature", "n_calls", F.col("rank").cast("long").alias("rank"))


@query(f"with {CALLS} select api, count(*) as n_calls from calls where api in (select event_type from events where value > 10) group by 1 having count(*) >= 5")
def eligible_apis(spark, d):
    own = calls(spark, d)
    return profile.eligible_apis(own, own.where(F.col("value") > 10))


def _nested_shape(kind: str) -> str:
    """The shape of a call's nested value in SQL: the longer of two items stands for a list."""
    items = "case when k % 3 = 0 then '[]' when k % 3 = 1 then '[{\"n\":\"int\"}]' else '[{\"n\":\"int\",\"t\":\"str\"},\"extra\"]' end"
    return f"'{{\"items\":' || {items} || ',\"who\":{{\"name\":\"' || case when user_id % 2 = 0 then 'str' else 'null' end || '\"}}}}'"


@query(f"with {CALLS} select api, {_nested_shape('')} as signature, count(*) as n_calls, min(seq) as first_seq from calls group by 1, 2")
def nested_shapes(spark, d):
    k = F.col("k").cast("string")
    one, two = F.concat(F.lit('{"n":'), k, F.lit("}")), F.concat(F.lit('{"t":"x","n":'), k, F.lit("}"))
    items = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, one).otherwise(F.concat_ws(",", one, two))
    name = F.when(F.col("user_id") % 2 == 0, '"n"').otherwise("null")
    return profile.shape_groups(calls(spark, d), profile.shape_signature(F.concat(F.lit('{"who":{"name":'), name, F.lit('},"items":['), items, F.lit("]}"))))


@query("with p as (select l_orderkey, list(l_partkey order by l_partkey) as parts from lineitem group by 1) select l_orderkey, '{\"inner\":{\"n\":' || len(parts) || '},\"parts\":[' || array_to_string(parts[1:3], ',') || case when len(parts) > 3 then ',\"<extra list items . . .>\"' else '' end || ']}' as record from p")
def trim_record(spark, d):
    from .adapters import order_lists

    own = order_lists(spark, d)
    text = F.to_json(F.struct(F.struct(F.size("parts").alias("n"), F.lit(None).cast("int").alias("none")).alias("inner"), F.col("parts"), F.lit(None).cast("string").alias("gone")), {"ignoreNullFields": "false"})
    return own.select("l_orderkey", profile.trimmed_json(text).alias("record"))


@query(f"with {CALLS} select api, case when max(user_id % 2) = 1 and min(user_id % 2) = 0 then 'orders,user' when max(user_id % 2) = 1 then 'orders' else 'user' end as names from calls group by 1")
def related_names(spark, d):
    info = F.create_map(F.when(F.col("user_id") % 2 == 0, "user").otherwise("orders"), F.col("value"))
    return profile.related_names(calls(spark, d).withColumn("db_info", info), "db_info")


# --- sources -------------------------------------------------------------------------------------------------


def _written(spark, d):
    from ..functions.calls import time_text

    own = calls(spark, d).select(time_text(F.col("t")).alias("time"), "api", "arguments", F.create_map(F.lit("authorization"), F.col("auth")).alias("headers"), (F.col("k") > 90).alias("has_error"), F.when(F.col("seq") % 5 == 0, "test").otherwise("train").alias("split"))
    return reread(spark, lambda path: logs.write_calls(own, path, compression="gzip"), lambda path: logs.read_calls(spark, path))


@query(f"with {CALLS} select api, count(*) as n, min(auth) as low_auth, sum(k)::bigint as k from calls group by 1")
def read_calls(spark, d):
    back = _written(spark, d)
    return back.groupBy("api").agg(F.count("*").alias("n"), F.min(F.col("headers")["authorization"]).alias("low_auth"), F.sum(F.get_json_object("arguments", "$.k").cast("long")).alias("k"))


@query(f"with {CALLS} select strftime(make_timestamp(cast(round(t * 1e6) as bigint)), '%Y-%m-%d %H:%M:%S.%f') as time, api, arguments, auth, k > 90 as has_error, case when seq % 5 = 0 then 'test' else 'train' end as split, cast(null as varchar) as response from calls")
def write_calls(spark, d):
    return _written(spark, d).select("time", "api", "arguments", F.col("headers")["authorization"].alias("auth"), "has_error", "split", "response")


@query(" union all ".join(f"select '{n}' as \"table\", count(*) as n from {n}" for n in NAMES))
def snapshot_tables(spark, d):
    tables = _tables(spark, d)
    tables["empty"] = tables["region"].where(F.lit(False))
    out = None
    for name, df in snapshots.snapshot_tables(tables).items():
        own = df.select(F.lit(name).alias("table")).groupBy("table").agg(F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("select c_custkey as id, c_name as name, cast(null as varchar) as email from customer")
def align_to_schema(spark, d):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("email", StringType())])
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return snapshots.align_to_schema(own, schema)


@query("select * from (values ('nation', 'n_nationkey', 'n_nationkey,n_name,n_regionkey', (select count(*) from nation)), ('region', cast(null as varchar), 'r_regionkey,r_name', (select count(*) from region))) as t(\"table\", keys, columns, n)")
def table_keys(spark, d):
    tables = _tables(spark, d, ["nation", "region"])
    out = snapshots.table_keys(snapshots.column_catalogue(spark, tables, {"nation": ["n_nationkey"]}))
    counts = None
    for n, df in tables.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        counts = own if counts is None else counts.unionByName(own)
    return out.join(counts, "table").select("table", F.array_join("primary_keys", ",").alias("keys"), F.array_join("all_columns", ",").alias("columns"), "n")


@query("with p as (select distinct a.n_name as api, b.n_name as source_api from nation a join nation b on a.n_regionkey = b.n_regionkey) select * from p where api <> source_api")
def flows_from_map(spark, d):
    n = table(spark, d, "nation")
    other = n.select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("source"))
    maps = n.join(other, F.col("n_regionkey") == F.col("r")).groupBy("n_name").agg(F.collect_list("source").alias("s")).select(F.to_json(F.create_map("n_name", "s")).alias("value"))
    return logs.flows_from_map(maps)


# --- keys ----------------------------------------------------------------------------------------------------

KEYS = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}


def _values(spark, d):
    return keys.column_values({t: table(spark, d, t).select(*c) for t, c in KEYS.items()})


def _values_sql() -> str:
    text = ("c_mktsegment", "o_orderstatus")
    parts = [f"select distinct '{t}' as t, '{c}' as c, '{'str' if c in text else 'int'}' as kind, cast({c} as varchar) as v from {t} where {c} is not null" for t, cs in KEYS.items() for c in cs]
    return f"v as ({' union all '.join(parts)}), sizes as (select t, c, count(*) as n from v group by 1, 2), pairs as (select a.t as from_table, a.c as from_column, b.t as to_table, b.c as to_column, (select count(*) from v x where x.t = a.t and x.c = a.c and x.kind || x.v in (select y.kind || y.v from v y where y.t = b.t and y.c = b.c)) as shared, a.n as n from sizes a, sizes b where a.t <> b.t or a.c <> b.c)"


OVERLAP = f"with {_values_sql()}, o as (select from_table, from_column, to_table, to_column, shared, shared / n as ratio from pairs where from_table <> to_table and shared / n > 0.2)"


@query(f"with c as (select 'customer' as t, column_name as c, {KIND_SQL} as kind from (describe customer) union all select 'log::events', column_name, {KIND_SQL} from (describe select * exclude (ts) from events)) select t as \"table\", c as \"column\", left(t, 5) <> 'log::' as can_be_target from c where kind in ('str', 'int') and not regexp_matches(c, '(?i)header|#length|#exists|^time$|response_time')")
def fk_candidates(spark, d):
    out = profile.profile_columns(table(spark, d, "customer")).select(F.lit("customer").alias("table"), "column", "kind")
    log = profile.profile_columns(table(spark, d, "events").drop("ts")).select(F.lit("log::events").alias("table"), "column", "kind")
    return keys.candidates(out.unionByName(log)).select("table", "column", "can_be_target")


@query(OVERLAP + " select * from o")
def fk_overlap(spark, d):
    return keys.fk_overlap(_values(spark, d)).select("from_table", "from_column", "to_table", "to_column", "shared", "ratio")


@query(f"with {_values_sql()} select from_table, from_column, to_table, to_column from pairs where shared = n")
def inclusion_deps(spark, d):
    return keys.inclusion_deps(_values(spark, d))


@query(OVERLAP + " select from_table, from_column, string_agg(to_table || '.' || to_column, ',' order by to_table || '.' || to_column) as targets from o group by 1, 2")
def fk_by_source(spark, d):
    return keys.by_source(keys.fk_overlap(_values(spark, d)))


def _cardinality_sql(columns) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", (select case when max(n) > 1 then 'many' else 'one' end from (select count(distinct l_orderkey) as n from lineitem group by {c})) || '_to_' || (select case when max(n) > 1 then 'many' else 'one' end from (select count(distinct {c}) as n from lineitem group by l_orderkey)) as cardinality" for c in columns
    )


@query(_cardinality_sql(["l_partkey", "l_suppkey", "l_linestatus"]))
def pair_cardinality(spark, d):
    return keys.pair_cardinality(table(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey", "l_linestatus"])
