"""Queries that write files of the given rows' data and read them again: lines, flows, changes, reports."""

from pyspark.sql import functions as F

from ..functions import calls as fc
from ..operators import pairing, routing, versions
from ..sources import logs
from .adapters import CALLS, CHANGES, calls, changes, reread
from .calls_queries import PAIRS
from .registry import query
from .rule_queries import ATTACKED, _found

FILES = 5

LINES_SQL = f"""select p.api, e.t as time, x.t as response_time, 'a' || e.seq as arguments, e.auth as auth, x.k % 10 = 0 as has_error,
  case when x.k % 10 <> 0 and x.k % 3 > 0 then '"r' || x.seq || '"' end as response, case when x.k % 10 = 0 and x.k % 20 = 0 then 'broken' end as throwable
from ({PAIRS}) p join (select event_id as seq, epoch_us(ts) / 1e6 as t, user_id % 8 as auth from events) e on e.seq = p.enter_pos
join (select event_id as seq, epoch_us(ts) / 1e6 as t, cast(json_extract_string(props, '$.k') as bigint) as k from events) x on x.seq = p.exit_pos"""


@query(LINES_SQL)
def lines_to_calls(spark, d):
    # several files, blank lines among them; the calls come from the places of the lines in all files
    own, leaves, k = calls(spark, d), F.col("seq") % 2 == 1, F.col("k")
    line = F.to_json(F.struct(
        F.col("api").alias("methodName"), (~leaves).alias("isEnter"), F.col("t").alias("time"), F.when(~leaves, F.array(F.concat(F.lit("a"), "seq"))).alias("arguments"),
        F.create_map(F.lit("Authorization"), F.col("auth")).alias("headers"), F.when(leaves, k % 10 == 0).alias("hasError"),
        F.when(leaves, F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit('"r'), "seq", F.lit('"')))).alias("returnObj"), F.when(leaves & (k % 20 == 0), "broken").alias("throwable"),
    ))
    text = own.repartitionByRange(FILES, "seq").sortWithinPartitions("seq").select(F.explode(F.when(F.col("seq") % 11 == 0, F.array(F.lit(" "), line)).otherwise(F.array(line))).alias("value"))
    back = reread(spark, text.write.text, lambda path: logs.read_lines(spark, path))
    out = pairing.calls_of_lines(back)
    return out.select("api", "time", "response_time", F.array_join("arguments", ",").alias("arguments"), fc.authorization(F.col("headers")).cast("long").alias("auth"), "has_error", "response", "throwable")


def _said(entries):
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query(f"""with {CALLS} select case when k % 2 = 0 then 'english' else 'french' end as api, strftime(make_timestamp(cast(round(t * 1e6) as bigint)), '%Y-%m-%d %H:%M:%S.%f') as time,
case when k % 3 = 0 then 'path_param_0=p' || user_id || ',path_param_1=x,k=' || k when k % 3 = 1 then 'path_param_0=p' || user_id || ',path_param_1=own' else 'path_param_0=p' || user_id || ',path_param_1=x,body=plain' end as arguments,
auth, 350 + k >= 400 as has_error, case when seq % 2 = 0 then '{{"n":' || k || '}}' else '"no json"' end as response from calls where k % 7 <> 0 and k % 5 <> 0""")
def flows_to_calls(spark, d):
    # flows of unknown routes, and unanswered ones, are no calls; a field of the body with a path parameter's name stands
    k = F.col("k")
    root = F.when(k % 5 == 0, "/zz/").when(k % 2 == 0, "/en/").otherwise("/fr/")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).when(k % 3 == 1, '{"path_param_1":"own"}').otherwise("plain")
    flows = calls(spark, d).select(
        F.concat(root, F.lit("p"), "user_id", F.lit("/x?q=1")).alias("path"), F.col("t").alias("req_ts"), body.alias("req_body"), F.create_map(F.when(k % 2 == 0, "authorization").otherwise("Authorization"), F.col("auth")).alias("req_headers"),
        (F.col("t") + 1).alias("resp_ts"), F.when(k % 7 != 0, 350 + k).cast("int").alias("status"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}"))).otherwise("no json").alias("resp_body"),
    )
    back = reread(spark, flows.write.json, lambda path: logs.read_flows(spark, path))
    catalogue = spark.createDataFrame([("english", "/en/{page}", 0), ("french", "/fr/{page}/{part}", 1)], "api string, url_path string, position int")
    out = routing.calls_of_flows(back, catalogue)
    return out.select("api", "time", _said(F.col("arguments")).alias("arguments"), fc.authorization(F.col("headers")).alias("auth"), "has_error", "response")


@query(f"with {CHANGES} select pos, type, pk::varchar as pk, ts_s, before, after from changes")
def read_changes(spark, d):
    own = changes(spark, d)
    row = lambda v: F.create_map(F.lit("id"), F.col("pk").cast("string"), F.lit("value"), F.col(v).cast("string"))
    update = F.col("type") == "update"
    rows = F.array(F.struct(F.when(update, row("before")).alias("before_values"), F.when(update, row("after")).alias("after_values"), F.when(~update, row("before")).alias("values")))
    log = own.select("pos", "type", F.lit("db").alias("schema"), F.lit("users").alias("table"), F.col("ts_s").alias("timestamp"), rows.alias("rows"))
    back = reread(spark, log.write.json, lambda path: logs.read_changes(spark, path))
    keys = spark.createDataFrame([("users", ["id"])], "table string, primary_keys array<string>")
    out = versions.normalized_changes(back, keys, schema="db")
    value = lambda c: F.element_at(c, F.lit("value")).cast("double").alias(c)
    return out.select("pos", "type", "pk", "ts_s", value("before"), value("after"))


@query(f"with {ATTACKED} select * from found")
def report_records(spark, d):
    # a folder for each API, read again
    found = _found(spark, d)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return reread(spark, lambda path: logs.write_violations(found, path, by="api"), lambda path: spark.read.schema(schema).json(path)).select(*found.columns)
