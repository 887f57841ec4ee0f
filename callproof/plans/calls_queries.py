"""Queries on the parts of calls: pairing, headers, arguments, routes, bodies, times, identity, records."""

from pyspark.sql import functions as F

from ..functions import calls as fc
from ..operators import flow, pairing, routing
from .adapters import CALLS, calls, lines, table
from .registry import query

PAIRS = f"""with recursive {CALLS}, l as (select api, seq as pos, seq % 2 = 0 as is_enter, row_number() over (partition by api order by seq) as n from calls),
walk as (
  select api, cast(0 as bigint) as n, cast([] as bigint[]) as stack, cast(null as bigint) as enter_pos, cast(null as bigint) as exit_pos from l group by api
  union all
  select w.api, l.n, case when l.is_enter then list_append(w.stack, l.pos) when len(w.stack) > 0 then w.stack[1:len(w.stack) - 1] else w.stack end,
    case when not l.is_enter and len(w.stack) > 0 then w.stack[len(w.stack)] end, case when not l.is_enter and len(w.stack) > 0 then l.pos end
  from walk w join l on l.api = w.api and l.n = w.n + 1)
select api, enter_pos, exit_pos from walk where enter_pos is not null"""


@query(PAIRS)
def pair_calls(spark, d):
    return pairing.pair_calls(lines(spark, d))


HEADERS = "map {'Authorization': auth, '__env__user': user_id::varchar, '__query__k': k::varchar}"


def _headers():
    return F.create_map(F.lit("Authorization"), F.col("auth"), F.lit("__env__user"), F.col("user_id").cast("string"), F.lit("__query__k"), F.col("k").cast("string"))


@query(f"with {CALLS} select seq, 'user=' || user_id as env, 'k=' || k as queries, 'Authorization=' || auth as headers from calls")
def split_headers(spark, d):
    h = _headers()
    said = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return calls(spark, d).select("seq", said(fc.prefixed(h, fc.ENV)).alias("env"), said(fc.prefixed(h, fc.QUERY)).alias("queries"), said(fc.plain_headers(h)).alias("headers"))


@query(f"with {CALLS} select seq, api, case when api = 'view' then 'a=' || k else 'a=' || k || ',b=\"user ' || user_id || '\"' end as named from calls where api <> 'error'")
def name_arguments(spark, d):
    from .adapters import table as read

    names = F.when(F.col("api") == "view", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    catalogue = read(spark, d, "events").select(F.col("event_type").alias("api")).distinct().where("api <> 'error'").withColumn("argument_names", names)
    own = calls(spark, d).select("seq", "api", F.array(F.col("k").cast("string"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("arguments"))  # the second is no JSON
    out = routing.with_named_arguments(own, catalogue)
    return out.select("seq", "api", F.array_join(F.transform(F.map_entries("named"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("named"))


ROUTES = [("all", "/"), ("english", "/en/{page}"), ("french", "/fr/{page}"), ("spanish", "/es/{page}/{part}"), ("english again", "/en/{number}")]
PATHS = "paths as (select page_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) as path from pages)"


def _paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1).alias("path"))


def _routed(spark, d):
    catalogue = spark.createDataFrame([(a, u, k) for k, (a, u) in enumerate(ROUTES)], "api string, url_path string, position int")
    return routing.route_urls(_paths(spark, d), catalogue, keep_unmatched=True)


ROUTED = f"with {PATHS}, r as (select page_id, path, (select api from (values {', '.join(repr(x) for x in [('all', '', 0), ('french', '/fr', 2), ('spanish', '/es', 3), ('english again', '/en', 4)])}) as c(api, prefix, n) where starts_with(path, prefix) order by length(prefix) desc, n desc limit 1) as api from paths)"


@query(ROUTED + " select page_id, api from r")
def route_urls(spark, d):
    return _routed(spark, d).select("page_id", "api")


@query(ROUTED + ", v as (select page_id, string_split(trim(split_part(substr(path, case when api = 'all' then 1 else 4 end), '?', 1), '/'), '/') as parts from r) select page_id, parts[1] as first, cast(len(parts) as bigint) as n from v")
def path_params(spark, d):
    m = fc.path_params(F.col("path"), F.col("prefix"))
    return _routed(spark, d).select("page_id", F.element_at(m, F.lit("path_param_0")).alias("first"), F.size(m).cast("long").alias("n"))


@query(f"with {CALLS} select seq, case seq % 4 when 0 then 'k=' || k when 1 then 'body=plain' when 2 then 'body=[1]' else '' end as arguments from calls")
def decode_body(spark, d):
    body = F.when(F.col("seq") % 4 == 0, F.col("arguments")).when(F.col("seq") % 4 == 1, "plain").when(F.col("seq") % 4 == 2, "[1]")
    m = fc.body_arguments(body)
    return calls(spark, d).select("seq", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("arguments"))


@query(f"with {CALLS} select seq, k + 350 >= 400 as has_error, seq % 2 = 0 as is_json from calls where k % 7 <> 0")
def flow_status(spark, d):
    flows = calls(spark, d).withColumns({"status": F.when(F.col("k") % 7 != 0, F.col("k") + 350), "resp_body": F.when(F.col("seq") % 2 == 0, F.col("arguments")).otherwise("<p>")})
    return routing.flow_status(flows).select("seq", "has_error", "is_json")


@query(f"with {CALLS} select seq, strftime(make_timestamp(cast(round(t * 1e6) as bigint)), '%Y-%m-%d %H:%M:%S.%f') as time, case when seq % 3 = 0 then null else cast(round(t * 1e6) as bigint) end as back from calls")
def time_convert(spark, d):
    text = fc.time_text(F.col("t"))
    return calls(spark, d).select("seq", text.alias("time"), F.round(fc.time_seconds(F.when(F.col("seq") % 3 == 0, "").otherwise(text)) * 1e6).cast("long").alias("back"))


@query(f"with {CALLS} select seq, case seq % 3 when 0 then 'execute.serivce.ExecuteServiceImpl.ticketCollect' when 1 then 'execute.serivce.ExecuteServiceImpl.ticketExecute' else api end as api from calls")
def rename_api(spark, d):
    first, second = fc.RENAMED
    old = F.when(F.col("seq") % 3 == 0, first).when(F.col("seq") % 3 == 1, second).otherwise(F.col("api"))
    return calls(spark, d).select("seq", fc.renamed_api(old).alias("api"))


@query(f"with {CALLS} select seq, api from calls where seq % 5 <> 0")
def filter_split(spark, d):
    return calls(spark, d).withColumn("split", F.when(F.col("seq") % 5 == 0, "test").otherwise("train")).transform(routing.of_split, "train").select("seq", "api")


@query(f"with {CALLS} select api, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from calls where api <> 'view' and seq % 10 <> 0 group by 1")
def calls_by_api(spark, d):
    own = calls(spark, d).withColumn("api", F.when(F.col("api") == "view", "").otherwise(F.col("api")))
    kept = routing.named_and_timed(own.withColumn("time", F.when(F.col("seq") % 10 == 0, "no time").otherwise(fc.time_text(F.col("t")))))
    return kept.groupBy("api").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"with {CALLS} select 'click' as api, (select count(*) from calls where api = 'click') as n_calls union all select 'unused', 0")
def known_api_calls(spark, d):
    catalogue = spark.createDataFrame([("click",), ("unused",)], "api string")
    return routing.known_counts(routing.known_calls(calls(spark, d), catalogue), catalogue)


@query(f"with {CALLS} select seq, case when k % 4 < 2 then 'u' || user_id else '' end as user_id, k % 4 < 2 as is_user, k % 4 = 1 as is_admin from calls")
def token_context(spark, d):
    roles = F.when(F.col("k") % 4 == 1, F.array(F.lit("ROLE_USER"), F.lit("ROLE_ADMIN"))).otherwise(F.array(F.lit("ROLE_USER")))
    payload = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), roles.alias("roles")))
    token = F.concat(F.lit("Bearer h."), F.rtrim(F.translate(F.base64(F.encode(payload, "utf-8")), "+/", "-_"), F.lit("=")), F.lit(".s"))
    header = F.when(F.col("k") % 4 < 2, token).when(F.col("k") % 4 == 2, "Bearer two.parts")
    return calls(spark, d).select("seq", fc.token_context(header).alias("c")).select("seq", "c.*")


def _parts():
    none = F.expr("cast(map() as map<string,string>)")
    return F.from_json("arguments", "map<string,string>"), F.when(F.col("seq") % 2 == 0, F.col("arguments")).otherwise(F.lit('"done"')), F.create_map(F.lit("authorization"), F.col("auth")), F.when(F.col("seq") % 3 == 0, none).otherwise(F.create_map(F.lit("user"), F.col("user_id").cast("string")))


@query(f"with {CALLS} select seq, k::varchar as a, case when seq % 2 = 0 then k::varchar end as r, auth as h, case when seq % 3 <> 0 then user_id::varchar end as e, cast(3 + (seq % 3 <> 0)::int as bigint) as n from calls")
def check_record(spark, d):
    own = calls(spark, d)
    fields = fc.check_record(*_parts(), ["argument.k", "response.k", "header.authorization", "env.user"])
    flat = fc.check_record(*_parts())
    at = lambda k: F.element_at(fields, F.lit(k))
    return own.select("seq", at("argument.k").alias("a"), at("response.k").alias("r"), at("header.authorization").alias("h"), at("env.user").alias("e"), F.size(flat).cast("long").alias("n"))


@query(f"with {CALLS} select seq, '{{\"arguments\":{{\"headers\":\"' || auth || '\"}},\"related\":null,\"related_events\":{{\"login\":' || case when seq % 2 = 0 then '{{\"env\":' || user_id || '}}' else 'null' end || '}}}}' as record from calls")
def execute_record(spark, d):
    # two arguments that carry headers: the last of them in the list of names stands
    arguments = fc.header_argument_renamed(F.create_map(F.lit("headers"), F.col("auth"), F.lit("httpHeaders"), F.lit("lost")))
    parts = {"arguments": arguments, "env": F.col("user_id"), "related": F.lit(None).cast("string")}
    related = {"login": (F.col("seq") % 2 == 0, {"arguments": F.col("arguments"), "env": F.col("user_id")})}
    return calls(spark, d).select("seq", fc.execute_record(parts, {"arguments": True, "related": True}, related, {"env": True}).alias("record"))


@query(f"with {CALLS} select seq, '{{\"argument.k\":\"' || k || '\",\"header.authorization\":\"' || auth || '\"}}' as text from calls")
def section_text(spark, d):
    return calls(spark, d).select("seq", fc.section_text(*_parts(), {"arguments": True, "headers": True}).alias("text"))


@query("select o_orderkey, 'Order' as class, o_orderkey::varchar as id, 'int' as id_kind, o_totalprice::varchar as price, case when regexp_matches(o_totalprice::varchar, '^[+-]?([0-9]*\\.[0-9]+|[0-9]+\\.[0-9]*)$') then 'float' else 'str' end as price_kind, case when regexp_matches('0' || (o_orderkey % 9), '^[0-9]+$') and not contains('homephone', 'phone') then 'int' else 'str' end as homephone_kind, 't' || o_custkey as authorization, case when o_orderkey % 2 = 0 then '1.5' end as difference from orders")
def parse_class_objects(spark, d):
    key = F.col("o_orderkey").cast("string")
    more = F.when(F.col("o_orderkey") % 2 == 0, " orderMoneyDifference=1.5").otherwise("")
    line = F.concat(F.lit("Saving Order(id=0, id="), key, F.lit(", price="), F.col("o_totalprice").cast("string"), F.lit(", homephone=0"), (F.col("o_orderkey") % 9).cast("string"), F.lit(') done authorization:"Bearer t'), F.col("o_custkey").cast("string"), F.lit('"'), more)
    o = F.get(fc.class_objects(line), F.lit(0))
    at = lambda k: F.element_at(o["fields"], F.lit(k))
    own = table(spark, d, "orders").select("o_orderkey", o["class"].alias("class"), *[at(k).alias(k) for k in ("id", "price", "homephone", "authorization")], at("orderMoneyDifference").alias("difference"))
    return own.select("o_orderkey", "class", "id", "price", "authorization", "difference", *[fc.field_kind(F.lit(k), F.col(k)).alias(f"{k}_kind") for k in ("id", "price", "homephone")])


@query("select page_id, lower(md5(url))[1:8] || '-' || repeat('0', 27) as id, case when page_id % 2 = 0 then 't' || page_id end as token from pages where page_id % 3 <> 0")
def parse_string_object(spark, d):
    own = table(spark, d, "pages")
    found = F.when(F.col("page_id") % 3 != 0, F.concat(F.substring(F.md5("url"), 1, 8), F.lit("-"), F.repeat(F.lit("0"), 27))).otherwise("none")
    line = F.concat(F.lit("for account "), found, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(' authorization:"Bearer t'), F.col("page_id").cast("string"), F.lit('"'))).otherwise(""))
    fields = fc.string_object(line, "accountId")
    return own.select("page_id", F.element_at(fields, F.lit("accountId")).alias("id"), F.element_at(fields, F.lit("authorization")).alias("token")).where(F.col("id").isNotNull())


@query("select o_orderkey, o_orderkey::varchar as id, case when o_orderkey % 3 = 0 then null else o_custkey::varchar end as customer, 'k' || o_custkey as authorization from orders")
def declared_arguments(spark, d):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    given = F.when(F.col("o_orderkey") % 3 == 0, key).otherwise(F.concat(key, F.lit(", "), customer))
    line = F.concat(F.lit("2024-05-02 17:34:56.705 INFO 1 --- [main] a.b.C: Entering in Method: save, Class: Orders, Arguments: ["), given, F.lit('], Request Headers: [authorization:"k'), customer, F.lit('"], Execution Time: 3 milliseconds, Return: x'))
    fields = fc.declared_arguments(line, "string authorization, int id, int customer")
    return table(spark, d, "orders").select("o_orderkey", *[F.element_at(fields, F.lit(n)).alias(n) for n in ("id", "customer", "authorization")])


@query("select o_orderkey, '2024-05-02 17:34:56.705' as time, 'save' as method, o_orderkey::varchar as arguments, (o_orderkey % 97)::varchar as millis, o_orderstatus as returned from orders where o_orderkey % 2 = 0")
def parse_log_line(spark, d):
    key = F.col("o_orderkey").cast("string")
    good = F.concat(F.lit("2024-05-02 17:34:56.705 INFO 1 --- [main] a.b.C: Entering in Method: save, Class: Orders, Arguments: ["), key, F.lit("], Request Headers: x, Execution Time: "), (F.col("o_orderkey") % 97).cast("string"), F.lit(" milliseconds, Return: "), F.col("o_orderstatus"))
    line = F.when(F.col("o_orderkey") % 2 == 0, good).otherwise(F.lit("another layout"))
    return table(spark, d, "orders").select("o_orderkey", fc.log_line(line).alias("l")).where(F.col("l").isNotNull()).select("o_orderkey", "l.time", "l.method", "l.arguments", "l.millis", "l.returned")


@query(f"with {CALLS} select distinct api from calls where api <> 'error' and k > 5")
def external_apis(spark, d):
    agent = F.when((F.col("api") != "error") & (F.col("k") > 5), "Mozilla/5.0 (X11)").otherwise("curl/8")
    return flow.external_apis(calls(spark, d).withColumn("agent", agent))


@query(f"with {CALLS} select seq, api from calls where seq < 1000")
def cap_log(spark, d):
    return flow.cap_log(calls(spark, d).select("seq", "api"), 1000)
