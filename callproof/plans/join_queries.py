"""Queries on joins of calls with rows and calls."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import detect, joins, keys, versions
from . import enrichment
from .adapters import CALLS, calls, changes, table
from .change_queries import VERSIONS
from .registry import query


@query("select o_orderkey, o_custkey, c_name, c_nationkey from orders left join customer on o_custkey = c_custkey and o_orderkey % 3 <> 0")
def fk_join(spark, d):
    orders = table(spark, d, "orders").withColumn("key", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    out = joins.fk_join(orders, table(spark, d, "customer"), "key", "c_custkey", "customer")
    return out.select("o_orderkey", "o_custkey", F.col("`customer@c_name`").alias("c_name"), F.col("`customer@c_nationkey`").alias("c_nationkey"))


@query("select 'customer' as \"table\", 'c_custkey' as \"column\", count(c_custkey) > 0 and count(c_custkey) = count(distinct c_custkey) as joinable from customer union all select 'orders', 'o_custkey', count(o_custkey) > 0 and count(o_custkey) = count(distinct o_custkey) from orders")
def joinable_keys(spark, d):
    return keys.joinable_keys({n: table(spark, d, n) for n in ("customer", "orders")}, [("customer", "c_custkey"), ("orders", "o_custkey")])


FLOWS = [("purchase", "click"), ("purchase", "view"), ("error", "purchase"), ("view", "view")]


def _flows(spark):
    return spark.createDataFrame(FLOWS, "api string, source_api string")


@query(f"""with {CALLS}, f as (select * from (values {', '.join(map(str, FLOWS))}) as t(api, source_api)),
l as (select c.seq, c.t, c.auth, f.api, f.source_api from calls c join f on c.api = f.api)
select seq, api, source_api, related_seq from (
  select l.seq, l.api, l.source_api, (select max(r.seq) from (select seq, t, auth from calls r where r.api = l.source_api and (r.t < l.t or r.t = l.t) order by r.seq desc limit 20) r where r.auth = l.auth and l.t - r.t <= 600) as related_seq from l)
where related_seq is not null""")
def asof_related_call(spark, d):
    return joins.asof_related_call(calls(spark, d), _flows(spark))


def _nearest_sql(before: bool) -> str:
    near = f"(select {'max' if before else 'min'}(a.seq) from calls a where a.api = 'click' and a.seq {'<' if before else '>'} b.seq)"
    return f"with {CALLS}, m as (select b.seq, b.t, {near} as related from calls b where b.api = 'purchase') select m.seq, case when abs(m.t - a.t) < 600 then m.related end as related_seq from m left join calls a on a.seq = m.related"


@query(_nearest_sql(True) + " union all " + f"select -1 - seq, related_seq from ({_nearest_sql(False)})")
def nearest_event(spark, d):
    own = calls(spark, d)
    after = joins.nearest_event(own, "click", "purchase", direction="after")
    return joins.nearest_event(own, "click", "purchase").unionByName(after.withColumn("seq", -1 - F.col("seq")))


@query(f"select related_seq as a_seq, seq as b_seq from ({_nearest_sql(True)}) where related_seq is not null")
def event_pairs(spark, d):
    return joins.event_pairs(calls(spark, d), "click", "purchase")


MERGE = """m as (select seq, t, auth, api, k % 3 as args, (select count(*) from calls c where c.api = 'signup' and c.seq <= calls.seq) as sid from calls),
near as (select a.seq, a.t, a.auth, a.args, (select max(b.seq) from m b where b.api = 'view' and b.sid = a.sid and b.seq < a.seq) as p, (select min(b.seq) from m b where b.api = 'view' and b.sid = a.sid and b.seq > a.seq) as n from m a where a.api = 'click'),
g as (select near.*, p.t as pt, n.t as nt, p.seq is not null and near.t - p.t <= 900 and p.auth = near.auth and p.args = near.args as p_ok, n.seq is not null and n.t - near.t <= 900 and n.auth = near.auth and n.args = near.args as n_ok from near left join m p on p.seq = near.p left join m n on n.seq = near.n),
f as (select seq, case when coalesce(t - pt, 1e300) < coalesce(nt - t, 1e300) then case when p_ok then p when n_ok then n end else case when n_ok then n when p_ok then p end end as target from g)"""


def _shards(spark, d):
    own = joins.sessions(calls(spark, d), "signup").withColumn("args", (F.col("k") % 3).cast("string"))
    return own.withColumn("data", F.array("k"))


@query(f"with {CALLS}, {MERGE}, g2 as (select target as seq, min(seq) as source from f where target is not null group by 1) select c.seq, case when s.k is null then c.k::varchar else c.k || ',' || s.k end as data from calls c left join g2 on c.seq = g2.seq left join calls s on s.seq = g2.source where c.api = 'view'")
def merge_sharded_calls(spark, d):
    out = joins.merge_sharded_calls(_shards(spark, d), "click", "view", tolerance=900)
    return out.where(F.col("api") == "view").select("seq", F.array_join("data", ",").alias("data"))


@query(f"with {CALLS} select seq, api, q as query_id, 'select ' || q as query, '{{\"seq\":' || seq || ',\"api\":\"' || api || '\",\"k\":' || k || '}}' as context from calls join (values ('click', 'one'), ('click', 'two'), ('view', 'one')) as t(a, q) on api = a")
def template_requests(spark, d):
    templates = spark.createDataFrame([("click", {"one": "select one", "two": "select two"}), ("view", {"one": "select one"})], "api string, queries map<string,string>")
    return joins.template_requests(calls(spark, d).select("seq", "api", "k"), templates)


PAIR_TESTS = (("general", "b.k > a.k + a.user_id % 7"), ("<", "a.k < b.k"), ("<=", "a.k <= b.k"), (">", "a.k > b.k"), (">=", "a.k >= b.k"), ("=", "a.k = b.k"), ("!=", "a.k <> b.k"))


def _any_pair_sql() -> str:
    right = "(select user_id, case when seq % 3 > 0 then k end as k from calls where api = 'error') b"
    parts = [f"select '{name}' as test, user_id, k, exists (select 1 from {right} where b.user_id = a.user_id and {test}) as holds from (select user_id, k % 50 as k from calls where api = 'click') a" for name, test in PAIR_TESTS]
    return f"with {CALLS}, h as ({' union all '.join(parts)}) select test, user_id, k, holds, count(*) as n from h group by all"


@query(_any_pair_sql())
def any_pair_holds(spark, d):
    # left rows repeat, and some right values are null
    own = calls(spark, d)
    left = own.where("api = 'click'").select("user_id", (F.col("k") % 50).alias("k"))
    right = own.where("api = 'error'").select("user_id", F.when(F.col("seq") % 3 > 0, F.col("k")).alias("k"))
    tests = [(name, F.col("r.k") > F.col("l.k") + F.col("l.user_id") % 7 if name == "general" else ("k", name, "k")) for name, _ in PAIR_TESTS]
    found = [joins.any_pair_holds(left, right, ["user_id"], test).withColumn("test", F.lit(name)) for name, test in tests]
    return reduce(lambda a, b: a.unionByName(b), found).groupBy("test", "user_id", "k", "holds").agg(F.count("*").alias("n"))


WINDOWS = "w as (select s.seq as window_id, s.user_id % 4 as grp, s.t as start, (select min(e.t) from calls e where e.api = 'error' and e.user_id % 4 = s.user_id % 4 and e.seq > s.seq) as \"end\" from calls s where s.api = 'signup'), windows as (select * from w where \"end\" is not null)"


def _windows(spark, d):
    kind = F.when(F.col("api") == "signup", "start").when(F.col("api") == "error", "end")
    marks = calls(spark, d).select("seq", "t", (F.col("user_id") % 4).alias("grp"), kind.alias("kind")).where(F.col("kind").isNotNull())
    return detect.sequence_windows(marks)


@query(f"with {CALLS}, w as (select seq as window_id, t - seq % 5 * 40000 as start, t + seq % 7 * 90000000 - 1 as \"end\" from calls where seq % 100 = 7) select window_id, count(*) as n_calls, min(c.seq) as first_seq from w join calls c on c.t between w.start and w.\"end\" group by 1")
def long_windows(spark, d):
    # windows of a day to many years, and some that end before they start
    own = calls(spark, d)
    windows = own.where("seq % 100 = 7").select(F.col("seq").alias("window_id"), (F.col("t") - F.col("seq") % 5 * 40000).alias("start"), (F.col("t") + F.col("seq") % 7 * 90000000 - 1).alias("end"))
    return detect.window_totals(own.select("seq", "t"), windows)


@query(f"with {CALLS}, {WINDOWS} select window_id, count(*) as n_calls, min(seq) as first_seq from windows join calls on t between start and \"end\" and user_id % 4 = grp group by 1")
def window_calls(spark, d):
    own = calls(spark, d).withColumn("grp", F.col("user_id") % 4)
    out = detect.window_calls(own, _windows(spark, d), on=("grp",))
    return out.groupBy("window_id").agg(F.count("*").alias("n_calls"), F.min("seq").alias("first_seq"))


@query(f"with {CALLS}, m as (select api, (seq - seq % 3)::varchar as id, seq, t from calls where seq % 3 < 2), a as (select id, max_by(t, seq) filter (where api <> 'error') as start, max_by(t, seq) filter (where api = 'error') as \"end\" from m group by 1) select id as window_id, round(start, 3) as start, round(\"end\", 3) as \"end\" from a where start is not null and \"end\" is not null")
def marker_windows(spark, d):
    own = calls(spark, d).where(F.col("seq") % 3 < 2)
    mark = F.when(F.col("api") == "error", detect.END).otherwise(detect.START)
    flows = own.select("seq", "t", F.concat(mark, (F.col("seq") - F.col("seq") % 3).cast("string")).alias("path"))
    return detect.marker_windows(flows).select("window_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then null else c_name end as name, case when o_orderkey % 2 = 0 then null else c_nationkey end as nation, o_orderkey % 2 = 0 as missed from orders left join customer on o_custkey = c_custkey")
def renest(spark, d):
    orders = table(spark, d, "orders").withColumn("key", F.when(F.col("o_orderkey") % 2 != 0, F.col("o_custkey")))
    out = joins.renest(joins.fk_join(orders, table(spark, d, "customer"), "key", "c_custkey", "customer"), ["customer"], ["o_orderkey"])
    return out.select("o_orderkey", F.col("db_info.customer.c_name").alias("name"), F.col("db_info.customer.c_nationkey").alias("nation"), F.col("db_info.customer").isNull().alias("missed"))


def _enrich_sql() -> str:
    near = lambda api: f"(select max(r.seq) from (select seq, t, auth from calls r where r.api = '{api}' and r.t <= o.t order by r.seq desc limit 20) r where r.auth = o.auth and o.t - r.t <= 600)"
    return f"""with {VERSIONS}, own as (select * from calls where api = 'purchase'),
  timed as (select o.*, (select max(last_ts_s) from versions v where v.pk = o.user_id) as last_ts, (select coalesce(max(ver) filter (where ts_s < floor(o.t - 1) and ver > 0), 0) from versions v where v.pk = o.user_id) as ver from own o)
select o.seq, o.user_id, c.c_name as name, case when c.c_custkey is not null and o.last_ts is not null and o.t <= o.last_ts then (select max(row) from versions v where v.pk = o.user_id and v.ver = o.ver) else c.c_acctbal end as balance,
  c.c_nationkey as nation, n.n_name as nation_name, {near('click')} as click_seq, {near('view')} as view_seq
from timed o left join customer c on o.user_id = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey"""


@query(_enrich_sql())
def enrich_calls(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "nation")}
    own = calls(spark, d)
    plan = [("user_id", "customer", "c_custkey"), ("customer@c_nationkey", "nation", "n_nationkey"), ("no_such_column", "nation", "n_nationkey")]
    # a customer's balance is what the change log says as of the call
    log = versions.row_versions(changes(spark, d).withColumn("pk", F.col("pk").cast("string")), keys=("pk",))
    out = enrichment.enrich_calls(own, tables, plan, _flows(spark), api="purchase", changes={"customer": (log, {"c_acctbal": F.col("row")})})
    at = lambda p: F.col(f"db_info.{p}")
    return out.select("seq", "user_id", at("customer.c_name").alias("name"), at("customer.c_acctbal").alias("balance"), at("customer.c_nationkey").alias("nation"), at("`nation#0`.n_name").alias("nation_name"), F.col("related.click").alias("click_seq"), F.col("related.view").alias("view_seq"))
