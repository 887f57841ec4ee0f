"""Queries on rules and detection."""

from pyspark.sql import functions as F

from ..operators import detect, joins, rules
from .adapters import CALLS, calls, table
from .join_queries import WINDOWS, _nearest_sql, _windows
from .registry import query

LOW, HIGH = 1.0, 60.0


def _rules():
    return [
        rules.Rule("value_range", "purchase", rules.in_range(F.col("value"), LOW, HIGH), "value out of range"),
        rules.Rule("k_small", "purchase", F.col("k") < 1000, "k is large"),
        rules.Rule("auth_known", "click", F.when(F.col("k") > 10, rules.status_in(F.col("auth"), ["0", "1", "2", "3", "4", "5", "6"])), "unknown auth"),
        rules.Rule("always", "view", None),
        rules.Rule("share", "view", F.lit(100) / (F.col("k") % 5) > 30, "share too small"),  # an error where k % 5 is 0
        rules.Rule("number", "click", F.when(F.col("k") % 2 == 0, "x").otherwise(F.col("auth")).cast("int") >= 0, "no number"),  # an error where it is x
        rules.Rule("place", "signup", F.element_at(F.array("k"), (F.col("k") % 2).cast("int")) < 50, "large"),  # place 0 is an error
        rules.Rule("keys", "signup", F.map_from_arrays(F.array(F.col("k") % 3, F.lit(1)), F.array("k", "k"))[1] < 50, "large"),  # an error where key 1 repeats
        rules.Rule("said", "signup", F.when(F.col("k") % 4 == 0, F.raise_error(F.concat(F.lit("no "), F.col("auth")))).otherwise(F.col("k") < 50), "large"),
        rules.Rule("format", "signup", F.expr("to_number(case when k % 2 = 0 then '12' else 'x1' end, '99') > 0"), "no number"),
    ]


CHECKS = f"""{CALLS}, checks as (
  select seq, api, 'value_range' as rule_id, value between {LOW} and {HIGH} as passed, 'value out of range' as m from calls where api = 'purchase'
  union all select seq, api, 'k_small', k < 1000, 'k is large' from calls where api = 'purchase'
  union all select seq, api, 'auth_known', k > 10 and auth <> '7', 'unknown auth' from calls where api = 'click'
  union all select seq, api, 'always', true, '' from calls where api = 'view'
  union all select seq, api, 'share', k % 5 <> 0 and 100.0 / nullif(k % 5, 0) > 30, case when k % 5 = 0 then '[DIVIDE_BY_ZERO] `/`(100, `%`(k, 5))' else 'share too small' end from calls where api = 'view'
  union all select seq, api, 'number', k % 2 <> 0 and cast(auth as int) >= 0, case when k % 2 = 0 then '[CAST_INVALID_INPUT] CAST(CASE WHEN `=`(`%`(k, 2), 0) THEN ''x'' ELSE auth END AS INT)' else 'no number' end from calls where api = 'click'
  union all select seq, api, 'place', k % 2 = 1 and k < 50, case when k % 2 = 0 then '[INVALID_INDEX_OF_ZERO] element_at(array(k), CAST(`%`(k, 2) AS INT))' else 'large' end from calls where api = 'signup'
  union all select seq, api, 'keys', k % 3 <> 1 and k < 50, case when k % 3 = 1 then '[DUPLICATED_MAP_KEY]' else 'large' end from calls where api = 'signup'
  union all select seq, api, 'said', k % 4 <> 0 and k < 50, case when k % 4 = 0 then '[USER_RAISED_EXCEPTION] no ' || auth else 'large' end from calls where api = 'signup'
  union all select seq, api, 'format', k % 2 = 0, '[INVALID_FORMAT] to_number(CASE WHEN ((k % 2) = 0) THEN ''12'' ELSE ''x1'' END, ''99'')' from calls where api = 'signup'),
checked as (select seq, api, rule_id, passed, case when not passed then m end as message from checks)"""


def _checks(spark, d):
    return rules.check_rules(calls(spark, d), _rules())


@query(f"with {CHECKS} select * from checked")
def check_rules(spark, d):
    return _checks(spark, d)


@query(f"with {CHECKS} select rule_id, count(*) as n_calls from checked group by 1 having count(*) filter (where not passed) = 0")
def gate_rules(spark, d):
    return rules.gate_rules(_checks(spark, d))


@query(f"with p as ({_nearest_sql(True)}) select b.event_id as seq, b.event_type as api, 'not_less' as rule_id, a.value is not null and b.value >= a.value as passed, case when a.value is null then 'Cannot find related event' when b.value < a.value then 'less than before' end as message from p join events b on b.event_id = p.seq left join events a on a.event_id = p.related_seq")
def check_pair_rules(spark, d):
    own = calls(spark, d)
    pairs = joins.nearest_event(own, "click", "purchase")
    return rules.check_pair_rules(own, pairs, [rules.Rule("not_less", "purchase", F.col("b.value") >= F.col("a.value"), "less than before")])


@query(f"with {CALLS} select seq, k > 50 as passed from calls")
def check_python_rules(spark, d):
    own = calls(spark, d).select("seq", "api", "k")
    names = ("click", "error", "purchase", "signup", "view")
    return rules.check_python_rules(own, {f"large_{n}": (n, _large) for n in names}).select("seq", "passed")


def _large(call: dict) -> bool:
    if call["k"] == 50:
        raise ValueError("on the edge")
    return call["k"] > 50


@query("select page_id, regexp_matches(url, '^https?://[^\\s/]+(/\\S*)?$') as is_url, regexp_matches(url, '^[0-9]+$') as is_digits, true as id_digits from pages")
def rule_format(spark, d):
    return table(spark, d, "pages").select("page_id", rules.has_format(F.col("url"), "url").alias("is_url"), rules.has_format(F.col("url"), "digits").alias("is_digits"), rules.has_format(F.col("page_id").cast("string"), "digits").alias("id_digits"))


@query("select o_orderkey, o_orderkey % 7 <> 0 as clean from orders")
def rule_injection(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("1; delete from users")).otherwise(F.concat(F.lit("selected "), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", rules.no_injection(text).alias("clean"))


@query("select l_returnflag, count(*) filter (where l_discount between 0.02 and 0.08) as n_passed, count(*) as n from lineitem group by 1")
def rule_range(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(rules.in_range(F.col("l_discount"), 0.02, 0.08)).alias("n_passed"), F.count("*").alias("n"))


@query("select o_orderkey, o_orderstatus in ('F', 'O') as passed from orders")
def rule_status(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.status_in(F.col("o_orderstatus"), ["F", "O"]).alias("passed"))


@query("select c_custkey, n_nationkey is not distinct from c_nationkey as passed from customer left join nation on c_nationkey = n_nationkey and c_custkey % 2 = 0")
def rule_equal(spark, d):
    c = table(spark, d, "customer").withColumn("key", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")))
    out = joins.fk_join(c, table(spark, d, "nation"), "key", "n_nationkey", "nation")
    return out.select("c_custkey", rules.equal_fields(F.col("c_nationkey"), F.col("`nation@n_nationkey`")).alias("passed"))


@query("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_partkey % 10 = o_custkey % 10) as passed from orders")
def rule_member(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("items"))
    o = table(spark, d, "orders")
    return o.join(parts, o["o_orderkey"] == parts["l_orderkey"], "left").select("o_orderkey", rules.member_of(F.col("o_custkey") % 10, F.col("items")).alias("passed"))


MINED = "select o_orderstatus as api, o_orderkey % 2 as parity, o_orderkey, o_custkey, o_orderkey + 0 as same from orders"


def _mined(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("api"), (F.col("o_orderkey") % 2).alias("parity"), "o_orderkey", "o_custkey", (F.col("o_orderkey") + 0).alias("same"))


@query(f"with m as ({MINED}), v as (select api, 'parity' as c, parity::varchar as v from m union all select api, 'o_orderkey', o_orderkey::varchar from m) select api, c as \"column\", string_agg(distinct v, ',' order by v) as \"values\" from v group by 1, 2 having count(distinct v) <= 3")
def mine_constants(spark, d):
    return rules.mine_constants(_mined(spark, d), ["parity", "o_orderkey"])


@query(f"with m as ({MINED}), p as (select api, 'o_orderkey' as a, 'o_custkey' as b, bool_and(o_orderkey = o_custkey) as same from m group by 1 union all select api, 'o_orderkey', 'same', bool_and(o_orderkey = same) from m group by 1 union all select api, 'o_custkey', 'same', bool_and(o_custkey = same) from m group by 1) select api, a, b from p where same")
def mine_equalities(spark, d):
    return rules.mine_equalities(_mined(spark, d), ["o_orderkey", "o_custkey", "same"])


@query(f"with {CHECKS}, c as (select rule_id, count(*) as n_calls, count(*) filter (where not passed) as n_failed, coalesce(list_sort(list(distinct message) filter (where not passed))[:3], []) as reasons from checked group by 1) select rule_id, n_calls, n_failed, array_to_string(reasons, '|') as reasons from c")
def failure_reasons(spark, d):
    return rules.failure_reasons(_checks(spark, d)).withColumn("reasons", F.array_join("reasons", "|"))


#: Marks of attacks: an interval in either case, a file for some, a name for all.
ATTACKED = f"""{CHECKS}, {WINDOWS}, inside as (select c.*, w.window_id, c.k % 10 = 0 as is_attack, case when c.k % 10 = 0 then case when c.k % 20 = 0 then 'file' || c.k else 'attack' || c.k end end as att_name from calls c join windows w on c.t between w.start and w."end" and c.user_id % 4 = w.grp),
found as (select i.window_id, i.seq, i.api, k.rule_id, i.att_name, i.is_attack, not k.passed as detected, k.message from inside i join checked k on k.seq = i.seq where not k.passed or i.is_attack
  union all select window_id, seq, api, null, att_name, true, false, null from inside where is_attack and api not in (select api from checked))"""


def _marked(df):
    """Headers of attacks for every tenth k; other calls have a name that marks nothing."""
    k = F.col("k").cast("string")
    entry = lambda low, high, v: F.struct(F.when(F.col("k") % 4 == 0, low).otherwise(high).alias("key"), v.alias("value"))
    name = entry("x-att-name", "X-Att-Name", F.concat(F.lit("attack"), k))
    own = F.array(name, entry("x-att-int", "X-Att-Int", k), entry("x-att-idx", "X-Att-Idx", k))
    file = F.array(entry("x-att-file", "X-Att-File", F.concat(F.lit("file"), k)))
    some = F.when(F.col("k") % 20 == 0, F.concat(own, file)).when(F.col("k") % 10 == 0, own).otherwise(F.array(name))
    return df.withColumn("headers", F.map_from_entries(some))


def _found(spark, d):
    own = calls(spark, d).withColumn("grp", F.col("user_id") % 4)
    return detect.violations(_marked(detect.window_calls(own, _windows(spark, d), on=("grp",))), _rules())


@query(f"with {ATTACKED} select * from found")
def violations(spark, d):
    return _found(spark, d)


@query(f"with {ATTACKED}, hits as (select window_id, window_id in (select window_id from found where detected) as detected from windows) select count(*) filter (where detected) as n_detected, count(*) as n_windows, round(count(*) filter (where detected) / count(*), 9) as recall from hits")
def detection_recall(spark, d):
    return detect.detection_recall(_found(spark, d), _windows(spark, d)).withColumn("recall", F.round("recall", 9))


@query("select count(*) filter (where f and toxic = 1) as tp, count(*) filter (where f and toxic = 0) as fp, count(*) filter (where not f and toxic = 0) as tn, count(*) filter (where not f and toxic = 1) as fn from (select toxic, regexp_matches(lower(text), '(idiot|stupid|clown)') as f from documents join labels using (doc_id))")
def confusion(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return detect.confusion(both, F.lower("text").rlike("idiot|stupid|clown"), F.col("toxic") == 1)


@query(f"with {CALLS}, m as (select seq // 10 as window_id, case when api <> 'view' then 'n' || api end as name, case when api <> 'view' then k // 50 end as idx, case when k % 2 = 0 then 'low' || k // 90 when k % 2 = 1 and k % 3 = 0 then 'low' || k // 90 end as interval, case when k = 13 then 'attack_list_wrong_food.py' else 'f' || k end as file from calls) select window_id, count(distinct name) = 1 and count(distinct idx) = 1 and count(distinct interval) = 1 and not bool_or(file = 'attack_list_wrong_food.py') as valid, count(*) as n_calls from m group by 1")
def valid_windows(spark, d):
    # headers in both cases: a name or interval in one case and the same in the other is one
    entry = lambda low, high, v, some: F.when(some, F.struct(F.when(F.col("k") % 2 == 0, low).otherwise(high).alias("key"), v.cast("string").alias("value")))
    named = F.col("api") != "view"
    entries = F.array(
        entry("x-att-name", "X-Att-Name", F.concat(F.lit("n"), "api"), named), entry("x-att-idx", "X-Att-Idx", F.floor(F.col("k") / 50), named),
        entry("x-att-int", "X-Att-Int", F.concat(F.lit("low"), F.floor(F.col("k") / 90).cast("string")), (F.col("k") % 2 == 0) | (F.col("k") % 3 == 0)),
        entry("x-att-file", "X-Att-File", F.when(F.col("k") == 13, "attack_list_wrong_food.py").otherwise(F.concat(F.lit("f"), F.col("k").cast("string"))), F.lit(True)),
    )
    own = calls(spark, d).select(F.floor(F.col("seq") / 10).alias("window_id"), F.map_from_entries(F.array_compact(entries)).alias("headers"))
    return detect.valid_windows(own)


@query(f"with {CALLS} select count(*) as n_rows, count(*) filter (where k = 7 or (k > 50) <> (value > 20)) as n_mismatch, coalesce(bool_or(k = 7), false) as failed from calls")
def branch_mismatch(spark, d):
    return rules.branch_mismatch(calls(spark, d), F.when(F.col("k") != 7, F.col("k") > 50), F.col("value") > 20)
