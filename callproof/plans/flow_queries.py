"""Queries on sessions and dependency scores."""

from pyspark.sql import functions as F

from ..operators import flow, joins
from .adapters import CALLS, calls
from .registry import query

SESSIONS = f"{CALLS}, s as (select *, (select count(*) from calls c where c.api = 'signup' and c.seq <= calls.seq) as sid from calls)"


def _sessions(spark, d):
    return joins.sessions(calls(spark, d), "signup")


@query(f"with {CALLS}, first as (select api, min(seq) as f from calls group by 1) select seq, api, (select count(*) from first b where b.f < a.f) as code from calls join first a using (api)")
def encode_events(spark, d):
    return flow.encode_events(calls(spark, d).select("seq", "api")).select("seq", "api", "code")


@query(f"with {SESSIONS}, n as (select sid, count(*) as n_calls from s group by 1) select * from n union all select 0, 0 where not exists (select 1 from n where sid = 0)")
def session_lengths(spark, d):
    return flow.session_lengths(_sessions(spark, d))


def _lookback_sql(cte: str = "") -> str:
    steps = " union all ".join(f"select a.api, b.api as source_api, {0.5 ** (k - 1)} as w from o a join o b on a.sid = b.sid and b.n = a.n - {k}" for k in (1, 2, 3))
    return f"with {SESSIONS}, o as (select *, row_number() over (partition by sid order by seq) as n from s), scores as (select api, source_api, sum(w) / (select count(*) from calls c where c.api = x.api) as score from ({steps}) x group by 1, 2){cte}"


@query(_lookback_sql() + " select api, source_api, round(score, 9) as score from scores")
def lookback_score(spark, d):
    return flow.lookback_score(_sessions(spark, d)).withColumn("score", F.round("score", 9))


RANKED = ", ranked as (select api, source_api, round(score, 9) as score, row_number() over (partition by api order by round(score, 9) desc, source_api desc) as rank from scores)"


def _ranked(spark, d):
    return flow.rank_sources(flow.lookback_score(_sessions(spark, d)).withColumn("score", F.round("score", 9)))


@query(_lookback_sql(RANKED) + " select api, source_api, rank from ranked")
def rank_sources(spark, d):
    return _ranked(spark, d).select("api", "source_api", F.col("rank").cast("long").alias("rank"))


@query(_lookback_sql(RANKED) + " select api, source_api, row_number() over (partition by api order by rank) as place from ranked where source_api <> 'error' and score >= 0.1 qualify place <= 2")
def candidate_flows(spark, d):
    external = calls(spark, d).select("api").distinct().where("api <> 'error'")
    return flow.candidate_flows(_ranked(spark, d), external, most=2).select("api", "source_api", F.col("place").cast("long").alias("place"))


@query(f"""with {SESSIONS}, n as (select api as i, lead(api) over (partition by sid order by seq) as j from s), c as (select i, j, count(*) as p from n where j is not null group by 1, 2),
trans as (select i, j, p / sum(p) over (partition by i) as p from c), e as (select api as i, api as j, cast(1 as double) as p from calls group by 1),
back as (select j as i, i as j, p / sum(p) over (partition by j) as p from trans),
r1 as (select i as api, j as s, p from back), r2 as (select r.api, b.j as s, sum(r.p * b.p) as p from r1 r join back b on r.s = b.i group by 1, 2), r3 as (select r.api, b.j as s, sum(r.p * b.p) as p from r2 r join back b on r.s = b.i group by 1, 2)
select api, s as source_api, round(sum(x), 9) as score from (select api, s, p as x from r1 union all select api, s, p * 0.5 from r2 union all select api, s, p * 0.25 from r3) group by 1, 2""")
def backward_score(spark, d):
    trans = flow.transitions(_sessions(spark, d))
    same = calls(spark, d).select("api").distinct().select(F.col("api").alias("i"), F.col("api").alias("j"), F.lit(1.0).alias("p"))
    return flow.backward_score(trans, same).withColumn("score", F.round("score", 9))


@query(f"with {CALLS} select seq, api from (select *, row_number() over (partition by api order by md5('7:' || seq), seq) as r from calls) where r <= 20")
def sample_calls(spark, d):
    return flow.sample_calls(calls(spark, d).select("seq", "api"), 20, seed=7)
