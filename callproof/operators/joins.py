"""Joins of calls with rows and with other calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_S = 600
MOST_BETWEEN = 20


def fk_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str) -> DataFrame:
    """Left join on a key; right columns get ``prefix@``.  Null and unmatched keys give nulls, a repeated right key an error.

    Null keys take no part in the shuffle; how the rest is joined is left to Spark, which knows the sizes.
    """
    if left.schema[left_key].dataType.typeName() != right.schema[right_key].dataType.typeName():
        raise TypeError(f"{left_key} and {right_key} are of different kinds")
    n, d = right.agg(F.count(right_key), F.count_distinct(right_key)).first()
    if n != d:
        raise ValueError(f"{right_key} repeats")
    return fk_join_unchecked(left, right, left_key, right_key, prefix)


def fk_join_unchecked(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str) -> DataFrame:
    """The same where the right key is known to be unique."""
    named = right.where(F.col(f"`{right_key}`").isNotNull()).select(*[F.col(f"`{c}`").alias(f"{prefix}@{c}") for c in right.columns])
    return left.join(named, F.col(f"`{left_key}`") == F.col(f"`{prefix}@{right_key}`"), "left")


def asof_related_call(calls: DataFrame, flows: DataFrame, *, tolerance: float = TOLERANCE_S, most_between: int = MOST_BETWEEN, window: str | None = None) -> DataFrame:
    """The last earlier (or simultaneous) call of a source API by the same ``auth``: ``seq, source_api, related_seq``.

    At most ``tolerance`` seconds back, and within the last ``most_between`` calls of the source API, whoever made them.
    ``calls(seq, t, api, auth)``; ``flows(api, source_api)`` is the catalogue of API pairs and small.  Times are cut into
    stretches of ``tolerance``; a possible match lies in a call's stretch or the one before, so windows over a stretch
    see enough, and a busy API is many windows.  Both windows share one shuffle.
    """
    own = [window] if window else []
    base = calls.select("seq", "t", "api", "auth", *own, F.floor(F.col("t") / tolerance).alias("_b"))
    pairs = F.broadcast(flows.select(F.col("api").alias("_to"), F.col("source_api")).distinct())  # API pairs
    left = base.join(pairs, base["api"] == F.col("_to")).select("seq", "t", "auth", *own, "_b", F.col("_to"), "source_api", F.lit(1).alias("_left"))
    right = base.join(pairs, base["api"] == F.col("source_api")).select("seq", "t", "auth", *own, F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"), "_to", "source_api", F.lit(0).alias("_left"))
    group = [*own, "_to", "source_api", "_b"]
    order = Window.partitionBy(*group).orderBy("t", "_left", "seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = left.unionByName(right).withColumn("_n", F.sum(1 - F.col("_left")).over(order))
    # with the key of the first window in front Spark need not deal the rows anew
    mine = Window.partitionBy(*group, "auth").orderBy("t", "_left", "seq").rowsBetween(Window.unboundedPreceding, 0)
    met = counted.withColumn("_m", F.last(F.when(F.col("_left") == 0, F.struct("seq", "t", "_n")), ignorenulls=True).over(mine)).where("_left = 1")
    good = F.col("_m").isNotNull() & (F.col("_n") - F.col("_m._n") < most_between) & (F.col("t") - F.col("_m.t") <= tolerance)
    return met.where(good).select("seq", F.col("_to").alias("api"), "source_api", F.col("_m.seq").alias("related_seq"))


#: Fine stretches that a stretch of the tolerance is made of.
FINE = 60_000


def nearest_event(calls: DataFrame, api_a: str | None, api_b: str, *, direction: str = "before", tolerance: float = TOLERANCE_S) -> DataFrame:
    """For each call of ``api_b`` the nearest call of ``api_a`` (of any API where None) before or after, less than ``tolerance`` away.

    ``seq, related_seq`` (null where there is none).  Calls meet in windows on fine stretches of time (10 ms at ten minutes), so a busy
    second is many; what comes before a stretch is carried over from the last call of each earlier one, through windows on stretches
    of the tolerance that hold a row for each fine stretch.
    """
    sign, fine = 1 if direction == "before" else -1, tolerance / FINE
    place = lambda c, n: F.floor(c / F.lit(n)).cast("long")
    base = calls.select("seq", "t", "api", (F.col("t") * sign).alias("_t"), (F.col("seq") * sign).alias("_s"))
    base = base.withColumn("_f", place(F.col("_t"), fine))
    # rows of a call itself must not be its match: sides are ordered so that it comes later than its own lookup
    left = base.where(F.col("api") == api_b).withColumn("_side", F.lit(0))
    right = (base.where(F.col("api") == api_a) if api_a else base).withColumn("_side", F.lit(1))
    both = left.unionByName(right)
    match = F.when(F.col("_side") == 1, F.struct("seq", "t"))
    within = F.last(match, ignorenulls=True).over(Window.partitionBy("_f").orderBy("_t", "_s", "_side").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_m", within).where("_side = 0")
    ends = right.groupBy("_f").agg(F.max_by(F.struct("seq", "t"), F.struct("_t", "_s")).alias("_end")).unionByName(left.select("_f").distinct(), allowMissingColumns=True)
    ends = ends.groupBy("_f").agg(F.first("_end", ignorenulls=True).alias("_end"))
    coarse = place(F.col("_f"), FINE)
    spread = ends.withColumn("_c", F.explode(F.array(coarse, coarse + 1)))
    past = Window.partitionBy("_c").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.withColumn("_before", F.last("_end", ignorenulls=True).over(past)).where(F.col("_c") == coarse).select("_f", "_before")
    known = met.join(before, "_f", "left").withColumn("_m", F.coalesce("_m", "_before"))
    good = F.col("_m").isNotNull() & (F.abs(F.col("t") - F.col("_m.t")) < tolerance)
    return known.select("seq", F.when(good, F.col("_m.seq")).alias("related_seq"))


def event_pairs(calls: DataFrame, api_a: str, api_b: str, *, sample: int | None = None, seed: int = 0, tolerance: float = TOLERANCE_S) -> DataFrame:
    """(earlier A, later B) pairs, unmatched B dropped; of a sample, those that hash lowest."""
    pairs = nearest_event(calls, api_a, api_b, tolerance=tolerance).where(F.col("related_seq").isNotNull()).select(F.col("related_seq").alias("a_seq"), F.col("seq").alias("b_seq"))
    return pairs if sample is None else pairs.orderBy(F.xxhash64(F.lit(seed), "a_seq", "b_seq"), "b_seq").limit(sample)


def sessions(calls: DataFrame, session_api: str, *, bucket_s: int = 3_600) -> DataFrame:
    """Adds ``sid``: how many session starts there were up to each call, over the whole log.

    A count within stretches of time, and the sum of those before: only one row per stretch meets in one task.
    """
    day = F.floor(F.col("t") / bucket_s)
    own = calls.withColumn("_day", day).withColumn("_start", (F.col("api") == session_api).cast("long"))
    days = own.groupBy("_day").agg(F.sum("_start").alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_day", "_before")
    within = F.sum("_start").over(Window.partitionBy("_day").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return own.join(before, "_day").withColumn("sid", F.col("_before") + within).drop("_day", "_start", "_before")


def merge_targets(calls: DataFrame, api1: str, api2: str, *, tolerance: float = 60) -> DataFrame:
    """Which call of ``api2`` each call of ``api1`` gives its list to: ``source_seq, target_seq``.

    ``calls(seq, t, sid, api, auth, args)``: the nearer of the previous and the next call of ``api2`` in the session (a
    tie goes to the next) that is near enough, of equal auth and arguments; else the other one.  A target takes one.
    Times are cut into stretches of the tolerance, and a call of ``api2`` is put into its own and both next to it: what
    is further away cannot be near enough, so a long session is many windows.
    """
    # the next one is the last before, seen from the end: a frame that only grows
    order = Window.partitionBy("sid", "_b").orderBy("t", "seq")
    back = Window.partitionBy("sid", "_b").orderBy(F.desc("t"), F.desc("seq"))
    it = F.when(F.col("api") == api2, F.struct("seq", "t", "auth", "args"))
    b = F.floor(F.col("t") / max(tolerance, 1))
    own = calls.where(F.col("api").isin(api1, api2)).select("sid", "seq", "t", "api", "auth", "args", F.explode(F.when(F.col("api") == api2, F.array(b - 1, b, b + 1)).otherwise(F.array(b))).alias("_b"))
    seen = lambda w: F.last(it, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = own.withColumns({"_p": seen(order), "_n": seen(back)}).where(F.col("api") == api1)

    def fits(c: str) -> Column:
        return F.coalesce((F.abs(F.col("t") - F.col(f"{c}.t")) <= tolerance) & F.col("auth").eqNullSafe(F.col(f"{c}.auth")) & F.col("args").eqNullSafe(F.col(f"{c}.args")) & F.col(c).isNotNull(), F.lit(False))

    gap = lambda c: F.coalesce(F.abs(F.col("t") - F.col(f"{c}.t")), F.lit(float("inf")))
    previous_first = gap("_p") < gap("_n")
    first = F.when(previous_first, F.when(fits("_p"), F.col("_p.seq"))).otherwise(F.when(fits("_n"), F.col("_n.seq")))
    second = F.when(previous_first, F.when(fits("_n"), F.col("_n.seq"))).otherwise(F.when(fits("_p"), F.col("_p.seq")))
    found = near.select(F.col("seq").alias("source_seq"), F.coalesce(first, second).alias("target_seq")).where(F.col("target_seq").isNotNull())
    return found.groupBy("target_seq").agg(F.min("source_seq").alias("source_seq"))


def merge_sharded_calls(calls: DataFrame, api1: str, api2: str, *, tolerance: float = 60) -> DataFrame:
    """``calls(..., data array)`` with the lists of both APIs appended to each other's nearest call, both ways from the original."""
    gives = calls.select(F.col("seq").alias("source_seq"), F.col("data").alias("_more"))
    targets = merge_targets(calls, api1, api2, tolerance=tolerance).unionByName(merge_targets(calls, api2, api1, tolerance=tolerance))
    extra = targets.join(gives, "source_seq").select(F.col("target_seq").alias("seq"), "_more")
    return calls.join(extra, "seq", "left").withColumn("data", F.when(F.col("_more").isNull(), F.col("data")).otherwise(F.concat("data", "_more"))).drop("_more")


def template_requests(calls: DataFrame, templates: DataFrame) -> DataFrame:
    """``templates(api, queries map)`` -> one request per call and query of its API, with the call as its context."""
    each = templates.select("api", F.explode("queries").alias("query_id", "query"))
    context = F.to_json(F.struct(*calls.columns))
    return calls.join(each, "api").select("seq", "api", "query_id", "query", context.alias("context"))


def any_pair_holds(left: DataFrame, right: DataFrame, on: list[str], test: Column | tuple[str, str, str]) -> DataFrame:
    """Adds ``holds`` to the rows of ``left``: whether any right row of equal ``on`` columns passes ``test``.  Equal left rows stay rows.

    A comparison ``(left column, operator, right column)`` of ``< <= > >= = !=`` needs no pairs: for an order the least or
    greatest right value of the key decides, for ``!=`` both, and for ``=`` its distinct values are joined.  Any other test, on
    ``l.`` and ``r.`` columns, is the condition of a semi-join, which leaves a left row at its first match, and of the
    anti-join that has the rest.  A null is no match.
    """
    if isinstance(test, tuple):
        x, op, y = test
        names = [free_name(left, f"_{k}") for k in range(len(on) + 2)]
        keys, (low, high) = names[: len(on)], names[len(on) :]
        same = reduce(lambda a, b: a & b, [left[c] == F.col(k) for c, k in zip(on, keys, strict=True)], F.lit(True))
        known = right.where(F.col(y).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(y).alias(low))
        if op == "=":
            holds = left.join(known.distinct(), same & (left[x] == F.col(low)), "left").withColumn("holds", F.col(low).isNotNull())
            return holds.drop(*keys, low)
        ends = known.groupBy(*keys).agg(F.min(low).alias(low), F.max(low).alias(high))
        found = {"<": left[x] < F.col(high), "<=": left[x] <= F.col(high), ">": left[x] > F.col(low), ">=": left[x] >= F.col(low), "!=": (left[x] != F.col(low)) | (left[x] != F.col(high))}[op]
        return left.join(ends, same, "left").withColumn("holds", F.coalesce(found, F.lit(False))).drop(*names)
    pair = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on], test)
    of = lambda how: left.alias("l").join(right.alias("r"), pair, how)
    return of("left_semi").withColumn("holds", F.lit(True)).unionByName(of("left_anti").withColumn("holds", F.lit(False)))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def renest(joined: DataFrame, prefixes: list[str], keep: list[str], *, name: str = "db_info") -> DataFrame:
    """Columns ``prefix@column`` back into one map-like struct per table, null where the row missed."""
    parts = []
    for p in prefixes:
        own = [c for c in joined.columns if c.startswith(f"{p}@")]
        values = F.struct(*[F.col(f"`{c}`").alias(c.split("@", 1)[1]) for c in own])
        missed = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in own])
        parts.append(F.when(~missed, values).alias(p))
    return joined.select(*[F.col(f"`{c}`") for c in keep], F.struct(*parts).alias(name))
