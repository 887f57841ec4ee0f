"""Rules on calls: their families, how they are run, gated and mined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .guard import guarded

#: Value formats of rules.
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "url": r"^https?://[^\s/]+(/\S*)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "digits": r"^[0-9]+$",
}
INJECTION = r"(?i)\b(SELECT|UPDATE|DELETE|INSERT)\b"


@dataclass(frozen=True)
class Rule:
    """A rule of one API: a condition, null or an error of which is a failure; None always passes."""

    rule_id: str
    api: str
    condition: Column | None
    message: str = ""


def has_format(c: Column, name: str) -> Column:
    return c.rlike(FORMATS[name])


def no_injection(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(INJECTION)


def in_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def status_in(c: Column, values: list) -> Column:
    return c.isin(*values)


def equal_fields(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def member_of(c: Column, items: Column) -> Column:
    return F.coalesce(F.array_contains(items, c), F.lit(False))


def verdicts(rules: list[Rule], api: Column, present: Column | None = None, rows: DataFrame | None = None) -> Column:
    """``array<struct<rule_id, passed, message>>`` of the rules of a row's API, null where it has none.

    Only the rules of the row's own API are evaluated.  Where ``present`` is false they fail for want of a related call.
    An error in a condition fails that check, with the error as message, and nothing else; with ``rows``, what cannot
    raise on them is not guarded.  No setting of the session is touched.
    """
    by_api: dict[str, list[Column]] = {}
    for r in rules:
        def check(value: Column, error: Column, r: Rule = r) -> Column:
            passed = F.coalesce(value.try_cast("boolean"), F.lit(False))
            message = F.when(error.isNotNull(), error).when(~passed, F.lit(r.message))
            if present is not None:
                passed, message = present & passed, F.when(~present, F.lit("Cannot find related event")).otherwise(message)
            return F.struct(F.lit(r.rule_id).alias("rule_id"), passed.alias("passed"), message.alias("message"))

        by_api.setdefault(r.api, []).append(check(F.lit(True), F.lit(None).cast("string")) if r.condition is None else guarded(r.condition, check, rows))
    out = F.lit(None).cast("array<struct<rule_id: string, passed: boolean, message: string>>")
    for name, tests in by_api.items():
        out = F.when(api == name, F.array(*tests)).otherwise(out)
    return out


def check_rules(calls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``seq, api, rule_id, passed, message``: every rule on every call of its API.

    All rules are evaluated in one projection, so calls are neither joined with rules nor shuffled.  An error in a
    condition fails that check and nothing else; its text is the message.
    """
    return calls.select("seq", "api", F.explode(verdicts(rules, F.col("api"), rows=calls)).alias("c")).select("seq", "api", "c.*")


CHECKED = StructType([StructField("seq", LongType()), StructField("api", StringType()), StructField("rule_id", StringType()), StructField("passed", BooleanType()), StructField("message", StringType())])


def check_python_rules(calls: DataFrame, rules: dict[str, tuple[str, Callable[[dict], object]]]) -> DataFrame:
    """Rules given as Python callables, ``rule_id -> (api, function of the call)``, in Arrow batches.

    An exception or ``False`` fails; anything else passes.  Functions are given as such, never as text.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for call in rows.to_dict("records"):
                for rule_id, (api, test) in rules.items():
                    if call["api"] != api:
                        continue
                    try:
                        passed, message = test(call) is not False, None
                    except Exception as e:  # a rule's own error is a failed check
                        passed, message = False, f"{type(e).__name__}: {e}"
                    out.append((call["seq"], api, rule_id, passed, message))
            yield pd.DataFrame(out, columns=CHECKED.names)

    return calls.where(F.col("api").isin(*{a for a, _ in rules.values()})).mapInPandas(run, CHECKED)


def check_pair_rules(calls: DataFrame, pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Two-call rules: ``pairs(seq, related_seq)``; conditions see ``b.`` (the call) and ``a.`` (its related call).

    A call without a related one fails with a message; so does an error in a condition, with the error's text.
    """
    a, b = calls.alias("a"), calls.alias("b")
    both = pairs.join(b, F.col("b.seq") == pairs["seq"]).join(a, F.col("a.seq") == pairs["related_seq"], "left")
    found = verdicts(rules, F.col("b.api"), F.col("a.seq").isNotNull(), both)
    return both.select(F.col("b.seq").alias("seq"), F.col("b.api").alias("api"), F.explode(found).alias("c")).select("seq", "api", "c.*")


def failure_reasons(checks: DataFrame, *, most: int = 3) -> DataFrame:
    """Per rule: checks, failures, and up to ``most`` of the messages, the lowest."""
    told = checks.where(~F.col("passed")).select("rule_id", F.coalesce("message", F.lit("")).alias("message")).distinct()
    few = told.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("message"))).where(F.col("_n") <= most)
    reasons = few.groupBy("rule_id").agg(F.array_sort(F.collect_list("message")).alias("reasons"))
    counts = checks.groupBy("rule_id").agg(F.count("*").alias("n_calls"), F.count_if(~F.col("passed")).alias("n_failed"))
    return counts.join(reasons, "rule_id", "left").select("rule_id", "n_calls", "n_failed", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def gate_rules(checks: DataFrame) -> DataFrame:
    """Rules that every training call passes."""
    return checks.groupBy("rule_id").agg(F.count("*").alias("n_calls"), F.count_if(~F.col("passed")).alias("n_failed")).where(F.col("n_failed") == 0).select("rule_id", "n_calls")


def assert_silent(checks: DataFrame) -> None:
    """Raises if a rule fires on training data."""
    if (bad := checks.where(~F.col("passed")).select("rule_id").first()) is not None:
        raise ValueError(f"rule {bad['rule_id']} fires on training data")


def mine_constants(calls: DataFrame, columns: list[str], *, most: int = 3) -> DataFrame:
    """Per API and column, the few values that it always has, where it has ``most`` at most.

    Distinct values are counted before they are gathered, so a set is as small as the limit.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    distinct = calls.select("api", pairs).where(F.col("value").isNotNull()).distinct()
    few = distinct.groupBy("api", "column").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("api", "column")
    return distinct.join(few, ["api", "column"]).groupBy("api", "column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"))


def _prints(calls: DataFrame, columns: list[str]) -> DataFrame:
    """``(api, column, kind, total, mix)``: sums over rows of hashes of row and value, which equal columns share."""
    value = lambda c: F.col(c) + 0.0 if calls.schema[c].dataType.typeName() in ("float", "double") else F.col(c)  # noqa: E731  one zero
    row = calls.select("api", F.monotonically_increasing_id().alias("_row"), *[value(c).alias(c) for c in columns])
    cells = F.inline(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(calls.schema[c].dataType.simpleString()).alias("kind"), F.xxhash64("_row", c).alias("h")) for k, c in enumerate(columns)]))
    return row.select("api", cells).groupBy("api", "column", "kind").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("mix"))


def mine_equalities(calls: DataFrame, columns: list[str]) -> DataFrame:
    """Per API, pairs of columns of one kind that are equal in every call, nulls being equal.

    Columns with one print make a class, and each of its members is then compared with the first, row by row; so the plan
    grows with the columns and not with their pairs.
    """
    spark, schema = calls.sparkSession, "api string, a string, b string"
    if len(columns) < 2:
        return spark.createDataFrame([], schema)
    classes = _prints(calls, columns).groupBy("api", "kind", "total", "mix").agg(F.array_sort(F.collect_list("column")).alias("members")).where(F.size("members") > 1)
    found = [(r["api"], r["members"]) for r in classes.select("api", "members").collect()]  # columns by APIs at most
    asked = sorted({(m[0], k) for _, m in found for k in m[1:]})
    if not asked:
        return spark.createDataFrame([], schema)
    tests = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("member"), F.bool_and(F.col(columns[a]).eqNullSafe(F.col(columns[b]))).alias("same")) for a, b in asked])
    same = calls.groupBy("api").agg(tests.alias("t")).select("api", F.inline("t")).where("same").select("api", "first", "member")
    known = spark.createDataFrame([(api, m[0], k) for api, m in found for k in m[1:]], "api string, first int, member int")
    same = same.join(known, ["api", "first", "member"], "left_semi")
    members = same.select("api", "first", "member").union(same.select("api", "first", F.col("first").alias("member"))).distinct()
    pairs = members.alias("x").join(members.alias("y"), ["api", "first"]).where(F.col("x.member") < F.col("y.member"))
    names = F.array(*map(F.lit, columns))
    return pairs.select("api", F.get(names, F.col("x.member")).alias("a"), F.get(names, F.col("y.member")).alias("b"))


def branch_mismatch(rows: DataFrame, actual: Column, expected: Column) -> DataFrame:
    """Rows, mismatches (an error, seen as null, is one) and whether any was an error."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(actual == expected, F.lit(False))).alias("n_mismatch"), F.coalesce(F.bool_or(actual.isNull()), F.lit(False)).alias("failed"))
