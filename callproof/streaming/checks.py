"""Rules on a stream of calls.

The column rules hold row by row, so they need no state; counts of failures per window of event time keep a
watermark, after which late calls no longer change a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Rule, check_rules, verdicts


def stream_checks(calls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``check_rules`` on a streaming frame ``(seq, api, ...)``, any output mode."""
    return check_rules(calls, rules)


def failure_counts(calls: DataFrame, rules: list[Rule], *, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Failed checks per window of event time, API and rule."""
    timed = calls.withWatermark(time, late)
    checked = timed.select(time, "api", F.explode(verdicts(rules, F.col("api"), rows=timed)).alias("c"))
    failed = checked.where(~F.col("c.passed")).select(time, "api", "c.rule_id")
    return failed.groupBy(F.window(time, window).alias("window"), "api", "rule_id").agg(F.count("*").alias("n_failed"))
