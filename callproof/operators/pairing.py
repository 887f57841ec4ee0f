"""Enter and exit lines paired into calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Positions in a stretch of the log.
STRETCH = 1_000_000


def matched(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines(keys, _pos, _enter)`` with ``_exit``, the position of the exit that an enter pairs with, and ``_left`` where a line has no partner.

    With the running count of enters less exits, an exit is an orphan if it goes below every count before; without
    orphans, an enter and its exit lie at one depth and follow each other there.  All windows share one shuffle on the keys.
    """
    line = Window.partitionBy(*keys).orderBy("_pos")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("_enter"), 1).otherwise(-1)
    run = lines.withColumn("_run", F.sum(step).over(so_far))
    lowest = F.least(F.lit(0), F.coalesce(F.min("_run").over(before), F.lit(0)))
    whole = run.withColumn("_orphan", ~F.col("_enter") & (F.col("_run") < lowest))
    after = F.sum(F.when(F.col("_orphan"), 0).otherwise(step)).over(so_far)
    deep = whole.withColumn("_depth", F.when(F.col("_enter"), after).otherwise(after + 1))
    level = Window.partitionBy(*keys, "_depth", "_orphan").orderBy("_pos")
    follows = F.lead(F.struct("_pos", "_enter")).over(level)
    met = deep.withColumn("_exit", F.when(F.col("_enter") & ~F.col("_orphan"), F.when(~follows["_enter"], follows["_pos"])))
    return met.select(*keys, "_pos", "_enter", "_exit", (F.col("_orphan") | (F.col("_enter") & F.col("_exit").isNull())).alias("_left"))


def pair_calls(lines: DataFrame, *, key: list[str] | str = "api", order: str = "pos", is_enter: str = "is_enter", stretch: int = STRETCH) -> DataFrame:
    """Pairs as a stack would: ``key columns, enter_pos, exit_pos`` per call.

    What pairs within a stretch of the log pairs so in the whole, so stretches are paired first, and only the lines left
    over there, those of calls that cross an edge, meet in a window on the key.
    """
    keys = [key] if isinstance(key, str) else key
    own = lines.select(*keys, F.floor(F.col(order) / stretch).alias("_stretch"), F.col(order).alias("_pos"), F.col(is_enter).alias("_enter"))
    near = cut(matched(own, [*keys, "_stretch"]).where(F.col("_exit").isNotNull() | F.col("_left")))  # read twice: its pairs, and what is left over
    far = matched(near.where("_left").select(*keys, "_pos", "_enter"), keys)
    pairs = [m.where(F.col("_exit").isNotNull()).select(*keys, F.col("_pos").alias("enter_pos"), F.col("_exit").alias("exit_pos")) for m in (near, far)]
    return pairs[0].unionByName(pairs[1])


def calls_of_pairs(lines: DataFrame, pairs: DataFrame, *, key: str = "api", order: str = "pos") -> DataFrame:
    """Calls from paired lines: enter parts, then the answer; an error has no response, no error no throwable."""
    enter = lines.select(F.col(order).alias("enter_pos"), "time", "arguments", "headers")
    leave = lines.select(F.col(order).alias("exit_pos"), F.col("time").alias("response_time"), "has_error", F.nullif(F.trim("returned"), F.lit("")).alias("returned"), F.nullif(F.trim("throwable"), F.lit("")).alias("throwable"))
    both = pairs.join(enter, "enter_pos").join(leave, "exit_pos")
    failed = F.coalesce("has_error", F.lit(False))
    return both.select(key, "enter_pos", "time", "arguments", "headers", "response_time", failed.alias("has_error"), F.when(~failed, F.col("returned")).alias("response"), F.when(failed, F.col("throwable")).alias("throwable")).orderBy("time", "enter_pos")


def calls_of_lines(lines: DataFrame) -> DataFrame:
    """Calls from the lines that ``read_lines`` gives, by time."""
    own = lines.select(
        F.col("methodName").alias("api"), "pos", F.col("isEnter").alias("is_enter"), "time", "arguments", "headers", F.col("hasError").alias("has_error"), F.col("returnObj").alias("returned"), "throwable",
    )
    return calls_of_pairs(own, pair_calls(own))
