"""Which API's data feeds which: sessions, look-back scores, ranked sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stretches import numbered, with_context

#: Seconds of a stretch in which calls are numbered, and calls in a block of a session.
BUCKET_S, BLOCK = 3_600, 100_000


def external_apis(calls: DataFrame, *, agent: str = "agent") -> DataFrame:
    """APIs that browsers call."""
    return calls.where(F.startswith(agent, F.lit("Mozilla/5.0"))).select("api").distinct()


def cap_log(calls: DataFrame, most: int) -> DataFrame:
    """The first calls of the log: a top-k, so each task keeps ``most`` rows at most."""
    return calls.orderBy("seq").limit(most)


def encode_events(calls: DataFrame) -> DataFrame:
    """Adds ``code``: APIs numbered in the order in which they first appear.  The numbering is over one row per API."""
    first = calls.groupBy("api").agg(F.min("seq").alias("_first"))
    codes = first.select("api", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("code"))
    return calls.join(codes, "api")


def session_lengths(with_sid: DataFrame) -> DataFrame:
    """Calls of each session; what comes before the first start is session 0 and may be empty."""
    counts = with_sid.groupBy("sid").agg(F.count("*").alias("n_calls"))
    first = with_sid.sparkSession.range(1).select(F.lit(0).cast("long").alias("sid"), F.lit(0).cast("long").alias("n_calls"))
    return counts.unionByName(first.join(counts, "sid", "left_anti"))


def lookback_score(with_sid: DataFrame, *, rounds: int = 3, decay: float = 0.5) -> DataFrame:
    """``api, source_api, score``: how often a call of ``api`` has ``source_api`` k calls before in its session, decayed by k.

    Calls are numbered in their session and windows are over blocks of it, each with the calls before that it looks back at.
    """
    order = Window.partitionBy("sid", "_block").orderBy("_n")
    lags = F.array(*[F.struct(F.lit(decay ** (k - 1)).alias("w"), F.lag("api", k).over(order).alias("b")) for k in range(1, rounds + 1)])
    blocks = with_context(numbered(with_sid, "sid", F.floor(F.col("t") / BUCKET_S), ["t", "seq"]), rounds, BLOCK)
    steps = blocks.select("api", "_own", lags.alias("l")).where("_own").drop("_own")
    total = with_sid.groupBy("api").agg(F.count("*").alias("n"))
    sums = steps.select("api", F.inline("l")).where(F.col("b").isNotNull()).groupBy("api", "b", "w").agg(F.count("*").alias("c"))
    scores = sums.groupBy("api", "b").agg(F.sum(F.col("w") * F.col("c")).alias("s"))
    return scores.join(total, "api").select("api", F.col("b").alias("source_api"), (F.col("s") / F.col("n")).alias("score"))


def normalized(matrix: DataFrame, by: str) -> DataFrame:
    """``(i, j, p)`` with the entries of each ``by`` summing to one."""
    return matrix.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(by)))


def transitions(with_sid: DataFrame, column: str = "api") -> DataFrame:
    """``(i, j, p)``: the share of calls of i that are followed by j in their session."""
    order = Window.partitionBy("sid", "_block").orderBy("_n")
    blocks = with_context(numbered(with_sid, "sid", F.floor(F.col("t") / BUCKET_S), ["t", "seq"]), 1, BLOCK)
    pairs = blocks.select(F.lag(column).over(order).alias("i"), F.col(column).alias("j"), "_own").where(F.col("_own") & F.col("i").isNotNull() & F.col("j").isNotNull()).drop("_own")
    return normalized(pairs.groupBy("i", "j").agg(F.count("*").cast("double").alias("p")), "i")


def backward_score(trans: DataFrame, emission: DataFrame, *, rounds: int = 3, decay: float = 0.5) -> DataFrame:
    """Decayed chance of each other API ``k`` steps back, from long tables ``(i, j, p)`` over states and APIs.

    ``emission(i state, j api, p)``: an API's states are its normalised column; each round goes one transition back and
    emits.  The tables have a row per pair of states or APIs, never per call.
    """
    back = normalized(trans.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"), "i")
    at = normalized(emission.select(F.col("j").alias("i"), F.col("i").alias("s"), "p"), "i").select(F.col("i").alias("api"), "s", "p")
    parts = None
    for k in range(1, rounds + 1):
        at = at.join(back.withColumnRenamed("p", "q"), at["s"] == back["i"]).groupBy("api", F.col("j").alias("s")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        out = at.join(emission.select(F.col("i").alias("s"), F.col("j").alias("source_api"), F.col("p").alias("e")), "s").select("api", "source_api", (F.col("p") * F.col("e") * decay ** (k - 1)).alias("x"))
        parts = out if parts is None else parts.unionByName(out)
    return parts.groupBy("api", "source_api").agg(F.sum("x").alias("score"))


def rank_sources(scores: DataFrame) -> DataFrame:
    """Adds ``rank`` among an API's sources, highest score first; ties: the higher code, else the later name."""
    tie = F.desc("code") if "code" in scores.columns else F.desc("source_api")
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("api").orderBy(F.desc("score"), tie)))


def candidate_flows(ranked: DataFrame, external: DataFrame, *, least: float = 0.1, most: int = 20) -> DataFrame:
    """User-facing sources of enough score, ``most`` per API."""
    own = ranked.join(external.select(F.col("api").alias("source_api")), "source_api", "left_semi").where(F.col("score") >= least)
    order = Window.partitionBy("api").orderBy("rank")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("api", "source_api", "place")


def sample_calls(calls: DataFrame, n: int, *, seed: int = 0, parts: int = 64) -> DataFrame:
    """n calls of each API, those whose digest of seed and sequence number is lowest, in log order.

    The lowest of each API are those among the lowest of its parts, so a busy API is many windows and at most ``parts * n`` rows meet in one.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string")).cast("binary"))
    lowest = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_d", "seq"))).where(F.col("_r") <= n)
    own = calls.withColumns({"_d": digest, "_part": F.pmod(F.xxhash64("seq"), F.lit(parts))})
    return lowest(lowest(own, "api", "_part"), "api").drop("_r", "_d", "_part").orderBy("seq")
