"""Call logs, instrumentation lines, HTTP flows and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALL_SCHEMA = (
    "time string, response_time string, api string, api_name string, arguments string, response string, headers map<string,string>, env map<string,string>,"
    " queries map<string,string>, controller_path string, url_path string, has_error boolean, throwable string, split string"
)
LINE_SCHEMA = "methodName string, isEnter boolean, time double, arguments array<string>, headers map<string,string>, hasError boolean, returnObj string, throwable string"
FLOW_SCHEMA = "path string, req_ts double, req_body string, req_headers map<string,string>, resp_ts double, status int, resp_body string"
CHANGE_SCHEMA = "pos long, type string, schema string, `table` string, timestamp long, rows array<struct<before_values: map<string,string>, after_values: map<string,string>, values: map<string,string>>>"


def read_calls(spark: SparkSession, path: str, *, partitions: int | None = None) -> DataFrame:
    """A call log of JSON lines, plain, ``.gz`` or ``.zst``.

    Compressed files cannot be split, so ``partitions`` spreads their rows after reading.
    """
    df = spark.read.schema(CALL_SCHEMA).json(path)
    return df.repartition(partitions) if partitions else df


def write_calls(calls: DataFrame, path: str, *, compression: str = "none") -> None:
    """Writes a call log as JSON lines; nested values that are no JSON types are written as text."""
    calls.write.mode("errorifexists").option("compression", compression).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Enter and exit lines of instrumentation logs, with ``file`` and ``pos``; blank lines are dropped.

    ``pos`` is the place of a line in all files, by name, one after the other, whatever the splits they are read in: lines are
    numbered within a split, and a split starts where the lines of those before it end.  Only one row for each split meets in a task.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = text.groupBy("file", "_block").agg(F.min("_id").alias("_low"), F.count("*").alias("_rows"))
    past = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_block", (F.coalesce(F.sum("_rows").over(past), F.lit(0)) - F.col("_low")).alias("_shift"))
    placed = text.where(F.trim("value") != "").join(starts, ["file", "_block"])
    return placed.select("file", (F.col("_id") + F.col("_shift")).alias("pos"), F.from_json("value", LINE_SCHEMA).alias("line")).select("file", "pos", "line.*")


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """HTTP request and response pairs, as JSON lines or Parquet by suffix."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(FLOW_SCHEMA).json(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A row change log, as JSON lines or Parquet by suffix."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(CHANGE_SCHEMA).json(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of four-part lists -> ``from_table, from_column, to_table, to_column``."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(*[F.get("r", F.lit(k)).alias(n) for k, n in enumerate(("from_table", "from_column", "to_table", "to_column"))])


def flows_of(text) -> list:
    """Columns ``api, source_api`` of a JSON object api -> list of source APIs, exploded twice by the caller."""
    return [F.explode(F.from_json(text, "map<string,array<string>>")).alias("api", "sources")]


def flows_from_map(maps: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects api -> source APIs, as ``(api, source_api)`` without pairs of an API with itself."""
    pairs = maps.select(*flows_of(F.col(column))).select("api", F.explode("sources").alias("source_api"))
    return pairs.where(F.col("api") != F.col("source_api")).distinct()


def read_flow_map(spark: SparkSession, path: str) -> DataFrame:
    return flows_from_map(spark.read.text(path, wholetext=True))


def write_violations(found: DataFrame, path: str, *, kind: str = "json", by: str = "window_id") -> None:
    """Report records, one folder per window, or per value of another column."""
    found.write.mode("errorifexists").partitionBy(by).format(kind).save(path)


RULE_SCHEMA = (
    "domain array<struct<api: string, related_fields: map<string,boolean>, quantifier: string>>, premise struct<premise_position: string, premise_type: string>,"
    " predicate struct<is_true_precisely: boolean, desc: string, py_code: string, num_args: int>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as JSON lines: ``rule_no, domain, premise, predicate``.  Their source text is carried, never run."""
    return spark.read.schema(RULE_SCHEMA).json(path).select(F.monotonically_increasing_id().alias("rule_no"), "*")


def write_rules(rules: DataFrame, path: str) -> None:
    """Writes rules as JSON lines, in the order of ``rule_no``."""
    rules.orderBy("rule_no").drop("rule_no").write.mode("errorifexists").json(path)
