"""URLs matched to the APIs of a catalogue by their longest static prefix."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calls import body_arguments, json_or_text, last_of_each, named_arguments, path_params, static_prefix, time_seconds, time_text

#: Catalogues of up to this many routes become a constant of the plan.
MOST_ROUTES = 1000


def route_urls(flows: DataFrame, catalogue: DataFrame, *, path: str = "path", keep_unmatched: bool = False) -> DataFrame:
    """Adds ``api`` and ``prefix``; ``catalogue(api, url_path, position)``, later positions win on equal prefixes.

    The paths are cut at the lengths that prefixes have and looked up in the catalogue within the row, longest first: no
    comparison of all pairs, and no shuffle of the flows.  A large catalogue is met by an equi-join on the cut paths.
    """
    routes = catalogue.withColumn("prefix", static_prefix(F.col("url_path"))).groupBy("prefix").agg(F.max_by("api", "position").alias("api"))
    rows = routes.select("prefix", "api").take(MOST_ROUTES + 1)
    if len(rows) > MOST_ROUTES:
        return _joined(flows, routes, path, keep_unmatched)
    table = {r["prefix"]: r["api"] for r in rows}
    lengths = sorted({len(p) for p in table}, reverse=True)
    known = F.from_json(F.lit(json.dumps(table)), "map<string,string>")  # a constant of the plan
    cuts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths], F.lit(None).cast("string")), lambda p: p.isNotNull() & F.map_contains_key(known, p))
    out = flows.withColumn("prefix", F.get(cuts, F.lit(0)))
    out = out.withColumn("api", F.when(F.col("prefix").isNotNull(), F.element_at(known, F.col("prefix"))))
    return out if keep_unmatched else out.where(F.col("api").isNotNull())


def _joined(flows: DataFrame, routes: DataFrame, path: str, keep_unmatched: bool) -> DataFrame:
    """For a large catalogue: each path's prefixes at the catalogue's lengths, joined, the longest kept."""
    lengths = sorted(r["n"] for r in routes.select(F.length("prefix").alias("n")).distinct().collect())  # as many as prefix lengths
    cuts = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    paths = flows.select(path).distinct()
    best = paths.withColumn("prefix", F.explode(cuts)).join(routes, "prefix").groupBy(path).agg(F.max_by(F.struct("api", "prefix"), F.length("prefix")).alias("m"))
    out = flows.join(best, path, "left").select(*flows.columns, F.col("m.prefix").alias("prefix"), F.col("m.api").alias("api"))
    return out if keep_unmatched else out.where(F.col("api").isNotNull())


def with_named_arguments(calls: DataFrame, catalogue: DataFrame, *, values: str = "arguments") -> DataFrame:
    """Positional arguments by the names in ``catalogue(api, argument_names)``, each as JSON text; what does not parse is a JSON string."""
    names = catalogue.select("api", "argument_names")
    return calls.join(names, "api").withColumn("named", named_arguments(F.col("argument_names"), F.transform(values, json_or_text))).drop("argument_names")


def known_calls(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Only calls of APIs in the catalogue."""
    return calls.join(catalogue.select("api").distinct(), "api", "left_semi")


def known_counts(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls of each API in the catalogue, 0 where there is none."""
    counts = calls.groupBy("api").agg(F.count("*").alias("n"))
    return catalogue.select("api").distinct().join(counts, "api", "left").select("api", F.coalesce("n", F.lit(0)).alias("n_calls"))


def flow_status(flows: DataFrame) -> DataFrame:
    """Answered flows with ``has_error``, and the response as JSON where it is JSON."""
    return flows.where(F.col("status").isNotNull()).withColumn("has_error", F.col("status") >= 400).withColumn("is_json", F.try_parse_json("resp_body").isNotNull())


def calls_of_flows(flows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls from answered flows of known routes: ``api, time, response_time, arguments, headers, has_error, response``.

    Arguments are the parts of the path, then the fields of the body, of which one with the same name stands.
    """
    known = route_urls(flow_status(flows), catalogue)
    arguments = last_of_each(F.concat(F.map_entries(path_params(F.col("path"), F.col("prefix"))), F.map_entries(body_arguments(F.col("req_body")))))
    return known.select(
        "api", time_text(F.col("req_ts")).alias("time"), time_text(F.col("resp_ts")).alias("response_time"), arguments.alias("arguments"), F.col("req_headers").alias("headers"), "has_error",
        json_or_text(F.col("resp_body")).alias("response"),
    )


def of_split(calls: DataFrame, split: str | None = None) -> DataFrame:
    """The calls of one split (``train`` or ``test``), or all."""
    return calls if split is None else calls.where(F.col("split") == split)


def named_and_timed(calls: DataFrame, *, time: str = "time") -> DataFrame:
    """The calls that have an API and a time, with ``t`` in seconds: what tables per API are made of.

    A table of one API is ``where(api = ...)`` of these rows; all of them at once are a write partitioned by ``api``.
    """
    timed = calls.withColumn("t", time_seconds(F.col(time)))
    return timed.where(F.col("api").isNotNull() & (F.col("api") != "") & F.col("t").isNotNull())
