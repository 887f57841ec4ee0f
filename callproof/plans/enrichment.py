"""The enrichment of one API's calls: rows by foreign keys as of the call, then the nearest earlier calls."""

from __future__ import annotations

import logging
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, versions
from ..operators.profile import kind_of

LOG = logging.getLogger(__name__)


def enrich_calls(calls: DataFrame, tables: dict[str, DataFrame], relations: list[tuple[str, str, str]], flows: DataFrame, *, api: str, changes: dict[str, tuple[DataFrame, dict]] | None = None, window: str | None = None) -> DataFrame:
    """Calls of ``api`` with ``db_info`` (a row per table, null where missed) and ``related`` (a call's number per source API).

    ``relations``: ``(left column, table, right column)`` in order; columns under ``response.`` are left out, a right key
    that is empty or repeats is skipped, as is a relation that cannot be joined, and a table named by more than one relation
    is ``table#0``, ``table#1``.  ``changes``:
    table -> versions of its rows and, per column, how it is read from a version; they replace the snapshot's values.
    """
    wanted = [r for r in relations if not r[0].startswith("response.") and r[1] in tables]
    good = {(r["table"], r["column"]) for r in joins_checked(tables, wanted) if r["joinable"]}
    uses, seen = Counter(r[1] for r in wanted), Counter()  # skipped relations count as uses of their table
    wanted = [r for r in wanted if (r[1], r[2]) in good]
    out = calls.where(F.col("api") == api)
    keep, prefixes = out.columns, []
    for left, name, right in wanted:
        prefix = name if uses[name] == 1 else f"{name}#{seen[name]}"
        seen[name] += 1
        if reason := _not_joined(out, left, tables[name], right):
            LOG.warning("relation %s -> %s.%s is skipped: %s", left, name, right, reason)
            continue
        out = joins.fk_join_unchecked(out, tables[name], left, right, prefix)
        if changes and name in changes:
            rows, columns = changes[name]
            out = versions.overlay(out, rows, pk=f"`{prefix}@{right}`", columns={f"{prefix}@{c}": v for c, v in columns.items()})
        prefixes.append(prefix)
    out = joins.renest(out, prefixes, keep) if prefixes else out.withColumn("db_info", F.lit(None).cast("string"))
    own_flows = flows.where(F.col("api") == api)
    related = joins.asof_related_call(calls, own_flows, window=window)
    names = sorted(r["source_api"] for r in own_flows.select("source_api").distinct().collect())  # a few per API
    if not names:
        return out
    by_call = related.groupBy("seq").agg(*[F.max(F.when(F.col("source_api") == n, F.col("related_seq"))).alias(n) for n in names])
    return out.join(by_call.select("seq", F.struct(*names).alias("related")), "seq", "left")


def _not_joined(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> str | None:
    """Why two columns cannot be a relation: one is not there, or their kinds cannot be compared; None if they can be."""
    kinds = []
    for df, name in ((left, left_key), (right, right_key)):
        found = [f.dataType for f in df.schema if f.name.lower() == name.lower()]
        if not found:
            return f"there is no column {name}"
        kinds.append("value" if kind_of(found[0]) in ("bool", "int", "float", "str") else found[0].simpleString())
    return None if kinds == ["value", "value"] or kinds[0] == kinds[1] and "map<" not in kinds[0] else f"{kinds[0]} and {kinds[1]} are not compared"


def joins_checked(tables: dict[str, DataFrame], wanted: list[tuple[str, str, str]]) -> list:
    """Each distinct right key is checked once."""
    from ..operators.keys import joinable_keys

    pairs = sorted({(t, c) for _, t, c in wanted})
    return joinable_keys(tables, pairs).collect() if pairs else []
