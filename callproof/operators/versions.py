"""Row versions from a change log, and the version of a row at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import kind_of
from .stretches import carried_last, joined_on

#: Seconds of a stretch in which a look-up and the versions of its row share a window.
STRETCH_S = 3_600

#: Shards whose changes belong to one table: fixed values of the system at hand.
SHARDS = {"orders_other": "orders", "trip2": "trip"}


def normalized_changes(changes: DataFrame, keys: DataFrame, *, schema: str | None = None, shards: dict[str, str] | None = None) -> DataFrame:
    """Changed rows of tables with a key of one column: ``pos, idx, type, table, ts_s, pk, before, after``.

    ``keys(table, primary_keys)`` as from ``table_keys``.  Shards take the name of their table.
    """
    shards = SHARDS if shards is None else shards
    own = changes.where(F.col("type").isin("insert", "update", "delete"))
    if schema is not None:
        own = own.where(F.col("schema") == schema)
    name = F.col("table")
    for shard, table in shards.items():
        name = F.when(F.col("table") == shard, table).otherwise(name)
    rows = own.withColumn("table", name).select("pos", "type", "table", F.col("timestamp").alias("ts_s"), F.posexplode("rows").alias("idx", "r"))
    before = F.when(F.col("type") == "update", F.col("r.before_values")).when(F.col("type") == "delete", F.col("r.values"))
    after = F.when(F.col("type") == "update", F.col("r.after_values")).when(F.col("type") == "insert", F.col("r.values"))
    single = keys.where(F.size("primary_keys") == 1).select("table", F.get("primary_keys", F.lit(0)).alias("key"))
    out = rows.select("pos", "idx", "type", "table", "ts_s", before.alias("before"), after.alias("after")).join(F.broadcast(single), "table")  # a row per table
    pk = F.coalesce(F.element_at("before", F.col("key")), F.element_at("after", F.col("key")))
    return out.select("pos", "idx", "type", "table", "ts_s", pk.alias("pk"), F.element_at("after", F.col("key")).alias("new_pk"), "before", "after")


#: Positions in the log of a stretch in which the changes of a row are numbered.
STRETCH_ROWS = 1_000_000


def row_versions(changes: DataFrame, *, keys: tuple[str, ...] = ("table", "pk"), stretch: int = STRETCH_ROWS) -> DataFrame:
    """``changes(keys, pos, ts_s, before, after)`` -> versions: number 0 at time 0 is the old value of the first change.

    ``keys, ver, ts_s, row, last_ts_s``; a null row means that there is none then.  Changes are numbered within stretches of the
    log, and one row for each key and stretch tells how many came before, so a row that changes all the time is many windows.
    """
    names = [*keys, "_stretch"]
    own = changes.withColumn("_stretch", F.floor(F.col("pos") / stretch))
    counts = own.groupBy(*names).agg(F.count("*").alias("_rows"), F.max("ts_s").alias("_last"))
    past, every = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    before = counts.select(*names, F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_before"), F.max("_last").over(every).alias("last_ts_s"))
    placed = own.withColumn("_place", F.row_number().over(Window.partitionBy(*names).orderBy("pos")))
    own = joined_on(placed, before, names).withColumn("ver", (F.col("_before") + F.col("_place")).cast("int"))
    later = F.struct(F.col("ver"), F.col("ts_s").alias("ts_s"), F.col("after").alias("row"))
    first = F.struct(F.lit(0).alias("ver"), F.lit(0).cast("long").alias("ts_s"), F.col("before").alias("row"))
    both = F.when(F.col("ver") == 1, F.array(first, later)).otherwise(F.array(later))
    return own.select(*keys, "last_ts_s", F.explode(both).alias("v")).select(*keys, "v.ver", "v.ts_s", "v.row", "last_ts_s")


def version_at(lookups: DataFrame, versions: DataFrame, *, keys: tuple[str, ...] = ("table", "pk"), t: str = "t") -> DataFrame:
    """Adds ``found`` and ``row`` to lookups: the last version before ``int(t - 1)``, else version 0.

    After a key's last change nothing is found, and the row of the snapshot holds.  Lookups and versions go through one
    window on the key and a stretch of time, and the last version of the stretches before is carried over, so a key with
    many versions or look-ups is many windows, and no lookup meets every version.
    """
    cut = F.floor(F.col(t) - 1).cast("long")
    names = lookups.columns
    left = lookups.select(*keys, F.struct(*names).alias("_l"), cut.alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("int").alias("_ver"), F.lit(None).cast(versions.schema["row"].dataType).alias("_row"), F.lit(None).cast("long").alias("_last"))
    right = versions.select(*keys, F.lit(None).cast(left.schema["_l"].dataType).alias("_l"), F.when(F.col("ver") == 0, F.lit(-(2**62))).otherwise(F.col("ts_s")).alias("_at"), F.lit(1).alias("_side"), F.col("ver").alias("_ver"), F.col("row").alias("_row"), F.col("last_ts_s").alias("_last"))
    both = left.unionByName(right).withColumn("_b", F.floor(F.col("_at") / STRETCH_S))
    known = F.when(F.col("_side") == 1, F.struct("_row", "_last"))
    met = carried_last(both, list(keys), "_b", ["_at", "_side", "_ver"], known, "_m").where(F.col("_side") == 0)
    found = F.col("_m").isNotNull() & (F.col(f"_l.{t}") <= F.col("_m._last"))
    return met.select("_l.*", found.alias("found"), F.when(found, F.col("_m._row")).alias("row"))


def overlay(joined: DataFrame, versions: DataFrame, *, pk: str, columns: dict[str, Column], t: str = "t", lookup_missing: bool = False) -> DataFrame:
    """Right-hand columns of a joined call replaced by what its row held at the time of the call.

    ``columns``: name -> its value in the version's ``row``.  A deleted row nulls them all; a call whose snapshot
    join missed is left alone unless ``lookup_missing``.
    """
    keyed = joined.withColumn("pk", F.col(pk).cast("string"))
    seen = version_at(keyed, versions, keys=("pk",), t=t)
    present = F.lit(True) if lookup_missing else reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns])
    use = F.col("found") & present
    return seen.select(*[(F.when(use, columns[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`")) for c in joined.columns])


def ambiguous_versions(lookups: DataFrame, versions: DataFrame, *, keys: tuple[str, ...] = ("table", "pk"), t: str = "t") -> DataFrame:
    """Lookups, up to a key's last change, for which the version is not sure: ``keys, t, changes, none_before``.

    More than one change lies in ``int(t - 1)`` to ``int(t + 2)``, or none before that.  Changes are counted through an
    equi-join on the key and the second, of which a lookup has four.
    """
    at = F.col(t)
    spans = versions.where(F.col("ver") > 0).groupBy(*keys).agg(F.min("ts_s").alias("_first"), F.max("ts_s").alias("_last"))
    known = lookups.select(*keys, t).join(spans, list(keys)).where(at <= F.col("_last"))
    low, high = F.floor(at - 1).cast("long"), F.floor(at + 2).cast("long")
    counts = versions.where(F.col("ver") > 0).groupBy(*keys, "ts_s").agg(F.count("*").alias("_n"))
    met = known.withColumn("ts_s", F.explode(F.sequence(low, high))).join(counts, [*keys, "ts_s"], "left")
    out = met.groupBy(*keys, t).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("changes"), (F.min("_first") >= F.min(low)).alias("none_before"), F.count("*").alias("_rows"))
    per = out.withColumn("changes", (F.col("changes") / (F.col("_rows") / 4)).cast("long"))  # equal lookups count once
    return per.where((F.col("changes") > 1) | F.col("none_before")).drop("_rows")


def validate_changes(changes: DataFrame, *, keys: tuple[str, ...] = ("table", "pk"), catalogue: DataFrame | None = None) -> DataFrame:
    """Changes that break their key's chain, one row for each way: ``keys, pos, violation``.

    With ``catalogue(table, all_columns)`` the columns of each row (maps ``before`` and ``after``) must be the table's.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    own = changes.withColumns({"_ts": F.lag("ts_s").over(order), "_row": F.lag(F.struct("after")).over(order)})
    # maps cannot be compared; their entries can
    same = lambda a, b: (F.array_sort(F.map_entries(a)) if "map" in dict(changes.dtypes)["before"] else a).eqNullSafe(F.array_sort(F.map_entries(b)) if "map" in dict(changes.dtypes)["after"] else b)
    tests = {
        "time goes back": F.col("_ts") > F.col("ts_s"),
        "old value differs": F.col("_row").isNotNull() & ~same(F.col("before"), F.col("_row.after")),
    }
    if "new_pk" in changes.columns:
        tests["key changed"] = (F.col("type") == "update") & ~F.col("pk").eqNullSafe(F.col("new_pk"))
    if catalogue is not None:
        own = own.join(F.broadcast(catalogue.select("table", F.array_sort("all_columns").alias("_columns"))), "table", "left")  # a row per table
        fits = lambda row: F.coalesce(F.array_sort(F.map_keys(row)) == F.col("_columns"), row.isNull())
        tests["columns differ"] = ~(fits(F.col("before")) & fits(F.col("after")))
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return own.select(*keys, "pos", F.explode(broken).alias("violation"))


def merge_tables(parts: list[DataFrame]) -> DataFrame:
    """Shards of one table together; they must have the same columns in the same order and of the same kinds."""
    first = parts[0]
    for p in parts[1:]:
        if [(f.name, kind_of(f.dataType)) for f in p.schema] != [(f.name, kind_of(f.dataType)) for f in first.schema]:
            raise ValueError("the shards have different columns")
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_table_keys(keys: DataFrame, shards: dict[str, str] | None = None) -> DataFrame:
    """``keys(table, primary_keys, all_columns)`` without the shards, whose keys and columns must be those of their table."""
    shards = SHARDS if shards is None else shards
    rows = {r["table"]: (r["primary_keys"], r["all_columns"]) for r in keys.where(F.col("table").isin(*shards, *shards.values())).collect()}  # two per shard
    for shard, table in shards.items():
        if shard in rows and rows[shard] != rows.get(table):
            raise ValueError(f"{shard} and {table} have different keys or columns")
    return keys.where(~F.col("table").isin(*shards))


def merge_changes(a: DataFrame, b: DataFrame, *, keys: tuple[str, ...] = ("table", "pk")) -> DataFrame:
    """Change logs of two shards together; no key may be in both."""
    if not a.select(*keys).join(b.select(*keys), list(keys), "left_semi").limit(1).isEmpty():
        raise ValueError("the shards share keys")
    return a.unionByName(b)
