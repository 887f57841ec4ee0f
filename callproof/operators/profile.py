"""Profiles of columns and nested values, shapes of calls."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DecimalType, FractionalType, IntegralType, MapType, StringType, StructType, TimestampType

from ..functions.calls import HEADER_ARGUMENTS
from .lineage import cut

MAX_OPTIONAL, MAX_KEYS = 5, 30


def kind_of(data_type) -> str:
    for kind, types in (("bool", BooleanType), ("int", IntegralType), ("float", (FractionalType, DecimalType)), ("str", (StringType, DateType, TimestampType)), ("array", ArrayType), ("object", StructType), ("dict", MapType)):
        if isinstance(data_type, types):
            return kind
    return "unknown"


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: kind, nulls, distinct values, least and greatest length and value.

    Columns are unpivoted and counted per value first, so a row is one narrow row per column and not a copy per distinct count.
    """
    cells, kinds = [], []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        size = F.length(c) if kind == "str" else F.size(c) if kind in ("array", "dict") else F.lit(None).cast("int")
        number = c.cast("double") if kind in ("int", "float") else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if kind == "dict" else F.to_json(c) if kind in ("array", "object") else c.cast("string")
        cells.append(F.struct(F.lit(f.name).alias("column"), c.isNull().alias("none"), text.alias("text"), F.when(c.isNotNull(), size).alias("size"), number.alias("number")))
        kinds.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("kind")))
    values = df.select(F.inline(F.array(*cells))).groupBy("column", "none", "text").agg(F.count("*").alias("n"), F.min("size").alias("low_size"), F.max("size").alias("high_size"), F.min("number").alias("low"), F.max("number").alias("high"))
    found = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("none"), F.col("n"))), F.lit(0)).alias("nulls"), F.count("text").alias("distinct"),
        F.min("low_size").cast("long").alias("len_min"), F.max("high_size").cast("long").alias("len_max"), F.min("low").alias("value_min"), F.max("high").alias("value_max"),
    )
    names = df.sparkSession.range(1).select(F.inline(F.array(*kinds)))
    out = names.join(found, "column", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    distinct = F.when(F.col("kind") != "dict", F.coalesce("distinct", F.lit(0))).alias("distinct")
    return out.select("column", "kind", number("rows"), number("nulls"), distinct, "len_min", "len_max", "value_min", "value_max")


def not_null_columns(df: DataFrame) -> DataFrame:
    return profile_columns(df).where(F.col("nulls") == 0).select("column")


def unique_columns(df: DataFrame) -> DataFrame:
    """Columns in which every value, null taken as one, stands once."""
    return profile_columns(df).where(F.col("distinct") + F.when(F.col("nulls") > 0, 1).otherwise(0) == F.col("rows")).select("column")


def json_kind(v: Column) -> Column:
    """The kind of a variant: null, bool, int, float, str, array or object."""
    return _kind_of_type(v, F.schema_of_variant(v))


def _kind_of_type(v: Column, s: Column) -> Column:
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(s == "STRING", "str").when(F.startswith(s, F.lit("ARRAY")), "array").when(F.startswith(s, F.lit("OBJECT")), "object").otherwise("unknown")
    )


def merged_kind(kinds: Column) -> Column:
    """One kind from the set of kinds seen (without null): int with float is float, any other mixture unknown."""
    known = F.array_remove(kinds, "null")
    return F.when(F.size(known) == 0, "null").when(F.size(known) == 1, F.get(known, F.lit(0))).when((F.size(F.array_except(known, F.array(F.lit("int"), F.lit("float")))) == 0), "float").otherwise("unknown")


def path_level(values: DataFrame) -> DataFrame:
    """``(api, path, v)`` -> a profile row per ``(api, path)``."""
    kind = json_kind(F.col("v"))
    size = F.when(kind == "str", F.length(F.col("v").cast("string"))).when(kind == "array", F.array_size(F.expr("try_cast(v as array<variant>)"))).cast("long")
    number = F.when(kind.isin("int", "float"), F.expr("try_cast(v as double)"))
    text = F.to_json("v")
    own = values.select("api", "path", kind.alias("kind"), size.alias("size"), number.alias("number"), text.alias("text"))
    return own.groupBy("api", "path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("rows"), F.count_if(F.col("kind") == "null").alias("nulls"), F.count_distinct(F.when(F.col("kind") != "null", F.col("text"))).alias("distinct"),
        F.min("size").alias("len_min"), F.max("size").alias("len_max"), F.min("number").alias("value_min"), F.max("number").alias("value_max"),
    ).withColumn("kind", merged_kind(F.col("kinds")))


def object_keys(values: DataFrame) -> DataFrame:
    """Per ``(api, path)`` of objects: its keys, in how many objects each stands, and how many objects there are."""
    objects = values.select("api", "path", F.from_json(F.to_json("v"), "map<string,variant>").alias("m"))
    total = objects.groupBy("api", "path").agg(F.count("*").alias("objects"))
    keys = objects.select("api", "path", F.explode("m").alias("key", "x")).groupBy("api", "path", "key").agg(F.count("*").alias("n"))
    return keys.join(total, ["api", "path"])


def object_or_map(keys: DataFrame, *, max_optional: int = MAX_OPTIONAL, max_keys: int = MAX_KEYS) -> DataFrame:
    """Whether the objects of a path are records or maps: a map has too many optional keys or keys."""
    optional = F.count_if(F.col("n") < F.col("objects"))
    out = keys.groupBy("api", "path").agg(F.count("*").alias("keys"), optional.alias("optional"))
    return out.withColumn("kind", F.when((F.col("optional") > max_optional) | (F.col("keys") > max_keys), "dict").otherwise("object"))


STEPS = "array<struct<kind: string, key: string>>"
NODE_SCHEMA = f"api string, steps {STEPS}, kind string, size long, number double, text string, n long"
#: Different nodes that a task counts before it passes them on; values longer than this stand by their digest.
NODES_HELD, LONG_TEXT = 100_000, 32


class NodeCounts:
    """Nodes of JSON values, counted by path, kind and value: a buffer that is passed on when it is full and added up by Spark."""

    def __init__(self):
        self.paths: list[tuple[int, str, str, str]] = []  # parent, kind, key, api
        self.known: dict[tuple[int, str, str, str], int] = {}
        self.counts: dict[tuple, int] = {}

    def path(self, parent: int, kind: str, key: str, api: str) -> int:
        step = (parent, kind, key, api)
        if (at := self.known.get(step)) is None:
            at = self.known[step] = len(self.paths)
            self.paths.append(step)
        return at

    def add(self, api: str, text: str | None) -> None:
        root = self.path(-1, "", "", api)
        self._walk(root, api, None if text is None else json.loads(text, parse_float=lambda f: (f,)))

    def _walk(self, at: int, api: str, value) -> str:
        """Counts a value and all below it; gives its text, in which fields are in the order of the value."""
        size = number = None
        if isinstance(value, dict):
            kind, text = "object", "{" + ",".join([f"{k!r}:{self._walk(self.path(at, 'field', k, api), api, v)}" for k, v in value.items()])
        elif isinstance(value, list):
            kind, size = "array", len(value)
            below = self.path(at, "item", "", api) if value else at
            text = "[" + ",".join([self._walk(below, api, v) for v in value])
        elif isinstance(value, str):
            kind, size, text = "str", len(value), repr(value)
        elif value is None:
            kind, text = "null", "null"
        elif isinstance(value, bool):
            kind, text = "bool", str(value)
        elif isinstance(value, int):
            kind, text, number = "int", str(value), float(value)
        else:
            kind, text, number = "float", value[0], float(value[0])
        if len(text) > LONG_TEXT:
            text = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
        key = (at, kind, size, number, text)
        self.counts[key] = self.counts.get(key, 0) + 1
        return text

    def steps(self, at: int) -> list[dict[str, str]]:
        out = []
        while (step := self.paths[at])[0] >= 0:
            out.append({"kind": step[1], "key": step[2]})
            at = step[0]
        return out[::-1]

    def batch(self) -> pa.RecordBatch:
        steps = {at: self.steps(at) for at in {k[0] for k in self.counts}}
        rows = [(self.paths[k[0]][3], steps[k[0]], *k[1:], n) for k, n in self.counts.items()]
        kinds = [pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())])), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["api", "steps", "kind", "size", "number", "text", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # values nest as deep as Spark reads them
    held = NodeCounts()
    for batch in batches:
        for api, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.add(api, text)
            if len(held.counts) > NODES_HELD:
                yield held.batch()
                held = NodeCounts()
    yield held.batch()


def counted_nodes(calls: DataFrame) -> DataFrame:
    """``calls(api, v variant)`` -> their values' nodes by path, kind and value, with how many there are.

    Functions on variants would do, but took three times as long, and made every node a row before it is counted.
    """
    parts = calls.select(F.col("api").cast("string"), F.to_json("v")).mapInArrow(_counted, NODE_SCHEMA)
    return parts.groupBy("api", "steps", "kind", "size", "number", "text").agg(F.sum("n").alias("n"))


def _last(steps: str = "steps") -> Column:
    return F.try_element_at(steps, F.lit(-1))["kind"]


def _above() -> Column:
    return F.when(F.size("steps") > 0, F.expr("slice(steps, 1, size(steps) - 1)"))


def _maps(paths: DataFrame, max_optional: int, max_keys: int) -> DataFrame:
    """``(api, steps, rows, objects)`` -> paths of maps that still have fields: too many, too many optional, or beside values already taken together."""
    below = paths.where(_last().isin("field", "value")).select("api", _above().alias("steps"), (_last() == "field").alias("field"), "rows")
    both = below.join(paths.select("api", "steps", "objects"), ["api", "steps"])
    out = both.groupBy("api", "steps").agg(F.count_if("field").alias("keys"), F.count_if(F.col("field") & (F.col("rows") < F.col("objects"))).alias("optional"), F.bool_and("field").alias("record"))
    return out.where((F.col("keys") > 0) & ((F.col("optional") > max_optional) | (F.col("keys") > max_keys) | ~F.col("record"))).select("api", "steps")


def _pooled(paths: DataFrame, maps: DataFrame) -> DataFrame:
    """``(api, raw, steps)`` with the keys below maps taken together: the steps after one are of kind ``value``."""
    each = paths.select("api", "raw", "steps", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("steps"), F.lit(1)))).alias("at"))
    prefix = each.withColumn("above", F.expr("slice(steps, 1, at - 1)"))
    flagged = maps.select("api", F.col("steps").alias("above"), F.lit(True).alias("is_map"))
    steps = F.array_sort(F.collect_list(F.struct("at", F.coalesce("is_map", F.lit(False)).alias("is_map"))))
    marks = prefix.join(flagged, ["api", "above"], "left").groupBy("api", "raw", "steps").agg(steps.alias("marks"))
    pooled = F.transform("steps", lambda s, k: F.when(F.get(F.col("marks"), k)["is_map"] & (s["kind"] == "field"), F.struct(F.lit("value").alias("kind"), F.lit("").alias("key"))).otherwise(s))
    return marks.select("api", "raw", pooled.cast(STEPS).alias("steps"))


def path_text(steps: Column) -> Column:
    """Steps as ``$.field``, ``[]`` for items and ``{}`` for values of a map; a key that could be read otherwise is quoted."""
    quoted = lambda k: F.when(k.rlike(r"^[^.\[\]{}\"$]+$"), k).otherwise(F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.when(s["kind"] == "item", "[]").when(s["kind"] == "value", "{}").otherwise(F.concat(F.lit("."), quoted(s["key"])))), ""))


def api_schemas(calls: DataFrame, *, max_optional: int = MAX_OPTIONAL, max_keys: int = MAX_KEYS) -> DataFrame:
    """``calls(api, v variant)`` -> a profile row for every path of each API's values, however deep.

    ``path.k`` is a field of a record, ``path{}`` any value of a map, ``path[]`` any element of an array; ``steps`` is the path
    as ``array<struct<kind, key>>``, so keys that hold such marks stay apart, and ``always_exists`` tells of a field whether
    every record has it.  The values are read once: all their nodes are counted by path, and what is a map is then decided
    on the paths.  Taking the values of a map together only adds keys to what is below, so a path that is a map by itself
    stays one, and it is repeated until no more are found.
    """
    nodes = cut(counted_nodes(calls))
    counted = nodes.groupBy("api", "steps").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("kind") == "object", F.col("n")).otherwise(0)).alias("objects"))
    raw, any_map = cut(counted.withColumn("raw", F.col("steps"))), False
    while True:
        paths = raw.groupBy("api", "steps").agg(F.sum("rows").alias("rows"), F.sum("objects").alias("objects"))
        maps = cut(_maps(paths, max_optional, max_keys))
        if maps.isEmpty():
            break
        raw, any_map = cut(raw.drop("steps").join(_pooled(raw.select("api", "raw", "steps"), maps), ["api", "raw"])), True
    own = nodes.withColumnRenamed("steps", "raw")
    own = own.join(raw.select("api", "raw", "steps"), ["api", "raw"]) if any_map else own.withColumnRenamed("raw", "steps")
    zero = F.lit(0)
    level = own.groupBy("api", "steps").agg(
        F.collect_set("kind").alias("kinds"), F.sum("n").alias("rows"), F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(zero)).alias("nulls"), F.count_distinct(F.when(F.col("kind") != "null", F.struct("kind", "text"))).alias("distinct"),
        F.min("size").alias("len_min"), F.max("size").alias("len_max"), F.min("number").alias("value_min"), F.max("number").alias("value_max"),
    ).withColumn("kind", merged_kind(F.array_sort("kinds")))
    out = level.withColumn("above", _above()).join(paths.select("api", F.col("steps").alias("above"), "objects"), ["api", "above"], "left")
    values = paths.where(_last() == "value").select("api", _above().alias("steps"), F.lit(True).alias("is_map"))
    out = out.join(values, ["api", "steps"], "left")
    kind = F.when((F.col("kind") == "object") & F.col("is_map"), "dict").otherwise(F.col("kind"))
    always = F.when(_last() == "field", F.col("rows") == F.col("objects"))
    return out.select("api", path_text(F.col("steps")).alias("path"), "rows", "nulls", "distinct", "len_min", "len_max", "value_min", "value_max", kind.alias("kind"), always.alias("always_exists"), "steps")


def schema_diff(left: DataFrame, right: DataFrame, columns: list[str], *, on: str = "column") -> DataFrame:
    """Paths that are in one profile only, or differ in one of the columns (``kind`` alone is the soft comparison)."""
    a = left.select(F.col(on).alias("_l"), *[F.col(c).alias(f"left_{c}") for c in columns])
    b = right.select(F.col(on).alias("_r"), *[F.col(c).alias(f"right_{c}") for c in columns])
    both = a.join(b, F.col("_l") == F.col("_r"), "full")
    differs = F.col("_l").isNull() | F.col("_r").isNull()
    for c in columns:
        differs = differs | ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    what = F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only").otherwise("differs")
    return both.where(differs).select(F.coalesce("_l", "_r").alias(on), what.alias("difference"))


def api_fields(calls: DataFrame, *, column: str = "response") -> DataFrame:
    """The sorted union of a JSON column's keys per API; a value that is no object counts as ``__str__``."""
    keys = F.coalesce(F.json_object_keys(column), F.array(F.lit("__str__")))
    pairs = calls.where(F.col(column).isNotNull()).select("api", F.explode(keys).alias("key")).distinct()
    return pairs.groupBy("api").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("fields"))


def loaded(text: str):
    """The value of JSON text; text that is none, or nests deeper than Python reads, is a string."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def _per_text(texts: Iterator[pd.Series], make) -> Iterator[pd.Series]:
    """``make`` of each text's value as JSON text; nulls stay, and a value too deep for Python to walk gives ``"str"``."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

    def one(text: str) -> str:
        try:
            return json.dumps(make(loaded(text)), separators=(",", ":"), ensure_ascii=False)
        except RecursionError:
            return '"str"'

    for batch in texts:
        yield pd.Series([None if t is None else one(t) for t in batch], dtype=object)


def shape_of(value) -> object:
    """The shape of a JSON value: leaves as kinds, lists as their longest element and, where there are more, a mark."""
    if isinstance(value, dict):
        return {k: shape_of(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        inner = sorted((json.dumps(shape_of(v), sort_keys=True) for v in value), key=lambda s: (-len(s), s))
        return [json.loads(s) for s in inner] if len(inner) < 2 else [json.loads(inner[0]), "extra"]
    return "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "str"


@F.pandas_udf(StringType())
def shape_signature(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The shape of JSON of any depth, as text; text that is no JSON has the shape of a string.

    Needs Python: JSON without a bound on its depth has no Spark type.
    """
    yield from _per_text(texts, shape_of)


#: What stands for the items left out of a list: a fixed value of the format.
EXTRA = "<extra list items . . .>"


def trim_of(value, most: int):
    """A JSON value without null keys, its lists cut to ``most`` items and a mark; lists are not gone into."""
    if isinstance(value, dict):
        return {k: trim_of(v, most) for k, v in value.items() if v is not None}
    return [*value[:most], EXTRA] if isinstance(value, list) and len(value) > most else value


def trimmed_json(text: Column, most: int = 3) -> Column:
    """JSON of any depth trimmed for display; needs Python, as ``shape_signature``.  Text that is no JSON becomes a JSON string."""

    @F.pandas_udf(StringType())
    def trim(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _per_text(texts, lambda value: trim_of(value, most))

    return trim(text)


def schema_view(paths: DataFrame) -> DataFrame:
    """Placeholders for prompts: per API and path of ``api_schemas`` ``<some kind value>``; arguments that carry headers are left out.

    Only leaves have a row, one per path, so the view is as small as the schema.
    """
    header = F.concat(F.lit(r"^\$\.arguments\.("), F.lit("|".join(HEADER_ARGUMENTS)), F.lit(r")(\.|\[|\{|$)"))
    own = paths.where(~F.regexp_like("path", header) & ~F.col("kind").isin("object", "dict", "array"))
    return own.select("api", "path", F.when(F.col("kind") == "null", "null").otherwise(F.concat(F.lit("<some "), F.col("kind"), F.lit(" value>"))).alias("placeholder"))


def flat_signature(text: Column) -> Column:
    """The shape of a flat JSON object, with built-in functions: ``key:kind`` in key order."""
    fields = F.map_entries(F.from_json(text, "map<string,variant>"))
    return F.array_join(F.transform(F.array_sort(F.transform(fields, lambda e: F.struct(e["key"].alias("k"), json_kind(e["value"]).alias("t")))), lambda e: F.concat_ws(":", e["k"], e["t"])), ",")


def shape_groups(calls: DataFrame, signature: Column) -> DataFrame:
    return calls.groupBy("api", signature.alias("signature")).agg(F.count("*").alias("n_calls"), F.min("seq").alias("first_seq"))


def shape_topk(groups: DataFrame, k: int) -> DataFrame:
    """The k longest shapes of each API."""
    order = Window.partitionBy("api").orderBy(F.desc(F.length("signature")), "signature")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def eligible_apis(calls: DataFrame, focal: DataFrame, *, least: int = 5) -> DataFrame:
    """APIs of the focal list with enough calls."""
    return calls.groupBy("api").agg(F.count("*").alias("n_calls")).where(F.col("n_calls") >= least).join(focal.select("api").distinct(), "api", "left_semi")


def related_names(enriched: DataFrame, column: str) -> DataFrame:
    """The names in a map of related rows or calls, per API."""
    pairs = enriched.select("api", F.explode(F.map_keys(column)).alias("name")).distinct()
    return pairs.groupBy("api").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
