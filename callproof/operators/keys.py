"""Keys and relations found from values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .lineage import cut
from .profile import kind_of

#: Columns that carry no keys.
EXCLUDED = r"(?i)header|#length|#exists|^time$|response_time"


def column_values(tables: dict[str, DataFrame], *, kinds: tuple[str, ...] = ("str", "int")) -> DataFrame:
    """``(table, column, kind, value)``, distinct, of all candidate columns: each table is read once, unpivoted."""
    out = None
    for name, df in tables.items():
        pairs = []
        for f in df.schema:
            inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            if kind_of(inner) in kinds:
                value = F.col(f"`{f.name}`")
                values = F.transform(value, lambda x: x.cast("string")) if isinstance(f.dataType, ArrayType) else F.array(value.cast("string"))
                pairs.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind_of(inner)).alias("kind"), values.alias("values")))
        if not pairs:
            continue
        own = df.select(F.inline(F.array(*pairs))).select(F.lit(name).alias("table"), "column", "kind", F.explode("values").alias("value")).where(F.col("value").isNotNull()).distinct()
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no table has a candidate column")
    return out


def candidates(columns: DataFrame) -> DataFrame:
    """``columns(table, column, kind)`` that can be part of a relation; log tables give no target."""
    own = columns.where(F.col("kind").isin("str", "int") & ~F.col("column").rlike(EXCLUDED))
    return own.withColumn("can_be_target", ~F.startswith("table", F.lit("log::")))


#: Values of a column in its sketch, about, and the least number of its values that a pair is judged by.
SKETCH, JUDGED = 4096, 256


def sketches(values: DataFrame, size: int = SKETCH) -> DataFrame:
    """``values`` of each column below a threshold of their hash, some ``size`` of them, with ``n`` and ``level``: ``2 ** level`` values stand for one.

    Thresholds are powers of two of one hash, so what two sketches share is the sketch of what the columns share.
    """
    sizes = values.groupBy("table", "column", "kind").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(size)))).cast("int"))
    own = values.join(F.broadcast(sizes), ["table", "column", "kind"])  # a row per column
    return own.where(F.pmod(F.xxhash64("kind", "value"), F.expr("shiftleft(1L, level)")) == 0)


def _sides(values: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    side = lambda end: values.select(F.col("table").alias(f"{end}_table"), F.col("column").alias(f"{end}_column"), "kind", *[F.col(c) if c == "value" else F.col(c).alias(f"{end}_{c}") for c in more])
    return side("from"), side("to")


PAIR = ["from_table", "from_column", "to_table", "to_column"]


def likely_pairs(values: DataFrame, threshold: float, *, size: int = SKETCH) -> DataFrame:
    """Ordered pairs of columns of one kind that may share more than ``threshold`` of the first's values.

    ``from_table, from_column, to_table, to_column, values, shared, exact``: where both columns are whole in their sketches
    ``shared`` is exact.  Else a pair goes only if the second is too small, or if of ``JUDGED`` values or more that the
    sketches should share fewer than a quarter of the threshold are there: at a threshold of 0.2 that happens to a pair above it less than
    once in 10^10.
    """
    own = sketches(values, size)
    a, b = _sides(own, "value")
    differ = (F.col("from_table") != F.col("to_table")) | (F.col("from_column") != F.col("to_column"))
    common = a.join(b, ["kind", "value"]).where(differ).groupBy(*PAIR).agg(F.count("*").alias("shared"))
    left, right = _sides(own.select("table", "column", "kind", "n", "level").distinct(), "n", "level")
    pairs = left.join(right, "kind").where(differ).join(common, PAIR, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))  # columns with columns
    level = F.greatest("from_level", "to_level")
    expected = F.col("from_n") / F.expr("shiftleft(1L, greatest(from_level, to_level))")
    hopeless = (F.col("to_n") < threshold * F.col("from_n")) | ((expected >= JUDGED) & (F.col("shared") < threshold * expected / 4)) | ((level == 0) & (F.col("shared") == 0))
    return pairs.where(~hopeless).select(*PAIR, F.col("from_n").alias("values"), "shared", (level == 0).alias("exact"))


def shared_values(values: DataFrame, related: DataFrame | None = None, *, threshold: float = 0.0) -> DataFrame:
    """For ordered pairs of columns of one kind that share more than ``threshold``: how many ``values`` the first has, and how many are ``shared``.

    Sketches of the columns come first: they settle small columns, and drop pairs of large ones that have no hope.  What
    is left is met by one join on ``(kind, value)`` of the columns concerned.  ``related(from_table, to_table)`` restricts the pairs.
    """
    values = cut(values)
    pairs = likely_pairs(values, threshold)
    if related is not None:
        pairs = pairs.join(related.select("from_table", "to_table").distinct(), ["from_table", "to_table"], "left_semi")
    pairs = cut(pairs)  # a row per pair of columns
    large = pairs.where(~F.col("exact")).select(*PAIR, "values")
    settled = pairs.where("exact").select(*PAIR, "shared", "values")
    if large.isEmpty():
        return settled
    a, b = _sides(values, "value")
    a, b = a.join(F.broadcast(large.select("from_table", "from_column").distinct()), ["from_table", "from_column"], "left_semi"), b.join(F.broadcast(large.select("to_table", "to_column").distinct()), ["to_table", "to_column"], "left_semi")
    met = a.join(b, ["kind", "value"]).join(F.broadcast(large), PAIR)
    return settled.unionByName(met.groupBy(*PAIR, "values").agg(F.count("*").alias("shared")))


def fk_overlap(values: DataFrame, related: DataFrame | None = None, *, threshold: float = 0.2) -> DataFrame:
    """Column pairs of different tables where more than ``threshold`` of the first's values are in the second."""
    pairs = shared_values(values, related, threshold=threshold).where((F.col("from_table") != F.col("to_table")) & ~F.startswith("to_table", F.lit("log::")))
    return pairs.withColumn("ratio", F.col("shared") / F.col("values")).where(F.col("ratio") > threshold)


def inclusion_deps(values: DataFrame) -> DataFrame:
    """Ordered column pairs where every value of the first is in the second."""
    return shared_values(values, threshold=1.0).where(F.col("shared") == F.col("values")).select(*PAIR)


def by_source(pairs: DataFrame) -> DataFrame:
    """The targets of each source column, for a later choice."""
    target = F.concat_ws(".", "to_table", "to_column")
    return pairs.groupBy("from_table", "from_column").agg(F.array_join(F.array_sort(F.collect_list(target)), ",").alias("targets"))


def pair_cardinality(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How a key relates to each column: ``one_to_one``, ``one_to_many``, ``many_to_one`` or ``many_to_many``.

    Arrays are exploded and nulls skipped; all columns go through the same two groupings.
    """
    def parts(name: str):
        c = F.col(f"`{name}`")
        return F.transform(c, lambda x: x.cast("string")) if isinstance(df.schema[name].dataType, ArrayType) else F.array(c.cast("string"))

    rows = df.select(parts(key).alias("k"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), parts(c).alias("v")) for c in columns])))
    pairs = rows.select("column", F.explode("k").alias("k"), "v").select("column", "k", F.explode("v").alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull()).distinct()
    fan_out = pairs.groupBy("column", "k").agg(F.count("*").alias("n")).groupBy("column").agg(F.max("n").alias("out"))
    fan_in = pairs.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg(F.max("n").alias("into"))
    kind = F.concat(F.when(F.col("into") > 1, "many").otherwise("one"), F.lit("_to_"), F.when(F.col("out") > 1, "many").otherwise("one"))
    return fan_out.join(fan_in, "column").select("column", kind.alias("cardinality"))


def joinable_keys(tables: dict[str, DataFrame], keys: list[tuple[str, str]]) -> DataFrame:
    """Which ``(table, column)`` can be the right side of a join: not empty and without repeats."""
    out = None
    for name, column in keys:
        c = F.col(f"`{column}`")
        own = tables[name].agg(F.count(c).alias("n"), F.count_distinct(c).alias("d")).select(F.lit(name).alias("table"), F.lit(column).alias("column"), ((F.col("n") > 0) & (F.col("n") == F.col("d"))).alias("joinable"))
        out = own if out is None else out.unionByName(own)
    return out
