"""Expansion of nested columns into derived columns, in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import nested


@dataclass(frozen=True)
class Expanded:
    """A derived column: its name, the column it comes from and the steps."""

    name: str
    original: str
    steps: tuple[str, ...]
    uniform: bool = False


def expand_table(df: DataFrame, *, array_max: int = 0, lengths: bool = False, flatten: bool = False, keys: bool = False) -> tuple[DataFrame, list[Expanded]]:
    """Adds derived columns by the schema, recursively; ``array_max`` elements of every array, where over 0.

    Struct fields and fields of array elements are always derived, the rest where asked for.
    """
    out: list[tuple[Column, Expanded]] = []

    def add(c: Column, kind: DataType, name: str, origin: str, steps: tuple[str, ...], in_array: bool) -> None:
        out.append((c, Expanded(name, origin, steps, in_array)))
        grow(c, kind, name, origin, steps, in_array)

    def grow(c: Column, kind: DataType, name: str, origin: str, steps: tuple[str, ...], in_array: bool) -> None:
        if isinstance(kind, StructType):
            for f in kind:
                add(c[f.name], f.dataType, f"{name}.{f.name}", origin, (*steps, f".{f.name}"), in_array)
        elif isinstance(kind, MapType) and keys:
            add(F.map_keys(c), ArrayType(kind.keyType), f"{name}#key", origin, (*steps, "#key"), in_array)
            add(F.map_values(c), ArrayType(kind.valueType), f"{name}#value", origin, (*steps, "#value"), in_array)
        elif isinstance(kind, ArrayType):
            if lengths:
                out.append((F.array_size(c), Expanded(f"{name}#length", origin, (*steps, "#length"))))
            for i in range(array_max):
                add(F.get(c, F.lit(i)), kind.elementType, f"{name}[{i}]", origin, (*steps, f"[{i}]"), in_array)
            if isinstance(kind.elementType, StructType):
                for f in kind.elementType:
                    add(nested.array_field(c, f.name), ArrayType(f.dataType), f"{name}[].{f.name}", origin, (*steps, f"[].{f.name}"), True)
            elif isinstance(kind.elementType, ArrayType) and flatten:
                add(nested.array_flatten(c), kind.elementType, f"{name}#flatten", origin, (*steps, "#flatten"), True)
            elif isinstance(kind.elementType, MapType) and keys:
                add(nested.array_dict_key(c), ArrayType(ArrayType(kind.elementType.keyType)), f"{name}[]#key", origin, (*steps, "[]#key"), True)
                add(nested.array_dict_value(c), ArrayType(ArrayType(kind.elementType.valueType)), f"{name}[]#value", origin, (*steps, "[]#value"), True)

    for f in df.schema:
        grow(F.col(f"`{f.name}`"), f.dataType, f.name, f.name, (), False)
    return df.select("*", *[c.alias(e.name) for c, e in out]), [e for _, e in out]


def compress_uniform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Array columns of which every row has one distinct element at most become scalars, without ``[]`` in the name.

    One pass of one aggregate decides all columns.
    """
    tests = [F.coalesce(F.bool_and(F.coalesce(F.size(F.array_distinct(f"`{c}`")), F.lit(0)) <= 1), F.lit(True)).alias(f"c{k}") for k, c in enumerate(columns)]
    verdict = df.agg(*tests).first() if columns else []
    uniform = {c for k, c in enumerate(columns) if verdict[k]}
    return df.select(*[(F.get(F.col(f"`{c}`"), F.lit(0)).alias(c.replace("[]", "")) if c in uniform else F.col(f"`{c}`")) for c in df.columns])
