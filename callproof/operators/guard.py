"""Conditions whose errors stay with the row that has them.

Spark ends a job at the first error in an expression, and only some functions have a ``try_`` form.  Here a condition is taken
as it is, in the session's own mode, and evaluated as ``attempt(c)``: a struct of its value, or null where it raised.  What
raised is then found from the inside out, so the message tells the error's class and the part of the condition that has it.

Functions that build maps keep what they built when they raise, and would mix it into later rows; a test of their keys is put
before each of them.  Conditions are read as the expressions that their columns stand for, which a plain (not a remote) session
has on the driver; SQL text (``expr``) is read the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions that never raise, whatever their arguments; casts are looked at by themselves.
SURE = {
    "Alias", "And", "AttributeReference", "CaseWhen", "Coalesce", "Contains", "CreateNamedStruct", "EndsWith", "EqualNullSafe", "EqualTo", "GetStructField", "GreaterThan", "GreaterThanOrEqual",
    "If", "In", "InSet", "IsNaN", "IsNotNull", "IsNull", "Length", "LessThan", "LessThanOrEqual", "Literal", "Lower", "Not", "Or", "StartsWith", "StringTrim", "Upper",
}
#: Functions by the class of the error that they raise, as Spark names it.
RAISES = {
    "ARITHMETIC_OVERFLOW": ("+", "-", "*", "add", "subtract", "multiply", "negative", "abs"), "DIVIDE_BY_ZERO": ("/", "div", "divide", "integraldivide"),
    "REMAINDER_BY_ZERO": ("%", "mod", "pmod", "remainder"), "INVALID_FORMAT": ("to_number",), "MALFORMED_RECORD_IN_PARSING": ("parse_json",),
    "CAST_INVALID_INPUT": ("cast", "=", "==", "<=>", "<", ">", "<=", ">=", "in", "equalto", "lessthan", "greaterthan", "lessthanorequal", "greaterthanorequal", "equalnullsafe"),
    "INVALID_ARRAY_INDEX": ("unresolvedextractvalue",), "CANNOT_PARSE_TIMESTAMP": ("to_date", "to_timestamp", "unix_timestamp"), "INVALID_ARRAY_INDEX_IN_ELEMENT_AT": ("element_at",),
}
CLASS_OF = {name: kind for kind, names in RAISES.items() for name in names}


class _Jvm:
    """The classes used, looked up once for a context."""

    def __init__(self, context: SparkContext):
        jvm = context._jvm
        expressions = jvm.org.apache.spark.sql.catalyst.expressions
        self.to_column = jvm.org.apache.spark.sql.classic.ExpressionUtils.column
        self.to_seq = jvm.PythonUtils.toSeq
        self.tries, self.is_null, self.struct, self.up_cast = expressions.TryEval, expressions.IsNull, expressions.CreateNamedStruct, expressions.Cast.canUpCast
        self.column = type(F.lit(0))
        self.label = SparkSession.active()._jsparkSession.expression(F.lit("value")._jc)


@lru_cache(maxsize=1)
def _jvm_of(context: SparkContext) -> _Jvm:
    return _Jvm(context)


def _jvm() -> _Jvm:
    return _jvm_of(SparkContext._active_spark_context)


def _column(expression) -> Column:
    return _jvm().column(_jvm().to_column(expression))


def _expression(c: Column):
    return SparkSession.active()._jsparkSession.expression(c._jc)


def _tried(expression):
    """A struct of the value, or null where it raises."""
    return _jvm().tries(_jvm().struct(_jvm().to_seq([_jvm().label, expression])))


def _children(expression) -> list:
    seq = expression.children()
    return [seq.apply(k) for k in range(seq.size())]


def _name(expression) -> str:
    kind = expression.getClass().getSimpleName()
    return (expression.nameParts().last() if kind == "UnresolvedFunction" else kind).lower()


def attempt(c: Column) -> Column:
    """``struct<value>`` with the value of ``c``, which may be null; null where ``c`` raises.

    It is evaluated inside a lambda function, out of which Spark moves no common part: one that raises would end the job.
    """
    tried = _column(_tried(_expression(c)))
    return F.get(F.transform(F.array(F.lit(0)), lambda _: tried), F.lit(0))


def _map_keys(name: str, arguments: list[Column], rows: DataFrame | None) -> Column | None:
    """The keys that a function puts into its map; None for functions that build none."""
    if name == "map":
        return F.array(*arguments[::2])
    if name == "map_from_arrays":
        return arguments[0]
    if name == "map_concat":
        return F.flatten(F.array(*map(F.map_keys, arguments)))
    if name == "str_to_map":
        between, inside = [*arguments[1:], *(F.lit(","), F.lit(":"))[len(arguments) - 1 :]]
        return F.transform(F.split(arguments[0], between), lambda part: F.get(F.split(part, inside, 2), F.lit(0)))
    if name == "map_from_entries" and rows is not None:
        key = rows.select(arguments[0].alias("c")).schema["c"].dataType.elementType.names[0]
        return F.transform(arguments[0], lambda e: e[key])
    if name in ("transform_keys", "map_from_entries"):
        raise ValueError(f"a condition with {name} cannot be guarded")
    return None


def _checked(expression, rows: DataFrame | None):
    """The same expression with a test of the keys before each function that builds a map."""
    before = _children(expression)
    after = [_checked(k, rows) for k in before]
    if any(a is not b for a, b in zip(after, before, strict=True)):
        expression = expression.withNewChildren(_jvm().to_seq(after))
    if expression.getClass().getSimpleName() == "UnresolvedFunction" and (keys := _map_keys(_name(expression), [*map(_column, after)], rows)) is not None:
        repeated = F.size(F.array_distinct(keys)) != F.size(keys)
        tests = F.when(repeated, F.raise_error(F.lit("[DUPLICATED_MAP_KEY]"))).when(F.exists(keys, lambda k: k.isNull()), F.raise_error(F.lit("[NULL_MAP_KEY]")))
        return _expression(tests.otherwise(_column(expression)))
    return expression


def _surely(expression) -> bool:
    name = expression.getClass().getSimpleName()
    if name == "Cast":
        if not _jvm().up_cast(expression.child().dataType(), expression.dataType()):
            return False
    elif name not in SURE:
        return False
    return all(map(_surely, _children(expression)))


def never_raises(rows: DataFrame, c: Column) -> bool:
    """Whether the condition, with the casts that Spark adds on these rows, has only parts that cannot raise."""
    plan = rows.select(c.alias("c"))._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "Project" and _surely(plan.projectList().apply(0))


def _known(name: str, expression, parts: list) -> Column:
    """Whether a part raises, given that its own parts do not: by a plain test where there is one, since errors are slow to raise."""
    if name == "cast":
        return _column(parts[0]).isNotNull() & _column(parts[0]).try_cast(expression.dataType().sql()).isNull()
    if CLASS_OF.get(name) in ("DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO"):
        return (_column(parts[0]).isNotNull() & (_column(parts[1]) == 0)) | _column(_jvm().is_null(_tried(expression)))
    return _column(_jvm().is_null(_tried(expression)))


def _blame(expression) -> Column | None:
    """The message of the first innermost part that raises; None for a part that cannot.  It is evaluated in a lambda function, as ``attempt``."""
    parts, name = _children(expression), _name(expression)
    if not parts or name == "lambdafunction":
        return None
    if CLASS_OF.get(name) == "CAST_INVALID_INPUT" and name != "cast" or name in ("and", "or", "not", "coalesce", "isnull", "isnotnull"):
        found = [b for b in map(_blame, parts) if b is not None]  # by themselves they raise in the casts that Spark adds
        return F.coalesce(*found) if found else None
    raised = _known(name, expression, parts)
    if name in ("casewhen", "if"):
        return F.when(raised, _blame_branches(parts))
    if name == "alias":
        return _blame(parts[0])
    if name == "raise_error":
        said = _column(parts[-1]).cast("string")
        text = F.when(F.startswith(said, F.lit("[")), said).otherwise(F.concat(F.lit("[USER_RAISED_EXCEPTION] "), F.coalesce(said, F.lit("null"))))
    else:
        text = F.lit(f"[{CLASS_OF.get(name, 'EXPRESSION_ERROR')}] {expression.sql()}")
        if name == "element_at":
            zero = _column(_tried(_expression(_column(parts[1]).cast("string"))))["value"] == "0"
            text = F.when(zero, F.lit(f"[INVALID_INDEX_OF_ZERO] {expression.sql()}")).otherwise(text)
    return F.coalesce(*[b for b in map(_blame, parts) if b is not None], F.when(raised, text))


def _blame_branches(parts: list) -> Column:
    """Of branches only those that are come to: up to the first condition that holds or raises."""
    none = F.lit(None).cast("string")
    said = lambda e: none if (b := _blame(e)) is None else b
    pairs, rest = len(parts) // 2, parts[-1] if len(parts) % 2 else None
    out = none if rest is None else said(rest)
    for k in reversed(range(pairs)):
        held = _column(_tried(parts[2 * k]))
        out = F.when(held.isNull(), said(parts[2 * k])).when(held["value"], said(parts[2 * k + 1])).otherwise(out)
    return out


def guarded(c: Column, result: Callable[[Column, Column], Column], rows: DataFrame | None = None) -> Column:
    """``result(value, error)``: the value of ``c`` and the text of its error, one of which is null.

    With ``rows``, a condition that cannot raise on them is evaluated as it stands, in generated code.
    """
    if rows is not None and never_raises(rows, c):
        return result(c, F.lit(None).cast("string"))
    safe = _checked(_expression(c), rows)
    found = _blame(safe)
    other = F.lit(f"[{CLASS_OF.get(_name(safe.child() if _name(safe) == 'cast' else safe), 'EXPRESSION_ERROR')}] {safe.sql()}")
    error = other if found is None else F.coalesce(found, other)
    return F.get(F.transform(F.array(attempt(_column(safe))), lambda a: result(a["value"], F.when(a.isNull(), error))), F.lit(0))
