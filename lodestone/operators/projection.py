"""Declared rows: a schema compiled to one projection, whatever columns a table happens to have.

Every field of the schema comes from an expression given for it, else from the column of its name, else it is null. Types are checked when the plan is
made: numbers may widen, anything scalar may become text, structs and arrays of structs are taken field by field (missing fields null, others dropped),
nested values become JSON where text is declared; anything else raises a ValueError that names the field. Fields that must not be null are checked by
row: violations() returns the rows that break the schema, with the names of the fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDER = {"tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def _fitted(value: str, have: T.DataType, want: T.DataType, path: str, depth: int = 0) -> str:
    """An expression of type `want` for an expression of type `have`."""
    a, b = have.simpleString(), want.simpleString()
    if a == b:
        return value
    if isinstance(have, T.NullType):
        return f"cast(NULL AS {b})"
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        kinds = {f.name: f.dataType for f in have}
        parts = [f"'{f.name}', " + (_fitted(f"{value}.`{f.name}`", kinds[f.name], f.dataType, f"{path}.{f.name}", depth) if f.name in kinds else f"cast(NULL AS {f.dataType.simpleString()})") for f in want]
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        item = f"x{depth}_"
        return f"transform({value}, {item} -> {_fitted(item, have.elementType, want.elementType, path + '[]', depth + 1)})"
    if isinstance(want, T.StringType):
        return f"to_json({value})" if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) else f"cast({value} AS string)"
    if _WIDER.get(a, 9) <= _WIDER.get(b, 0) or {a, b} <= {"date", "timestamp", "timestamp_ntz"}:
        return f"cast({value} AS {b})"
    if a == "bigint" and b == "int":
        return f"try_cast({value} AS int)"
    raise ValueError(f"{path}: {a} is there, {b} is declared")


def project(df: DataFrame, schema: str, given: dict[str, str] | None = None) -> DataFrame:
    """df as rows of the schema (column definitions as text). given: SQL expressions by field, over the columns of df."""
    want, given = T.StructType.fromDDL(schema), given or {}
    if unknown := set(given) - set(want.names):
        raise ValueError(f"not in the schema: {', '.join(sorted(unknown))}")
    sources = {f.name: given.get(f.name, f"`{f.name}`" if f.name in df.columns else "NULL") for f in want}
    inner = df.select(*(F.expr(e).alias(f"{n}") for n, e in sources.items()))
    return inner.select(*(F.expr(_fitted(f"`{f.name}`", inner.schema[f.name].dataType, f.dataType, f.name)).alias(f.name) for f in want))


def violations(rows: DataFrame, required: list[str], closed: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows with a null in a required field or a value outside a closed set, and the fields in column `broken`."""
    tests = {c: F.col(c).isNull() for c in required} | {}
    for c, values in (closed or {}).items():
        if c in rows.columns:
            outside = F.col(c).isNotNull() & ~F.col(c).isin(values)
            tests[c] = tests[c] | outside if c in tests else outside
    broken = F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in tests.items())), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def nested(df: DataFrame, fields: dict[str, str]) -> str:
    """A struct of fields for JSON evidence: expressions by name; fields whose columns df lacks are null text."""
    parts = [f"'{n}', {e if not e.isidentifier() or e in df.columns else 'cast(NULL AS string)'}" for n, e in fields.items()]
    return f"named_struct({', '.join(parts)})"
