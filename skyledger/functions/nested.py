"""Nested values of any type made safe for JSON and Parquet, as expressions that follow the type: no row leaves the JVM.

Non-finite numbers become null, bytes become text (UTF-8, else base 64), map keys become text in order, and struct members stand in order of
their names, at every depth. What was rewritten is counted by path, where ``[]`` stands for list items and ``{}`` for map values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.scalars import text_of_bytes
from skyledger.functions.timescale import is_finite

NESTED = (T.StructType, T.MapType, T.ArrayType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean(kind: T.DataType) -> bool:
    """Nothing of this type is ever rewritten."""
    if isinstance(kind, T.StructType):
        return kind.names == sorted(kind.names) and all(clean(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return clean(kind.elementType)
    return not isinstance(kind, (T.MapType, T.FloatType, T.DoubleType, T.BinaryType))


def by_key(entries: Column) -> Column:
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def safe(x: Column, kind: T.DataType) -> Column:
    """The value without what JSON can't hold; null stays null."""
    if clean(kind):
        return x
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(is_finite(x), x)
    if isinstance(kind, T.BinaryType):
        return text_of_bytes(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: safe(y, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].cast("string").alias("key"), safe(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(by_key(F.transform(F.map_entries(x), entry)))
    members = sorted(kind.fields, key=lambda f: f.name)
    return F.when(x.isNotNull(), F.struct(*(safe(x[f.name], f.dataType).alias(f.name) for f in members)))


def stable_json(x: Column, kind: T.DataType) -> Column:
    """Compact JSON, the same for equal values: names and keys in order, nulls kept. Null stays null; a scalar is written as JSON writes it."""
    options = {"ignoreNullFields": "false"}
    if isinstance(kind, NESTED):
        return F.to_json(safe(x, kind), options)
    wrapped = F.to_json(F.array(safe(x, kind)), options)  # a list of one, without its brackets
    return F.when(safe(x, kind).isNotNull(), F.substring(wrapped, 2, F.length(wrapped) - 2))


def rewrites(kind: T.DataType, path: str) -> Iterator[tuple[str, str, Callable[[Column], Column]]]:
    """``path, what, count``: for each place of a type that may be rewritten, how often a value is."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        yield path, "nonfinite", lambda x: (x.isNotNull() & ~is_finite(x)).cast("long")
    elif isinstance(kind, T.BinaryType):
        yield path, "bytes", lambda x: x.isNotNull().cast("long")
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            for at, what, count in rewrites(f.dataType, f"{path}.{f.name}"):
                yield at, what, lambda x, name=f.name, count=count: count(x[name])
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        is_map = isinstance(kind, T.MapType)
        for at, what, count in rewrites(kind.valueType if is_map else kind.elementType, path + ("{}" if is_map else "[]")):
            yield at, what, lambda x, count=count: F.coalesce(F.aggregate(F.map_values(x) if is_map else x, F.lit(0).cast("long"), lambda a, y: a + F.coalesce(count(y), F.lit(0).cast("long"))), F.lit(0).cast("long"))


def safe_columns(df: DataFrame) -> DataFrame:
    """All columns, safe at every depth, with their names and order."""
    return df.select(*(safe(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def rewrite_counts(df: DataFrame) -> DataFrame:
    """``path, what, values`` of all places that were or would be rewritten, those with none included; one pass."""
    found = [(at, what, count(quoted(f.name))) for f in df.schema.fields for at, what, count in rewrites(f.dataType, f.name)]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, what string, values long")
    facts = [F.struct(F.lit(at).alias("path"), F.lit(what).alias("what"), F.coalesce(F.sum(x), F.lit(0).cast("long")).alias("values")) for at, what, x in found]
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
