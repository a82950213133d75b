"""Tables written with a report of what was written: rows, and values that Parquet readers get as JSON text, counted while they pass."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.nested import NESTED, quoted, rewrites, stable_json

REPORT = "table string, status string, rows long, columns long, converted array<string>, error string"
DETAIL = "table string, column string, path string, what string, values long"
#: Rows of a table that can't be written that are kept as CSV.
PREVIEW = 1000


def converted(df: DataFrame) -> list[T.StructField]:
    """Columns that are written as JSON text: nested ones and bytes."""
    return [f for f in df.schema.fields if isinstance(f.dataType, (*NESTED, T.BinaryType))]


def flat_columns(df: DataFrame) -> DataFrame:
    turned = {f.name for f in converted(df)}
    return df.select(*(stable_json(quoted(f.name), f.dataType).alias(f.name) if f.name in turned else quoted(f.name) for f in df.schema.fields))


def write_table(df: DataFrame, path: str) -> tuple[int, list[tuple[str, str, str, int]]]:
    """Write one table; its rows, and ``column, path, what, values`` of what was converted (``nested`` and ``bytes`` values) or rewritten inside it (``nonfinite``, ``bytes``).

    The counts come with the write itself, as observed metrics: nothing is read twice.
    """
    fields = converted(df)
    told = [(f.name, f.name, "bytes" if isinstance(f.dataType, T.BinaryType) else "nested", F.count(quoted(f.name))) for f in fields]
    zero = F.lit(0).cast("long")
    told += [(f.name, at, what, F.coalesce(F.sum(count(quoted(f.name))), zero)) for f in fields if isinstance(f.dataType, NESTED) for at, what, count in rewrites(f.dataType, f.name)]
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(x.alias(f"m{k}") for k, (*_, x) in enumerate(told)))
    flat_columns(watched).write.mode("overwrite").parquet(path)
    found = seen.get
    return found["rows"], [(c, at, what, found[f"m{k}"]) for k, (c, at, what, _) in enumerate(told)]


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> tuple[DataFrame, DataFrame]:
    """Each table below ``out``, and the reports (see ``REPORT``, ``DETAIL``); both are written beside the tables too.

    status: ``written``, ``empty`` (no rows: no folder either) or ``failed``. A table that fails leaves its error and, where its first rows can be read, a CSV of them
    in ``<table>.preview``; the others are written all the same.
    """
    from skyledger.streaming.incremental import dropped

    report, detail = [], []
    for name, df in tables.items():
        kinds = [f.name for f in converted(df)]
        try:
            rows, found = write_table(df, f"{out}/{name}")
            detail += [(name, *x) for x in found]
            report.append((name, "written" if rows else "empty", rows, len(df.columns), kinds, None))
            if not rows:
                dropped(spark, f"{out}/{name}")
        except PySparkException as problem:
            dropped(spark, f"{out}/{name}")
            error = f"{type(problem).__name__}: {problem}"[:500]
            try:
                flat_columns(df.limit(PREVIEW)).write.mode("overwrite").option("header", True).csv(f"{out}/{name}.preview")
            except PySparkException:
                dropped(spark, f"{out}/{name}.preview")
                error += " (no rows could be read)"
            report.append((name, "failed", None, len(df.columns), kinds, error))
    frames = spark.createDataFrame(report, REPORT), spark.createDataFrame(detail, DETAIL)
    for frame, name in zip(frames, ("_report", "_report_detail"), strict=True):
        frame.coalesce(1).write.mode("overwrite").json(f"{out}/{name}")
    return frames


def write_nights(tables: dict[str, DataFrame], out: str, time: str, start: str | None = None, stop: str | None = None) -> None:
    """Each table in ``<out>/<table>/night_key=<night>``, by the approximate night of ``time``; rows outside the window, or without a time, have nights of their own.

    A night's rows are dealt to as many files as adaptive execution finds worth, so that neither one task writes a large night nor all tasks each a little file.
    """
    from skyledger.operators.ingest import with_night

    for name, df in tables.items():
        dated = with_night(df, time, start=start, stop=stop).hint("rebalance", "night_key")
        dated.write.mode("overwrite").partitionBy("night_key").parquet(f"{out}/{name}")


def read_night(spark: SparkSession, out: str, table: str, night: str) -> DataFrame:
    """One night of a table that ``write_nights`` wrote; no other folder is looked into."""
    return spark.read.parquet(f"{out}/{table}").where(F.col("night_key").cast("string") == night)
