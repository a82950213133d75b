"""Checks as rows: ``check, passed, severity, bad_rows``, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.scalars import number

#: What a column may hold.
RANGES = {"ra": (0.0, 360.0), "dec": (-90.0, 90.0), "mjd": (30000.0, 100000.0), "jd": (2400000.0, 2500000.0), "mag": (-50.0, 50.0)}


def out_of_range(x: Column, low: float, high: float) -> Column:
    return F.count_if(x.isNotNull() & ~x.between(low, high))


def check(name: str, bad: Column, severity: str = "error") -> Column:
    return F.struct(F.lit(name).alias("check"), (bad == 0).alias("passed"), F.lit(severity).alias("severity"), bad.cast("long").alias("bad_rows"))


def run_checks(df: DataFrame, rules: list[Column]) -> DataFrame:
    """All rules in one pass over the rows."""
    return df.agg(F.array(*rules).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def range_checks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """columns: name of the range -> column. Nothing to check passes."""
    return run_checks(df, [check(f"{k}_range", out_of_range(number(F.col(c)), *RANGES[k])) for k, c in columns.items()])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def presence_checks(df: DataFrame, required: list[str], ids: list[str], provenance: list[str] = ()) -> DataFrame:
    """Rows, required columns, ids that are there in every row, provenance columns (a warning)."""
    rules = [check("non_empty", F.when(F.count("*") == 0, 1).otherwise(0))]
    rules.append(check("required_columns", F.lit(len(missing_columns(df, required)))))
    rules += [check(f"{c}_present", F.count_if(F.col(c).isNull())) for c in ids if c in df.columns]
    if provenance:
        rules.append(check("provenance_columns", F.lit(len(missing_columns(df, list(provenance)))), "warning"))
    return run_checks(df, rules)


def duplicate_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys count as equal."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return run_checks(sizes, [check("duplicate_keys", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))])


def error_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Errors may not be negative."""
    return run_checks(df, [check(f"{c}_not_negative", F.count_if(number(F.col(c)) < 0)) for c in columns])


def validate_table(df: DataFrame, kind: str) -> DataFrame:
    """The rule set of a table's kind: sources, objects or forced photometry."""
    ids = {"sources": ["source_id"], "objects": ["object_id"], "forced_photometry": ["forced_source_id"]}[kind]
    ranges = {k: k for k in RANGES if k in df.columns and (kind != "objects" or k in ("ra", "dec"))}
    rules = presence_checks(df, ids, ids)
    out = rules.unionByName(range_checks(df, ranges)) if ranges else rules
    if kind != "forced_photometry":
        out = out.unionByName(duplicate_check(df, ids))
    return out.unionByName(error_checks(df, ["flux_err"])) if "flux_err" in df.columns else out


def status_rollup(checks: DataFrame) -> DataFrame:
    """``status`` of a set of checks: failed, passed_with_warnings or passed."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    status = F.when(failed("error") > 0, "failed").when(failed("warning") > 0, "passed_with_warnings").otherwise("passed")
    return checks.agg(status.alias("status"), failed("error").alias("errors"), failed("warning").alias("warnings"), F.count("*").alias("checks"))


def night_coverage(rows: DataFrame, night: Column, expected: DataFrame) -> DataFrame:
    """``night, status`` of each expected night: present or missing."""
    seen = rows.select(night.alias("night")).distinct().withColumn("seen", F.lit(True))
    return expected.select("night").join(seen, "night", "left").select("night", F.when(F.col("seen"), "present").otherwise("missing").alias("status"))


def remaining_rows(runs: DataFrame) -> DataFrame:
    """``run, remaining``: expected rows that are not readable yet; unknown without an expectation."""
    return runs.select("run", F.when(F.col("expected_rows").isNotNull(), F.greatest(F.col("expected_rows") - F.col("readable_rows"), F.lit(0))).cast("long").alias("remaining"))
