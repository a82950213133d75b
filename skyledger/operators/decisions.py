"""What a set of partitions or a delivery allows to be claimed."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.nested import quoted
from skyledger.functions.scalars import number
from skyledger.functions.timescale import mjd_of
from skyledger.operators.quality import check, run_checks, validate_table

#: Partition states that forbid a claim.
BLOCKING = ["failed", "skipped", "possibly_truncated", "unsupported", "unsafe"]


def partition_checks(parts: DataFrame, comparable: bool, has_fraction: bool) -> DataFrame:
    """Checks over ``part, status, rows, requested``: states recorded, caps given and kept, hits marked, and no fraction
    without something comparable."""
    c = F.col
    tried = ~F.coalesce(c("status"), F.lit("")).isin("unsupported", "unsafe", "skipped")
    rules = [
        check("partition_status_recorded", F.count_if(c("status").isNull())),
        check("no_unbounded_queries", F.count_if(tried & (F.coalesce("requested", F.lit(0)) <= 0))),
        check("row_count_within_requested_limit", F.count_if((c("requested") > 0) & (c("rows") > c("requested")))),
        check("cap_hits_marked_truncated", F.count_if((c("rows") == c("requested")) & ~c("status").eqNullSafe("possibly_truncated"))),
        check("denominator_comparison_validity", F.lit(0 if comparable or not has_fraction else 1)),
    ]
    return run_checks(parts, rules)


# What stands in the way of a claim, in their order.
BLOCKERS = {
    "enumeration": "No public REST all-alert enumeration path was proven.",
    "scope": "The executed extraction scope was not all-alert.",
    "partitions": "At least one partition was failed, skipped, unsupported, unsafe, or possibly truncated.",
    "denominator": "No directly comparable denominator is available.",
    "checks": "Validation found errors that prevent a completeness claim.",
}


def feasibility(parts: DataFrame, checks: DataFrame, all_alerts: bool, by_tag: bool, comparable: bool, scope: str | None = "all_alert") -> DataFrame:
    """``decision, blockers, transfer_considered``: may a whole night be claimed of these partitions, and what stands against it, as texts in a fixed order.

    Yes needs an enumeration of all alerts, a scope of all alerts, only exhausted or empty partitions, a comparable denominator and passed checks; unsafe partitions forbid the
    attempt; caps or an enumeration by tag leave it open. Partitions and checks are each read once.
    """
    status = F.coalesce(F.col("status"), F.lit("failed"))
    facts = parts.agg(
        F.count_if(status.isin(BLOCKING)).alias("blocked"), F.count_if(status == "unsafe").alias("unsafe"), F.count_if(status == "possibly_truncated").alias("cut"), F.count_if(~status.isin("exhausted", "empty")).alias("open")
    )
    failed = checks.agg(F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("failed"))
    c = F.col
    against = {"enumeration": F.lit(not all_alerts), "scope": F.lit(scope != "all_alert"), "partitions": c("blocked") > 0, "denominator": F.lit(not comparable), "checks": c("failed") > 0}
    blockers = F.array_compact(F.array(*(F.when(x, F.lit(BLOCKERS[k])) for k, x in against.items())))
    decision = (
        F.when(c("unsafe") > 0, "unsafe_to_attempt").when(F.lit(not all_alerts and not by_tag), "no").when((F.size(blockers) == 0) & (c("open") == 0), "yes")
        .when((c("cut") > 0) | F.lit(by_tag), "unresolved").otherwise("no")
    )
    told = facts.join(failed).select(decision.alias("decision"), blockers.alias("blockers"))  # one row each
    return told.withColumn("transfer_considered", c("decision") != "yes")


def bounded_checks(tables: dict[str, DataFrame], parts: DataFrame) -> DataFrame:
    """The checks of a bounded extraction: those of each table by its kind, how many rows details were asked for, and whether a cap was hit.

    tables: by name (``forced_photometry``, ``object_summary``, or sources of any other name). parts: ``part, status, rows``.
    """
    kinds = {"forced_photometry": "forced_photometry", "object_summary": "objects"}
    told = [validate_table(df, kinds.get(name, "sources")).select(F.lit(name).alias("table"), "check", "passed", "severity", "bad_rows") for name, df in tables.items()]
    facts = run_checks(parts, [
        check("detail_fetch_coverage", F.lit(0), "info"),
        check("truncation_pagination", F.count_if(F.col("status") == "possibly_truncated"), "warning"),
    ]).select(F.lit("extraction").alias("table"), "check", "passed", "severity", "bad_rows")
    return reduce(DataFrame.unionByName, [*told, facts])


# Columns that may hold what a delivery is checked for, best first.
OBJECT_COLUMNS, SOURCE_COLUMNS = ["diaObjectId", "r:diaObjectId", "objectId"], ["diaSourceId", "r:diaSourceId", "candid"]
SKY_COLUMNS, TIMES, BAND_COLUMNS = ["ra", "r:ra", "dec", "r:dec"], ["time_mjd", "midpointMjdTai", "r:midpointMjdTai", "firstDiaSourceMjdTai"], ["band", "r:band", "filter"]
FULL_NIGHT = ["full_night", "full_night_all_alerts"]


def validate_delivery(
    alerts: DataFrame, raw: DataFrame, start: str, stop: str, first_alert: str, timezone: str = "UTC", scope: str = "full_night", all_alerts: bool = True, filtered: bool = False,
    lag_zero: bool | None = None, truncated: bool = False, night_complete: bool = False, nested_report: bool = False,
) -> DataFrame:
    """``check, passed, severity, value`` of a delivery: raw files, dates, identifiers, optional field groups, repeated sources, groups of objects, the window, the report of nested
    columns, and whether a whole night may be claimed. value: the count or rate that decides.

    raw: one row ``files, rows, nested_columns`` (see ``delivery_facts`` and ``column_union``). alerts are read once for all counts, and once by id for each of the
    two id columns. A check that passes is of severity ``info``. Readable rows alone never allow a claim.
    """
    present = lambda names: [n for n in names if n in alerts.columns]
    groups = {"object": OBJECT_COLUMNS, "source": SOURCE_COLUMNS, "sky": SKY_COLUMNS, "time": TIMES, "band": BAND_COLUMNS}
    low, high = (float(mjd_of(date.fromisoformat(x))) for x in (start, stop))  # nights as they are named, without TAI's lead
    filled = {k: reduce(lambda a, b: a + b, (F.count(quoted(c)) for c in present(v)), F.lit(0)).cast("long") for k, v in groups.items()}
    outside = [F.count_if(number(quoted(c)).isNotNull() & ~((number(quoted(c)) >= low) & (number(quoted(c)) < high))) for c in present(TIMES)]
    dated = [F.count(number(quoted(c))) for c in present(TIMES)]
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0)).cast("long")
    facts = alerts.agg(F.count("*").alias("alerts"), *(x.alias(k) for k, x in filled.items()), add(outside).alias("outside"), add(dated).alias("dated"))

    def grouped(names: list[str], n: str, extra: str) -> DataFrame:
        if not present(names):
            return alerts.sparkSession.range(1).select(F.lit(None).cast("long").alias(n), F.lit(None).cast("long").alias(extra))
        by_id = alerts.select(quoted(present(names)[0]).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
        return by_id.agg(F.count("*").alias(n), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(extra))

    whole = facts.join(raw.select(F.col("files").alias("raw_files"), F.coalesce("rows", F.lit(0)).alias("raw_rows"), "nested_columns"))
    whole = whole.join(grouped(OBJECT_COLUMNS, "objects", "again")).join(grouped(SOURCE_COLUMNS, "sources", "repeats"))  # one row each
    c, full = F.col, scope in FULL_NIGHT
    here, any_alerts = c("raw_files") > 0, c("alerts") > 0
    rate = F.col("repeats") / F.nullif(F.col("repeats") + F.col("sources"), F.lit(0))
    in_window = F.lit(True) if not present(TIMES) else (c("dated") > 0) & (c("outside") == 0)
    nested_told = F.lit(nested_report) | (c("nested_columns") == 0)
    sound = any_alerts & (c("object") > 0) & (c("source") > 0) & F.lit(start >= first_alert) & F.lit(timezone == "UTC") & nested_told
    allowed = any_alerts & (c("raw_rows") > 0) & F.lit(full and all_alerts and not filtered and lag_zero is not False and not truncated and night_complete) & in_window & sound
    rules = [
        ("raw_delivery_present", here, "warning", c("raw_files")), ("raw_file_count_positive", here, "warning", c("raw_files")), ("raw_row_count_positive", c("raw_rows") > 0, "warning", c("raw_rows")),
        ("delivery_present", here | any_alerts, "warning", c("alerts")), ("target_date_not_pre_alert", F.lit(start >= first_alert), "error", F.lit(None)), ("timezone_utc", F.lit(timezone == "UTC"), "error", F.lit(None)),
        ("processed_alerts_present", any_alerts, "error", c("alerts")), ("object_identifier_present", c("object") > 0, "error", c("object")), ("source_identifier_present", c("source") > 0, "error", c("source")),
        ("coordinate_fields_available", c("sky") > 0, "warning", c("sky")), ("time_fields_available", c("time") > 0, "warning", c("time")), ("band_fields_available", c("band") > 0, "warning", c("band")),
        ("duplicate_source_id_rate", F.coalesce(c("repeats") == 0, F.lit(False)), "warning", F.coalesce(rate, F.lit(0.0))), ("object_grouping_count", F.coalesce(c("objects") > 0, F.lit(False)), "warning", c("objects")),
        ("date_window_consistency", in_window, "warning", c("outside")), ("nested_sanitization_report_present", nested_told, "error", c("nested_columns")),
        ("full_night_completeness_evidence", allowed | F.lit(not full), "warning", F.lit(None)), ("completeness_claim_allowed", allowed, "warning", F.lit(None)),
        ("smoke_completeness_blocked", F.lit(scope != "tag_filtered_smoke_delivery" or not night_complete), "info", F.lit(None)),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("check"), x.alias("passed"), F.when(x, "info").otherwise(level).alias("severity"), v.cast("double").alias("value")) for n, x, level, v in rules))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def prefix_meaning(field: Column) -> Column:
    """What a field's prefix tells. Fixed values, by prefix."""
    known = {
        "i": "original alert/survey field", "d": "science-module or database-added value", "v": "runtime-generated value", "b": "cutout/image payload field",
        "f": "statistics, filter, or summary field", "key": "database index or key field",
    }
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    named = F.coalesce(F.element_at(table, F.split(field, ":")[0]), F.lit("unknown column family"))
    return F.when(field.contains(":"), named).otherwise(F.lit("unprefixed or service-specific field"))
