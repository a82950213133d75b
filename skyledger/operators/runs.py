"""Rules over tables of runs: what a run may claim, where its delivery stands, and contradictions in its entries.

Every rule is a column expression, so that a table of any number of runs is judged in one pass without a shuffle. Columns
that the rules read: ``run, scope, packet_type, is_all_alert, filters`` (an array of strings), ``lifecycle_state``,
``execution_partial``, ``validation_status``, ``lag_zero``, ``expected_total, readable_rows, nights`` (the number of
expected nights), ``start, stop`` (dates) and the four claims. Scopes may go by their aliases. A null counts as absent evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, claims, scopes and their policies, packet types and legal steps.
CLAIMS = ["all_alert_completeness", "night_completeness", "week_completeness", "range_completeness"]
CLAIM_STATES = ["blocked", "unresolved", "allowed", "rejected"]
DATA_SCOPES = ["smoke", "bounded_tag", "single_night", "multi_night", "full_week", "full_month", "date_range", "partial_schema_only"]
PACKET_TYPES = ["light_static", "full", "medium", "unknown"]
RAW_INCOMPLETE = ["declared", "topic_registered", "download_pending", "download_active", "raw_missing", "raw_partial"]
STEPS = {
    "declared": ["topic_registered", "download_pending", "raw_missing", "failed"],
    "topic_registered": ["download_pending", "download_active", "raw_missing", "failed"],
    "download_pending": ["download_active", "raw_missing", "raw_partial", "failed"],
    "download_active": ["raw_partial", "raw_appears_complete_unverified", "failed"],
    "raw_missing": ["download_pending", "download_active", "failed"],
    "raw_partial": ["download_active", "raw_appears_complete_unverified", "raw_inspected", "failed"],
    "raw_appears_complete_unverified": ["raw_inspected", "ingestion_pending", "failed"],
    "raw_inspected": ["ingestion_pending", "ingestion_partial", "failed"],
    "ingestion_pending": ["ingestion_partial", "ingested", "failed"],
    "ingestion_partial": ["ingested", "validated_with_warnings", "failed"],
    "ingested": ["validated_with_warnings", "validated", "failed"],
    "validated_with_warnings": ["validated", "failed", "archived"],
    "validated": ["archived"],
    "failed": ["declared", "topic_registered", "archived"],
    "archived": [],
}
#: Names of data scopes by which requests call them.
DATA_SCOPE_ALIASES = {
    "smoke_delivery": "smoke", "tag_filtered_smoke_delivery": "bounded_tag", "full_night": "single_night", "full_night_all_alerts": "single_night",
    "full_week_full_packet": "full_week",
}
SCOPE_ALIASES = {"tag_filtered_smoke_delivery": "smoke_delivery", "full_night_all_alerts": "full_night"}
POLICY_FIELDS = "path_component string, is_tag_filtered boolean, is_all_alert boolean, is_single_night boolean, is_multi_night boolean, packet_type string, content_type string, completeness_default string, allow_completeness_only_after_validation boolean"
POLICIES = {
    "smoke_delivery": ("smoke_delivery", True, False, True, False, "light_static", "Light static packet", "blocked", True),
    "full_night": ("full_night", False, True, True, False, "light_static", "Light static packet", "unresolved", True),
    "full_week": ("full_week", False, True, False, True, "light_static", "Light static packet", "unresolved", True),
    "full_week_full_packet": ("full_week_full_packet", False, True, False, True, "full", "Full packet", "unresolved", True),
    "date_range": ("date_range", False, True, False, True, "light_static", "Light static packet", "unresolved", True),
}


def said(x: Column) -> Column:
    """A condition, false where it is null."""
    return F.coalesce(x, F.lit(False))


def renamed(name: Column, aliases: dict[str, str]) -> Column:
    """A name, or what it is an alias of."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), name), name)


def data_scope(name: Column) -> Column:
    return renamed(name, DATA_SCOPE_ALIASES)


def infer_scope(start: Column, stop: Column, filters: Column, asked: Column) -> Column:
    """The scope of a request: the one that it asks for, by any alias; else ``bounded_tag`` if it filters, else by its number of nights.

    What can't be told is null: a scope that isn't known, or a window without nights.
    """
    nights, known = F.datediff(stop, start), data_scope(asked)
    by_length = F.when(nights == 1, "single_night").when(nights <= 7, "full_week").when(nights <= 31, "full_month").otherwise("multi_night")
    free = F.when(nights > 0, F.when(F.size(filters) > 0, F.lit("bounded_tag")).otherwise(by_length))
    return F.when(F.coalesce(asked, F.lit("")) != "", F.when(known.isin(DATA_SCOPES), known)).otherwise(free)


def bare() -> Column:
    """Rows that are filtered, or not of all alerts: they can support no claim about all of them."""
    return said(F.size("filters") > 0) | ~said(F.col("is_all_alert"))


def completeness_claims(runs: DataFrame) -> DataFrame:
    """``run``, the four claims (allowed, unresolved or blocked) and the ``reason``.

    Readable rows never prove completeness by themselves. One night may be claimed on strict evidence: validation passed,
    no lag, and as many readable rows as were expected. A range is its own unit and never a week.
    """
    c, is_range = F.col, said(data_scope(F.col("scope")) == "date_range")
    strict = said((c("validation_status") == "passed") & c("lag_zero") & (c("expected_total") != 0) & (c("readable_rows") == c("expected_total")))
    case = (
        F.when(said(c("execution_partial")) | bare(), 0).when(c("packet_type") == "unknown", 1).when(strict & said(c("nights") == 1), 2).otherwise(3)
    )
    seen = runs.withColumn("_case", case)
    of = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("_case") + 1)
    every = of("blocked", "unresolved", "allowed", "unresolved")
    return seen.select(
        "run", every.alias("all_alert_completeness"), every.alias("night_completeness"),
        F.when(is_range, "blocked").otherwise(of("blocked", "unresolved", "blocked", "unresolved")).alias("week_completeness"),
        F.when(is_range & (F.col("_case") != 0), "unresolved").otherwise("blocked").alias("range_completeness"),
        of("partial/debug or filtered run cannot support completeness claims", "packet type is unknown", "strict single-night evidence is present", "strict completeness evidence is not present").alias("reason"),
    )


def default_claims(runs: DataFrame) -> DataFrame:
    """``run`` and the four claims that a run may make before anything is validated."""
    c = F.col
    scope = data_scope(c("scope"))
    is_range, filtered, raw = said(scope == "date_range"), said(F.size("filters") > 0), said(c("lifecycle_state").isin(RAW_INCOMPLETE))
    no_range = bare() | said(c("packet_type") != "light_static")
    open_ = F.when(is_range, ~(no_range | raw)).otherwise(~(raw | bare()))
    long = scope.isin("full_week", "full_month", "multi_night")
    week = (
        F.when(is_range, False).when(raw, ~filtered).when(bare(), False).when(c("packet_type") == "unknown", True).otherwise(said(long))
    )
    label = lambda x: F.when(x, "unresolved").otherwise("blocked")
    return runs.select(
        "run", label(open_).alias("all_alert_completeness"), label(open_).alias("night_completeness"), label(week).alias("week_completeness"), label(is_range & ~no_range).alias("range_completeness"),
    )


def unsupported(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), F.coalesce(value, F.lit("None")))


def run_rules(runs: DataFrame) -> DataFrame:
    """``run, errors, warnings``: contradictions among a run's own entries, each an array of texts in a fixed order."""
    c = F.col
    nights = F.datediff(c("stop"), c("start"))
    scope = data_scope(c("scope"))
    is_range, filtered, whole = said(scope == "date_range"), said(F.size("filters") > 0), said(c("is_all_alert"))
    raw = said(c("lifecycle_state").isin(RAW_INCOMPLETE))
    allowed = {k: said(c(k) == "allowed") for k in CLAIMS}
    when = lambda x, text: F.when(x, F.lit(text) if isinstance(text, str) else text)
    errors = F.array(
        when(~said(nights > 0), "startdate must be before stopdate"),
        when(said((nights > 0) & (c("nights") != nights)), "expected_nights must match the half-open UTC startdate/stopdate window"),
        when(~said(scope.isin(DATA_SCOPES)), unsupported("Unsupported run scope: ", c("scope"))),
        when(~said(c("lifecycle_state").isin(list(STEPS))), unsupported("Unsupported lifecycle state: ", c("lifecycle_state"))),
        *(when(~said(c(k).isin(CLAIM_STATES)), unsupported(f"{k}: Unsupported claim state: ", c(k))) for k in CLAIMS),
        when(~said(c("packet_type").isin(PACKET_TYPES)), f"packet_type must be one of {sorted(PACKET_TYPES)}"),
        when(filtered & whole, "filters imply is_all_alert = false"),
        when(filtered & whole, "all-alert manifests must not have filters"),
        when(is_range & ~said(c("packet_type") == "light_static"), "date_range scope is defined only for packet_type light_static"),
        when(is_range & bare(), "date_range scope is defined only for unfiltered all-alert requests"),
        when(is_range & ~said(nights >= 2), "date_range scope needs at least two nights; use full_night for one night"),
        *(when(raw & allowed[k], F.concat(F.lit(f"{k} cannot be allowed while lifecycle_state is "), c("lifecycle_state"))) for k in CLAIMS),
        when(filtered & allowed["all_alert_completeness"], "tag-filtered runs cannot allow all-alert completeness claims"),
        when(allowed["week_completeness"], "week_completeness cannot be allowed by default"),
        when(allowed["range_completeness"], "range_completeness cannot be allowed by default"),
    )
    some = allowed[CLAIMS[0]] | allowed[CLAIMS[1]] | allowed[CLAIMS[2]] | allowed[CLAIMS[3]]
    warnings = F.array(
        when(said(c("packet_type") == "unknown"), "unknown packet_type keeps completeness claims strict"),
        when(~whole & ~filtered & said(scope.isin("single_night", "multi_night", "full_week", "full_month", "date_range")), "unfiltered non-all-alert manifest has conservative completeness claims"),
        when(said(c("lifecycle_state") == "validated_with_warnings") & some, "validated_with_warnings requires explicit review before allowing claims"),
    )
    return runs.select("run", F.array_compact(errors).alias("errors"), F.array_compact(warnings).alias("warnings"))


def illegal_steps(steps: DataFrame) -> DataFrame:
    """Rows of ``run, from_state, to_state`` whose step the lifecycle does not allow. A known state may stay as it is; unknown states allow nothing."""
    legal = (F.col("from_state") == F.col("to_state")) & F.col("from_state").isin(list(STEPS))
    for state, later in STEPS.items():
        if later:
            legal = legal | ((F.col("from_state") == state) & F.col("to_state").isin(later))
    return steps.where(~said(legal)).select("run", "from_state", "to_state")


def with_policy(runs: DataFrame) -> DataFrame:
    """``run, scope, supported`` and the policy's fields of each run's scope, which may go by an alias. A scope without a policy
    is not supported, and its fields are null."""
    name = renamed(F.col("scope"), SCOPE_ALIASES)
    fields = [f.split() for f in POLICY_FIELDS.split(", ")]
    columns = []
    for k, (field, kind) in enumerate(fields):
        value = F.lit(None).cast(kind)
        for scope, policy in POLICIES.items():
            value = F.when(F.col("_scope") == scope, F.lit(policy[k])).otherwise(value)
        columns.append(value.alias(field))
    return runs.withColumn("_scope", name).select("run", F.col("_scope").alias("scope"), said(F.col("_scope").isin(list(POLICIES))).alias("supported"), *columns)


def raw_readiness(audits: DataFrame, min_free_gb: float = 20.0) -> DataFrame:
    """Where each raw delivery stands, by ordered rules, and whether it may be ingested.

    audits: ``delivery, present, files, parquet_files, unreadable, active, tiny, readable_rows, expected_total, progress, free_gb``.
    An expectation of 0 counts as none. No state proves completeness.
    """
    c = F.col
    n = lambda k: F.coalesce(c(k), F.lit(0))
    expected, terminal = F.nullif(c("expected_total"), F.lit(0)), F.nullif(c("progress"), F.lit(0))
    rules = [  # fixed values: states and their reasons
        (c("free_gb") < min_free_gb, "blocked_disk_risk", "Free disk space is below the configured safety threshold."),
        (~said(c("present")), "raw_missing", "Raw directory is missing."),
        (n("files") == 0, "raw_missing", "Raw directory exists but contains no delivery files."),
        ((n("unreadable") > 0) & (n("unreadable") == n("parquet_files")), "blocked_corrupt_raw", "All discovered Parquet files are unreadable."),
        (c("active"), "download_active", "Files were modified recently; download may still be active."),
        (n("unreadable") > 0, "partial_with_errors", "Some Parquet files are unreadable."),
        (n("tiny") > 0, "partial_download", "Tiny suspicious files were detected."),
        (n("readable_rows") < expected, "partial_download", "Readable rows are below the expected terminal total."),
        (n("readable_rows") >= expected, "ready_for_raw_schema_inspection", "Readable rows meet or exceed the expected total; raw download appears complete but unvalidated."),
        (n("readable_rows") > 0, "appears_complete_unverified", "Readable rows exist, but no expected total was supplied."),
        (F.lit(True), "partial_download", "No readable rows were counted."),
    ]
    judged = F.coalesce(*(F.when(rule, F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))) for rule, state, reason in rules))
    state = c("_judged.state")
    return audits.withColumn("_judged", judged).select(
        "delivery", state.alias("state"), c("_judged.reason").alias("reason"), (state == "ready_for_raw_schema_inspection").alias("raw_download_appears_complete"),
        state.isin("ready_for_raw_schema_inspection", "ready_for_ingestion", "appears_complete_unverified").alias("ingestion_allowed"),
        (n("readable_rows") / expected * 100).alias("apparent_percent_complete"),
        F.when(expected.isNotNull(), F.greatest(expected - n("readable_rows"), F.lit(0))).cast("long").alias("remaining_rows"), (terminal - n("readable_rows")).cast("long").alias("terminal_progress_gap"),
    )


#: What to do next about a delivery in each state; in any other, to wait and look again.
NEXT_ACTIONS = {
    "raw_missing": "resume_same_topic_same_directory",
    "download_active": "wait_and_check_again",
    "blocked_disk_risk": "stop_due_to_disk_risk",
    "blocked_corrupt_raw": "inspect_partial_only",
    "partial_download": "resume_same_topic_same_directory",
    "partial_with_errors": "resume_same_topic_same_directory",
    "ready_for_raw_schema_inspection": "ready_for_ingestion",
    "appears_complete_unverified": "ready_for_ingestion",
    "ready_for_ingestion": "ready_for_ingestion",
}
OTHER_ACTION = "wait_and_check_again"


def next_action(readiness: DataFrame) -> DataFrame:
    """``delivery, state, action``: what to do next about each delivery, by its state (see ``raw_readiness``); without one, to wait and look again."""
    action = F.element_at(F.create_map(*(F.lit(x) for pair in NEXT_ACTIONS.items() for x in pair)), F.col("state"))
    return readiness.select("delivery", "state", F.coalesce(action, F.lit(OTHER_ACTION)).alias("action"))
