"""Catalog semantics on the small packets of the survey's fixtures F1 and F2."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.timescale import calendar, split_window, utc_date, utc_to_tai, window_bounds
from skyledger.operators import catalog as C
from skyledger.operators import characterize as K

SCHEMA = (
    "diaSourceId long, diaObjectId long, midpointMjdTai double, pred struct<is_sso: boolean, new_flag: boolean>, ra double, dec double, band string, psfFlux double, psfFluxErr float, "
    "clf struct<cats_class: long, cats_score: double>, lc_features map<string, struct<mean: double>>, misc struct<firstDiaSourceMjdTai: double>"
)


def row(i, obj, at, sso, band, flux, cls, score, mean):
    return (i, obj, utc_to_tai(at), (sso, None), 1.0, 2.0, band, flux, 0.5, (cls, score), {"r": (mean,)} if mean else {}, (None,))


ROWS = [
    row(1, 123, "2026-02-25T23:59:59.9", False, "r", 10.0, 1, 0.1, 1.0),
    row(2, 123, "2026-02-25T00:00:00", False, "g", 20.0, 2, 0.2, 2.0),
    row(3, 0, "2026-02-25T12:00:00", True, "r", 30.0, 0, float("nan"), None),
    row(4, 0, "2026-02-25T12:30:00", False, "r", 40.0, 0, 0.3, None),
    row(5, 999, "2026-02-25T13:00:00", True, "r", 50.0, 0, 0.4, None),
]


@pytest.fixture(scope="module")
def packets(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def sources(packets):
    return C.cohort([("first", packets)])


def test_populations(sources):
    qc = C.population_qc(sources).first()
    assert (qc.source_rows, qc.distinct_sources, qc.dia, qc.sso, qc.ambiguous) == (5, 5, 2, 1, 2)
    sso = sources.where("population = 'SSO'").first()
    assert sso.object_id is None and sso.raw_object_id == 0


def test_object_summary_and_features(sources):
    r = C.object_summary(sources).first()
    assert (r.object_id, r.source_rows, r.delivered_bands) == (123, 2, "g,r")
    assert C.feature_availability(sources, "r", "mean").first().asDict() == {"source_rows": 5, "with_feature": 2, "mean_value": 1.5}
    assert C.nonfinite_scores(sources).first().nonfinite == 1


def test_days_include_those_without_rows(spark, sources):
    acquisitions = spark.createDataFrame([("first", "2026-02-25", "2026-02-28")], "acquisition_id string, start string, stop string")
    acquisitions = acquisitions.select("acquisition_id", F.col("start").cast("date").alias("start"), F.col("stop").cast("date").alias("stop"))
    days = C.daily_coverage(sources, acquisitions, "2026-02-25", "2026-02-28").orderBy("utc_date").collect()
    assert [r.source_rows for r in days] == [5, 0, 0]
    assert days[1].status == "zero_rows_in_validated_delivery"
    assert all(r.passed for r in C.reconciliation(sources, acquisitions, "2026-02-25", "2026-02-28").collect())


def test_two_acquisitions_with_different_columns(spark, packets):
    later = packets.drop("clf").withColumn("diaSourceId", F.col("diaSourceId") + 100).withColumn("future_optional", F.lit("x"))
    both = C.cohort([("first", packets), ("second", later)])
    assert both.count() == 10
    assert both.where("clf_json is null").count() == 5
    assert [(r.source_rows, r.acquisitions) for r in C.object_summary(both).collect()] == [(4, 2)]


@pytest.mark.parametrize("column, kind", [("diaSourceId", "int"), ("midpointMjdTai", "float")])
def test_other_types_are_refused(packets, column, kind):
    with pytest.raises(ValueError, match=column):
        C.project_sources(packets.withColumn(column, F.col(column).cast(kind)), "x")


def test_missing_id_is_refused(packets):
    with pytest.raises(ValueError, match="missing"):
        C.project_sources(packets.drop("diaObjectId"), "x")


def test_admission_of_deliveries(packets):
    status = lambda df: K.admission_status(K.schema_admission(df)).first().status
    assert status(packets) == "COMPATIBLE_WITH_LIMITATIONS"
    assert status(packets.withColumn("history", F.array(F.lit(1.0)))) == "COMPATIBLE_WITH_LIMITATIONS"  # an addition
    for odd in (
        packets.drop("band"), packets.withColumn("ra", F.col("ra").cast("float")), packets.withColumn("snr", F.lit("x")), packets.withColumn("clf", F.lit(1)),
        packets.withColumn("lc_features", F.create_map(F.lit("g"), F.lit(1.0))), packets.withColumn("ssObjectId", F.lit(1)), packets.withColumn("prvDiaSources", F.array(F.lit(1))),
    ):
        assert status(odd) == "INCOMPATIBLE"


def test_capabilities(packets):
    got = lambda df: {r.analysis: r.status for r in K.capability_matrix(df).collect()}
    assert got(packets)["temporal filtering"] == "SUPPORTED"
    assert got(packets.union(packets))["project cadence and band summaries"] == "PARTIALLY_SUPPORTED"
    bare = got(packets.where("false"))
    assert set(bare.values()) == {"NOT_SUPPORTED"}


def test_population_truth_table(spark):
    from skyledger.functions.scalars import population

    cases = [(False, 10), (True, None), (True, 0), (True, 10), (False, None), (False, 0), (None, 10), (None, None), (True, -1), (False, -1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f boolean, o long")
    got = [r.p for r in df.select("i", population(F.col("f"), F.col("o")).alias("p")).orderBy("i").collect()]
    assert got == ["DIA", "SSO", "SSO"] + ["AMBIGUOUS"] * 7


def test_id_stats(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "id long")
    r = C.id_stats(df, "id").first()
    assert (r.total, r.nulls, r.distinct_ids, r.duplicate_excess, r.rows_in_duplicate_groups) == (5, 1, 2, 2, 3)
    assert C.id_stats(df.limit(0), "id").first().total == 0


def test_midnight_and_leap_second(spark):
    texts = ["2016-12-31T23:59:60", "2017-01-01T00:00:00", "2026-02-25T23:59:59.9", "2026-02-26T00:00:00"]
    df = spark.createDataFrame([(t, utc_to_tai(t)) for t in texts] + [("nan", float("nan")), ("none", None)], "t string, mjd double")
    got = {r.t: str(r.d) for r in df.select("t", utc_date(F.col("mjd")).alias("d")).collect()}
    assert got == {texts[0]: "2016-12-31", texts[1]: "2017-01-01", texts[2]: "2026-02-25", texts[3]: "2026-02-26", "nan": "None", "none": "None"}
    with pytest.raises(ValueError, match="leap"):
        utc_to_tai("2026-02-25T23:59:60")
    with pytest.raises(ValueError, match="offset"):
        utc_to_tai("2026-02-25T00:00:00+01:00")
    with pytest.raises(ValueError, match="before"):
        window_bounds("2026-02-26", "2026-02-25")


def test_windows(spark):
    parts = split_window("2026-02-25T00:00:00", "2026-03-05T00:00:00", 8)
    assert len(parts) == 8 and parts[0][1] == parts[1][0] == "2026-02-26T00:00:00"
    assert calendar(spark, "2026-02-25", "2026-02-28").count() == 3


def test_map_coverage(spark):
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("mean", T.DoubleType())]))
    df = spark.createDataFrame([(None,), ({},), ({"r": (None,), "g": (float("nan"),)},)], T.StructType([T.StructField("m", kind)]))
    got = {r.path: (r.observed, r.nulls, r.nonfinite) for r in K.coverage(df).collect()}
    assert got == {"m": (3, 1, 0), "m.mean": (2, 1, 1)}


def test_struct_coverage_has_null_parents(spark):
    df = spark.createDataFrame([(None,), ((None,),), ((False,),)], "p struct<is_sso: boolean>")
    assert {r.path: (r.observed, r.nulls) for r in K.coverage(df).collect()} == {"p.is_sso": (3, 2)}


def test_overlaps_and_duplicates(spark):
    a = spark.createDataFrame([("x", 1, 5), ("y", 4, 8), ("z", 8, 9)], "acquisition_id string, start int, stop int")
    assert [(r.acquisition_id, r.next_id) for r in C.overlapping_windows(a).collect()] == [("x", "y")]
    assert C.duplicate_acquisitions(a.unionByName(a.limit(1))).count() == 1


def test_window_filter_reaches_the_scan(spark):
    from skyledger.plans.catalog_queries import sources as cohort

    df = C.utc_window(cohort(spark, "/root/testdata/sf0.001"), "2024-01-05", "2024-01-07", "a1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # the other acquisition's branch is gone


def test_catalog_is_verified_when_opened(spark):
    manifest = spark.createDataFrame([("v1", "PASS", "abc")], "contract string, status string, fingerprint string")
    C.open_catalog(spark, manifest, "v1", "abc")
    with pytest.raises(ValueError):
        C.open_catalog(spark, manifest, "v1", "other")


def delivered(spark, rows=((1, 5, 60310.5), (2, 5, 60310.9))):
    return spark.createDataFrame(list(rows), "diaSourceId long, diaObjectId long, midpointMjdTai double")


def failing(spark, alerts, files=1, rows=2, nested=0, **named):
    from skyledger.operators.decisions import validate_delivery

    raw = spark.createDataFrame([(files, rows, nested)], "files long, rows long, nested_columns long")
    told = validate_delivery(alerts, raw, "2024-01-01", "2024-01-02", "2023-12-01", **named).collect()
    assert len(told) == 19 and all((r.severity == "info") == r.passed or r.check == "smoke_completeness_blocked" for r in told)
    return {r.check for r in told if not r.passed}


def test_delivery_claims_need_all_evidence(spark):
    base = {"coordinate_fields_available", "band_fields_available"}
    blocked = {"full_night_completeness_evidence", "completeness_claim_allowed"}
    good = delivered(spark)
    assert failing(spark, good, night_complete=True) == base and failing(spark, good) == base | blocked
    for named in ({"lag_zero": False}, {"truncated": True}, {"filtered": True}, {"all_alerts": False}):
        assert failing(spark, good, night_complete=True, **named) == base | blocked
    assert failing(spark, good, night_complete=True, nested=2) == base | blocked | {"nested_sanitization_report_present"}
    assert failing(spark, good, night_complete=True, nested=2, nested_report=True) == base
    assert failing(spark, good, scope="tag_filtered_smoke_delivery", night_complete=True) == base | {"completeness_claim_allowed", "smoke_completeness_blocked"}
    assert failing(spark, delivered(spark, [(1, 5, 60310.5), (1, 5, 60311.0)]), night_complete=True) == base | blocked | {"duplicate_source_id_rate", "date_window_consistency"}
    assert failing(spark, delivered(spark, [(1, None, None)]), night_complete=True) >= blocked | {"object_identifier_present", "object_grouping_count", "date_window_consistency", "time_fields_available"}
    assert failing(spark, delivered(spark, []), files=0, rows=0) >= {"raw_delivery_present", "delivery_present", "processed_alerts_present"}


def test_blockers_are_named_in_order(spark):
    from skyledger.operators.decisions import BLOCKERS, feasibility

    parts = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    checks = lambda ok: spark.createDataFrame([(ok, "error")], "passed boolean, severity string")
    told = lambda p, c, *a, **k: tuple(feasibility(p, c, *a, **k).first())
    assert told(parts("empty", "exhausted"), checks(True), True, False, True) == ("yes", [], False)
    assert told(parts("exhausted", "failed"), checks(False), False, True, False, scope="tag") == ("unresolved", list(BLOCKERS.values()), True)
    assert told(parts("unsafe"), checks(True), True, True, True) == ("unsafe_to_attempt", [BLOCKERS["partitions"]], True)
    assert told(parts("exhausted"), checks(True), False, False, True)[0] == "no" and told(parts("exhausted"), checks(False), True, False, True)[0] == "no"
    assert told(parts(None), checks(True), True, False, True) == ("no", [BLOCKERS["partitions"]], True)
