"""Delivery audit, ingestion, checks and lookups on small files and rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger.operators import explore as X
from skyledger.operators import ingest as I
from skyledger.operators import lookup as L
from skyledger.operators import quality as Q
from skyledger.operators import runs as R
from skyledger.sources import delivery as D
from skyledger.streaming.incremental import file_stream, ingest_available


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("delivery") / "one'quoted"
    for k, n in enumerate((3, 4, 3)):
        spark.range(10 * k, 10 * k + n).withColumn("band", F.lit("r")).coalesce(1).write.parquet(str(root / f"part{k}"))
    (root / "bad.parquet").write_text("no parquet")
    (root / ".gitkeep").write_text("")
    return str(root)


def test_footers_report_broken_files(spark, folder):
    files = D.discover(spark, folder, "*.parquet")
    found = D.readability(D.footers(files)).first()
    assert (found.files, found.readable, found.unreadable, found.rows, found.schema_groups) == (4, 3, 1, 10, 1)
    assert D.partial_files(files, "2040-01-01 00:00:00").count() == 4  # all are tiny
    import hashlib
    from pathlib import Path

    for r in D.hash_inventory(files, 100).collect():
        assert r.sha256 == hashlib.sha256(Path(r.path.removeprefix("file:")).read_bytes()).hexdigest()
    assert D.activity(files).first().last_60_min == 4


def test_digests_change_in_one_shard(spark):
    rows = [(f"f{k}", k, f"hash{k}") for k in range(200)]
    a = spark.createDataFrame(rows, "path string, length long, sha256 string")
    b = spark.createDataFrame([*rows[:-1], ("f199", 199, "other")], "path string, length long, sha256 string")
    left = {r.shard: r.digest for r in D.shard_digests(a).collect()}
    right = {r.shard: r.digest for r in D.shard_digests(b).collect()}
    assert sum(left[k] != right[k] for k in left) == 1
    assert D.root_digest(D.shard_digests(a)).first().root != D.root_digest(D.shard_digests(b)).first().root


def test_reconciliation(spark):
    cases = [(798047, 798047, 0, 798047), (1636189, 1636189, 0, 1633438), (10, 9, 1, 9), (10, 10, 0, 11), (0, 0, 0, 0)]
    df = spark.createDataFrame(cases, "expected long, committed long, lag long, local_rows long")
    assert [r.passed for r in D.reconcile(df).collect()] == [True, False, False, False, False]


def test_watermarks(spark):
    df = spark.createDataFrame([("t", 0, 5, 10), ("t", 1, 3, 3), ("t", 1, 4, 2)], "topic string, partition int, low long, high long")
    assert D.expected_messages(df).first().asDict() == {"topic": "t", "expected": 3, "invalid": 1, "repeated_partitions": 1}


def test_stream_restart_reads_nothing_twice(spark, folder, tmp_path):
    schema = spark.createDataFrame([], "id long, band string").schema
    for _ in range(2):
        stream = file_stream(spark, f"{folder}/part0", schema)
        ingest_available(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_mixed_formats(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(7, "x")], "id long, name string").coalesce(1).write.json(str(tmp_path / "b"))
    whole = D.load_files(spark, str(tmp_path))
    assert sorted(r.id for r in whole.collect()) == [0, 1, 7]
    assert {r._raw_file_index for r in whole.collect()} == {0, 1}


def test_features_from_lists_of_pairs(spark):
    df = spark.createDataFrame([(1, 2, 61096.1, [("g", (1.2, 5))])], "diaSourceId long, diaObjectId long, midpointMjdTai double, lc_features array<struct<band: string, features: struct<amplitude: double, n_points: long>>>")
    r = I.lightcurve_features(df).first()
    assert (r.feature_band, r.feature_amplitude, r.feature_n_points) == ("g", 1.2, 5)


def test_nights(spark):
    df = spark.createDataFrame([(61096.1,), (61097.1,), (61099.1,), (None,)], "midpointMjdTai double")
    got = {r.night: r.rows for r in I.split_nights(df, ["2026-02-25", "2026-02-26"], "midpointMjdTai").collect()}
    assert got == {"2026-02-25": 1, "2026-02-26": 1, "out_of_window": 1, "unknown": 1}


def test_nights_by_any_time(spark):
    rows = [(61096.1, None), (None, "2026-02-26T23:59:00"), (float("nan"), "2026-03-01 00:00:00"), (None, "no time"), (61200.0, "2026-02-25")]
    df = spark.createDataFrame(rows, "midpointMjdTai double, created_at string")
    got = [r.night_key for r in I.with_night(df, start="2026-02-25", stop="2026-02-27").collect()]
    assert got == ["2026-02-25", "2026-02-26", "out_of_window", "unknown", "out_of_window"]


def test_aliases(spark):
    df = spark.createDataFrame([(1, "12.5", "x", "r", 3)], "`r:diaObjectId` long, `r:ra` string, ra string, `r:band` string, other int")
    got = I.normalize(df)
    r = got.first()
    assert (r.internal_object_id, r.ra, r.band, r._unmapped_fields, r.internal_table_type) == (1, None, "r", '["r:ra","other"]', "sources")  # the plain name leads
    assert set(df.columns) <= set(got.columns) and "mag" not in got.columns


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, ("allowed", "allowed", "blocked", "blocked")), ({"filters": ["tag"]}, ("blocked",) * 4), ({"is_all_alert": False}, ("blocked",) * 4), ({"execution_partial": True}, ("blocked",) * 4),
        ({"packet_type": "unknown"}, ("unresolved", "unresolved", "unresolved", "blocked")), ({"lag_zero": None}, ("unresolved", "unresolved", "unresolved", "blocked")),
        ({"readable_rows": 9}, ("unresolved", "unresolved", "unresolved", "blocked")), ({"expected_total": 0, "readable_rows": 0}, ("unresolved", "unresolved", "unresolved", "blocked")),
        ({"nights": 2}, ("unresolved", "unresolved", "unresolved", "blocked")), ({"scope": "date_range", "nights": 2}, ("unresolved", "unresolved", "blocked", "unresolved")),
        ({"scope": "date_range", "filters": ["tag"]}, ("blocked",) * 4),
    ],
)
def test_claims(spark, change, want):
    run = {"run": 1, "scope": "single_night", "packet_type": "light_static", "is_all_alert": True, "filters": [], "execution_partial": False, "validation_status": "passed", "lag_zero": True, "expected_total": 10, "readable_rows": 10, "nights": 1}
    layout = "run int, scope string, packet_type string, is_all_alert boolean, filters array<string>, execution_partial boolean, validation_status string, lag_zero boolean, expected_total long, readable_rows long, nights int"
    r = R.completeness_claims(spark.createDataFrame([tuple((run | change).values())], layout)).first()
    assert tuple(r[c] for c in R.CLAIMS) == want


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "`r:diaSourceId` long, x string")
    kept, facts = I.deduplicate(df, ["none", "r:diaSourceId"], ["x"])
    assert sorted((r["r:diaSourceId"], r.x) for r in kept.collect()) == [(1, "a"), (2, "c")]
    assert (facts.first().rows, facts.first().duplicates) == (3, 1)


def test_checks(spark):
    df = spark.createDataFrame([("a", 361.0, -91.0, 2450000.0), ("a", 1.0, 1.0, None)], "object_id string, ra double, dec double, jd double")
    got = {r.check: (r.passed, r.bad_rows) for r in Q.range_checks(df, {"ra": "ra", "dec": "dec", "jd": "jd"}).collect()}
    assert got == {"ra_range": (False, 1), "dec_range": (False, 1), "jd_range": (True, 0)}
    assert Q.duplicate_check(df, ["object_id"]).first().bad_rows == 1
    assert Q.status_rollup(Q.validate_table(df, "objects")).first().status == "failed"
    assert Q.range_checks(df.limit(0), {"ra": "ra"}).first().passed


def test_capped_windows(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (1.6,)], "t double")
    got = [(r.part, r.rows, r.status) for r in L.partition_windows(df, "t", 0.0, 3.0, 3, 2).orderBy("part").collect()]
    assert got == [(0, 1, "exhausted"), (1, 2, "possibly_truncated"), (2, 0, "empty")]
    assert L.refine_windows(df, "t", 0.0, 4.0, 2, 2, 4)[1] == 4


def test_cone_search_over_zero_hours(spark):
    df = spark.createDataFrame([(1, 359.999, 0.0), (2, 0.001, 0.0), (3, 180.0, 0.0)], "source_id long, ra double, dec double")
    assert [r.source_id for r in L.cone_search(df, 0.0, 0.0, 10.0, 10).orderBy("source_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        L.cone_search(df, 0.0, 0.0, 61.0, 10)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)] + [(float("nan"),), (None,)], "x double")
    assert {r.bin: r.n for r in X.histogram(df, "x", 2).collect()} == {0: 2, 1: 3}
    assert {r.bin: r.n for r in X.histogram(df.where("x = 2"), "x", 4).collect()} == {2: 1}


def test_chi_like(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 1.0), (2, 5.0, 1.0), (1, 9.0, 0.0)], "o long, f double, e double")
    assert [(r.object_id, r.n, r.chi_like) for r in X.chi_like(df, "o", "f", "e").collect()] == [(1, 2, 2.0)]
    far = spark.createDataFrame([(1, 1e8 + 0.1, 0.01), (1, 1e8 + 0.2, 0.01), (1, 1e8 + 0.3, 0.01)], "o long, f double, e double")
    assert abs(X.chi_like(far, "o", "f", "e").first().chi_like - 100) < 1e-3


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 2.0), [1e300, -1e300, 5.0, 5.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0.0, 0.001, 0.3, 0.3001, 0.5, 0.87, 1.0]
    for accuracy in (20, 200, 10_000):
        assert np.allclose(X.quantiles(df, shares, accuracy), np.quantile(x, shares), rtol=1e-12)
    inside, n = X.brackets(df, [0.25, 0.5], 200)
    assert n == len(x) and len(inside) == 2 and sum(((x >= a) & (x <= b)).sum() for a, b in inside) < len(x) / 10
    assert X.ranked_values(df, [(0.0, 0.1)], [0, len(x) - 1]).collect() == []  # ranks that no interval holds are not made up
    assert X.quantiles(df.limit(0), [0.5]) == [] and X.quantiles(df.where("x = 5"), [0.1, 0.9]) == [5.0, 5.0]


def plan_after_run(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_ranks_inside_brackets_take_one_scan(spark):
    """The counts are used twice, and the second use reads the first one's shuffle."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("value").alias("x"))
    plan = plan_after_run(X.ranked_values(events, [(10.0, 12.0), (50.0, 51.0)], [5, 100, 500]))
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1


def test_banded_samples_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(k, 1.0, 2.0, "r" if k % 3 else None) for k in range(60)] + [(99, None, 1.0, "g")], "id long, ra double, dec double, band string")
    picked = X.sky_sample(df, "ra", "dec", "id", 7, by="band")
    assert sorted((r.band or "", r["count"]) for r in picked.groupBy("band").count().collect()) == [("", 7), ("r", 7)]
    assert {r.id for r in picked.collect()} == {r.id for r in X.sky_sample(df.repartition(5), "ra", "dec", "id", 7, by="band").collect()}
    plan = picked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_flatten_skips_heavy_columns(spark):
    df = spark.createDataFrame([(1, (2, 3.0), bytearray(b"x"))], "diaSourceId long, diaSource struct<id: long, flux: double>, cutoutScience binary")
    flat, skipped = X.flatten(df, {"diaSource": ["flux"]})
    assert flat.columns == ["diaSourceId", "diaSource_flux"] and skipped == ["cutoutScience"]


def test_walk_json(spark):
    df = spark.createDataFrame([('{"a": {"objectId": 12, "list": [{"sourceId": 7}, {"sourceId": 7}]}}',), ("not json",), (None,)], "j string")
    found = L.candidate_ids(L.walk_json(df, "j"))
    assert sorted((r.id_type, r.confidence, r.value) for r in found.collect()) == [("diaObjectId", "high", "12"), ("other_source_ids", "medium", "7")]
    deep = spark.createDataFrame([('{"a":' * 9 + '{"objectId": 5, "x": [true, "t", null]}' + "}" * 9,)], "j string")
    got = sorted((r.field, r.value) for r in L.walk_json(deep, "j").collect() if r.value is not None)
    assert got == [("objectId", "5"), ("x", "t"), ("x", "true")]
    assert L.walk_json(deep, "j").count() == 4


def test_identifiers(spark):
    text = '{"r:diaSourceId": "a1", "xDiaObjectId": 3.0, "my-object-id": -4, "object_id_known": true, "SourceUID": " none ", "source_id": 2.5, "objectId": null, "objectIds": [8, 9], "sid": 5}'
    found = L.candidate_ids(L.walk_json(spark.createDataFrame([(text,)], "j string"), "j"))
    assert sorted((r.id_type, r.value) for r in found.collect()) == [("diaObjectId", "3.0"), ("diaSourceId", "a1")]
    assert L.best_candidate(found, "object").first().value == "3.0"
    told = {r.id_type: (r.ids, r.examples) for r in L.candidate_summary(found).collect()}
    assert {r.id_type for r in found.collect() if r.path.startswith("$")} == {"diaObjectId", "diaSourceId"}
    assert told == {"diaObjectId": (1, '["3.0"]'), "diaSourceId": (1, '["a1"]'), "other_object_ids": (0, "[]"), "other_source_ids": (0, "[]")}


def test_time_columns_count_only_numbers(spark):
    from skyledger.functions.timescale import rows_in_window

    df = spark.createDataFrame([("60310.5",), ("x",), (None,)], "t string")
    r = rows_in_window(df, ["t"], "2024-01-01", "2024-01-02").first()
    assert (r.rows, r.inside, r.all_inside) == (1, 1, True)
    assert dt.date(2024, 1, 1).isoformat() == "2024-01-01"
