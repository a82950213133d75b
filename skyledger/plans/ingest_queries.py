"""Queries of ingestion, quality and time."""

from pyspark.sql import functions as F

from skyledger.functions import scalars as S
from skyledger.functions import timescale as T
from skyledger.operators import ingest as I
from skyledger.operators import quality as Q
from skyledger.operators import runs as R
from skyledger.plans.catalog_queries import sources
from skyledger.plans.registry import query
from skyledger.plans.sql import over_packets
from skyledger.sources.adapters import acquisition_table, packets, table


@query("normalized_sources", over_packets("""
SELECT 'sources' AS internal_table_type, raw_object_id AS internal_object_id, source_id AS internal_source_id, source_id AS "diaSourceId", ra, dec, round(mjd_tai, 6) AS time_mjd, band, flux, flux_err,
  flux AS "psfFlux", '["pred","clf","lc_features"]' AS _unmapped_fields FROM sources"""))
def normalized_sources(spark, sf_dir):
    names = "internal_table_type internal_object_id internal_source_id diaSourceId ra dec time_mjd band flux flux_err psfFlux _unmapped_fields".split()
    return I.normalize(packets(spark, sf_dir)).select(*names).withColumn("time_mjd", F.round("time_mjd", 6))


@query("lc_feature_rows", over_packets("SELECT source_id AS \"diaSourceId\", band AS feature_band, flux AS feature_mean, k AS feature_n FROM sources WHERE k % 10 <> 0"))
def lc_feature_rows(spark, sf_dir):
    return I.lightcurve_features(packets(spark, sf_dir)).select("diaSourceId", "feature_band", "feature_mean", "feature_n")


@query("feature_summary", over_packets("SELECT band AS value, count(*) AS n FROM sources WHERE k % 10 <> 0 GROUP BY 1"))
def feature_summary(spark, sf_dir):
    from skyledger.operators.explore import value_counts

    return value_counts(I.lightcurve_features(packets(spark, sf_dir)), "feature_band")


@query("nightly_summary", over_packets("""
SELECT night::VARCHAR AS night_key, count(*) AS alerts, count(source_id) AS with_source, count(raw_object_id) AS with_object, count(DISTINCT band) AS bands, min(ra) AS ra_min, max(ra) AS ra_max,
  min(dec) AS dec_min, max(dec) AS dec_max, min(flux) AS flux_min, max(flux) AS flux_max, count(*) FILTER (flux < 0) AS negative_flux FROM sources GROUP BY 1"""))
def nightly_summary(spark, sf_dir):
    return I.nightly_summary(packets(spark, sf_dir), by_night=True).drop("first_mjd", "last_mjd", "band_list")


@query("family_nights", over_packets("""
, t AS (SELECT 'alerts' AS table_name, night FROM sources UNION ALL SELECT 'objects', (SELECT s.night FROM sources s WHERE s.raw_object_id = g.raw_object_id ORDER BY s.source_id LIMIT 1) FROM (SELECT DISTINCT raw_object_id FROM sources WHERE raw_object_id > 0) g
  UNION ALL SELECT 'lightcurve_features', night FROM sources WHERE k % 10 <> 0)
SELECT table_name, night::VARCHAR AS night_key, count(*) AS rows FROM t GROUP BY 1, 2 UNION ALL SELECT 'classifications', 'unsplit', count(*) FROM sources"""))
def family_nights(spark, sf_dir):
    """Rows by night of the tables of a family; one of them has no time."""
    family = I.table_family(packets(spark, sf_dir))
    return I.table_counts({k: family[k] for k in ("alerts", "objects", "lightcurve_features", "classifications")})


@query("night_split_counts", over_packets("SELECT CASE WHEN night BETWEEN DATE '2024-01-03' AND DATE '2024-01-04' THEN night::VARCHAR ELSE 'out_of_window' END AS night, count(*) AS rows FROM sources GROUP BY 1"))
def night_split_counts(spark, sf_dir):
    return I.split_nights(packets(spark, sf_dir), ["2024-01-03", "2024-01-04"], "midpointMjdTai")


@query("first_objects", over_packets("""
SELECT source_id AS \"diaSourceId\", raw_object_id AS \"diaObjectId\", band FROM (SELECT *, row_number() OVER (PARTITION BY raw_object_id ORDER BY source_id) AS r FROM sources WHERE raw_object_id > 0) WHERE r = 1"""))
def first_objects(spark, sf_dir):
    return I.table_family(packets(spark, sf_dir))["objects"].select("diaSourceId", "diaObjectId", "band")


@query("family_shapes", over_packets("""
SELECT 'alerts' AS table_name, count(*) AS rows FROM sources UNION ALL SELECT 'objects', count(DISTINCT raw_object_id) FILTER (raw_object_id > 0) FROM sources UNION ALL SELECT 'forced_photometry', count(*) FROM sources
UNION ALL SELECT 'classifications', count(*) FROM sources UNION ALL SELECT 'lightcurve_features', count(*) FILTER (k % 10 <> 0) FROM sources UNION ALL SELECT 'nightly_summary', 1"""))
def family_shapes(spark, sf_dir):
    from functools import reduce

    family = I.table_family(packets(spark, sf_dir), run_name="demo")
    return reduce(lambda a, b: a.unionByName(b), (df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in family.items()))


@query("sample_objects", over_packets("""
SELECT raw_object_id AS \"diaObjectId\", count(*) AS rows, count(DISTINCT source_id) AS sources, string_agg(DISTINCT band, ',' ORDER BY band) AS bands, arg_min(ra, mjd_tai) AS ra, arg_min(dec, mjd_tai) AS dec
FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1"""))
def sample_objects(spark, sf_dir):
    return I.sample_objects(packets(spark, sf_dir)).drop("first_mjd", "last_mjd")


@query("first_lineitems", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1""")
def first_lineitems(spark, sf_dir):
    kept, _ = I.deduplicate(table(spark, sf_dir, "lineitem"), ["absent", "l_orderkey"], ["l_linenumber", "l_partkey"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query("duplicate_rate", "SELECT 'l_orderkey' AS key, count(*) AS rows, count(DISTINCT l_orderkey) AS kept, count(*) - count(DISTINCT l_orderkey) AS duplicates, round((count(*) - count(DISTINCT l_orderkey)) / count(*)::DOUBLE, 9) AS rate FROM lineitem")
def duplicate_rate(spark, sf_dir):
    return I.deduplicate(table(spark, sf_dir, "lineitem"), ["absent", "l_orderkey"], ["l_linenumber"])[1]


@query("nested_summary", over_packets("""
, f AS (SELECT string_agg('{"is_sso":' || is_sso || '}', ' ' ORDER BY source_id) AS pred, string_agg('{"cats_class":' || cats_class || ',"cats_score":' || CASE WHEN k % 25 = 0 THEN 'null' ELSE cats_score::VARCHAR END || '}', ' ' ORDER BY source_id) AS clf FROM (SELECT * FROM sources ORDER BY source_id LIMIT 3))
SELECT 'pred' AS "column", 'struct' AS kind, count(*) AS rows, count(*) AS filled, (SELECT pred FROM f) AS examples FROM sources UNION ALL SELECT 'clf', 'struct', count(*), count(*), (SELECT clf FROM f) FROM sources"""))
def nested_summary(spark, sf_dir):
    return I.nested_summary(packets(spark, sf_dir).drop("lc_features"), "diaSourceId")


@query("shadow_json", over_packets("SELECT source_id AS \"diaSourceId\", '{\"is_sso\":' || is_sso || '}' AS pred_json FROM sources"))
def shadow_json(spark, sf_dir):
    return I.shadow_json(packets(spark, sf_dir)).select("diaSourceId", "pred_json")


@query("outer_union", "SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS role FROM orders UNION ALL SELECT conv_id, NULL, role FROM conversations")
def outer_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role")
    return I.outer_union([a, b])


@query("tag_rows", "SELECT r_name AS tag, 'region ' || r_regionkey AS description FROM region")
def tag_rows(spark, sf_dir):
    """A dictionary of tags, made of the regions."""
    entry = F.struct(F.concat(F.lit("region "), F.col("r_regionkey")).alias("description"))
    whole = table(spark, sf_dir, "region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", entry)))).alias("tags"))
    return I.tag_rows(whole, "tags")


@query("canonical_json_hash", over_packets("SELECT source_id AS \"diaSourceId\", sha256('{\"band\":\"' || band || '\",\"id\":\"' || source_id || '\"}') AS digest FROM sources"))
def canonical_json_hash(spark, sf_dir):
    m = F.create_map(F.lit("id"), F.col("diaSourceId").cast("string"), F.lit("band"), F.col("band"))
    return packets(spark, sf_dir).select("diaSourceId", S.fingerprint(S.canonical_map_json(m)).alias("digest"))


@query("safe_column_names", "SELECT event_type || ' / #1' AS name, event_type || '_1' AS slug FROM events GROUP BY event_type")
def safe_column_names(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" / #1")).alias("name")).distinct()
    return names.select("name", S.slug(F.col("name")).alias("slug"))


@query("mjd_round_trip", "SELECT o_orderkey, date_diff('day', DATE '1858-11-17', o_orderdate::DATE) AS mjd, o_orderdate::DATE AS day FROM orders")
def mjd_round_trip(spark, sf_dir):
    mjd = T.date_to_mjd(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", mjd.alias("mjd"), T.mjd_to_date(mjd).alias("day"))


@query("calendar_edges", "SELECT d.utc_date, round(date_diff('day', DATE '1858-11-17', d.utc_date) + 37 / 86400.0::DOUBLE, 9) AS tai_start FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS utc_date FROM events) d")
def calendar_edges(spark, sf_dir):
    """The days from the first to the last event."""
    span = table(spark, sf_dir, "events").agg(F.min("ts").cast("date").cast("string").alias("a"), F.date_add(F.max("ts").cast("date"), 1).cast("string").alias("b")).first()
    return T.calendar(spark, span.a, span.b).select("utc_date", F.round("tai_start", 9).alias("tai_start"))


@query("parsed_dates", "SELECT o_orderkey, try_cast(left(o_orderdate::VARCHAR, 10) AS DATE) AS day, left(o_orderdate::VARCHAR, 10) >= '1995-01-01' AS usable FROM orders")
def parsed_dates(spark, sf_dir):
    text = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(text, "1995-01-01").alias("p")).select("o_orderkey", "p.day", "p.usable")


@query("range_checks", """
SELECT 'ra_range' AS "check", true AS passed, 'error' AS severity, 0::BIGINT AS bad_rows UNION ALL SELECT 'dec_range', count(*) FILTER (l_quantity > 90) = 0, 'error', count(*) FILTER (l_quantity > 90) FROM lineitem
UNION ALL SELECT 'mag_range', count(*) FILTER (l_extendedprice > 50) = 0, 'error', count(*) FILTER (l_extendedprice > 50) FROM lineitem""")
def range_checks(spark, sf_dir):
    return Q.range_checks(table(spark, sf_dir, "lineitem").withColumn("zero", F.lit(0.0)), {"ra": "zero", "dec": "l_quantity", "mag": "l_extendedprice"})


CHECKS = over_packets("""
, c AS (SELECT 'non_empty' AS "check", count(*) > 0 AS passed, 'error' AS severity, (count(*) = 0)::BIGINT AS bad_rows FROM sources UNION ALL SELECT 'required_columns', true, 'error', 0
UNION ALL SELECT 'source_id_present', count(*) FILTER (source_id IS NULL) = 0, 'error', count(*) FILTER (source_id IS NULL) FROM sources
UNION ALL SELECT 'ra_range', true, 'error', count(*) FILTER (ra NOT BETWEEN 0 AND 360) FROM sources UNION ALL SELECT 'dec_range', true, 'error', count(*) FILTER (dec NOT BETWEEN -90 AND 90) FROM sources
UNION ALL SELECT 'mjd_range', true, 'error', count(*) FILTER (mjd_tai NOT BETWEEN 30000 AND 100000) FROM sources UNION ALL SELECT 'jd_range', true, 'error', 0 UNION ALL SELECT 'mag_range', true, 'error', 0
UNION ALL SELECT 'duplicate_keys', count(*) = count(DISTINCT source_id), 'error', count(*) - count(DISTINCT source_id) FROM sources UNION ALL SELECT 'flux_err_not_negative', true, 'error', count(*) FILTER (flux_err < 0) FROM sources)
""")


@query("table_checks", CHECKS + 'SELECT "check", passed, severity, bad_rows::BIGINT AS bad_rows FROM c')
def table_checks(spark, sf_dir):
    names = {"source_id": "internal_source_id", "ra": "ra", "dec": "dec", "mjd": "time_mjd", "flux_err": "flux_err"}
    rows = I.normalize(packets(spark, sf_dir)).select(*(F.col(c).alias(n) for n, c in names.items()), *(F.lit(None).cast("double").alias(n) for n in ("jd", "mag")))
    return Q.validate_table(rows, "sources")


@query("check_status", CHECKS + "SELECT CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'failed' ELSE 'passed' END AS status, count(*) FILTER (NOT passed) AS errors, 0::BIGINT AS warnings, count(*) AS checks FROM c")
def check_status(spark, sf_dir):
    return Q.status_rollup(table_checks(spark, sf_dir))


@query("night_coverage", over_packets(", d AS (SELECT d::DATE AS night FROM generate_series(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY) g(d)) SELECT d.night, CASE WHEN count(s.source_id) > 0 THEN 'present' ELSE 'missing' END AS status FROM d LEFT JOIN sources s ON s.utc_day = d.night GROUP BY 1"))
def night_coverage(spark, sf_dir):
    expected = T.calendar(spark, "2024-01-01", "2024-02-03").select(F.col("utc_date").alias("night"))
    return Q.night_coverage(sources(spark, sf_dir), T.utc_date(F.col("mjd_tai")), expected)


RUNS = """
WITH asked AS (SELECT *, (['smoke', 'single_night', 'single_night', 'multi_night', 'full_week', 'date_range', 'date_range', 'elsewhere', 'smoke_delivery', 'full_night', 'full_night_all_alerts', 'tag_filtered_smoke_delivery', 'full_week_full_packet', 'date_range', 'full_month', 'bounded_tag'])[(user_id % 16 + 1)::INT] AS asked, user_id AS run FROM (SELECT user_id, count(*) AS n, min(event_id) AS e FROM events GROUP BY user_id)),
runs AS (SELECT run, n, asked, CASE asked WHEN 'smoke_delivery' THEN 'smoke' WHEN 'tag_filtered_smoke_delivery' THEN 'bounded_tag' WHEN 'full_night' THEN 'single_night' WHEN 'full_night_all_alerts' THEN 'single_night' WHEN 'full_week_full_packet' THEN 'full_week' ELSE asked END AS scope,
  (['light_static', 'light_static', 'light_static', 'light_static', 'full', 'unknown', 'odd'])[(e % 7 + 1)::INT] AS packet_type, run % 11 <> 3 AS is_all_alert, CASE WHEN run % 13 = 1 THEN 1 ELSE 0 END AS n_filters,
  (['declared', 'raw_partial', 'validated', 'validated', 'validated_with_warnings', 'ingested', 'failed', 'nowhere'])[(e % 8 + 1)::INT] AS lifecycle_state,
  (['raw_inspected', 'validated', 'archived', 'failed', 'declared'])[(n % 5 + 1)::INT] AS later_state, run % 17 = 2 AS execution_partial,
  CASE WHEN run % 5 = 0 THEN 'failed' ELSE 'passed' END AS validation_status, CASE WHEN run % 9 <> 0 THEN run % 6 <> 1 END AS lag_zero,
  CASE WHEN run % 3 <> 0 THEN n END AS expected_total, n - CASE WHEN run % 7 = 0 THEN 1 ELSE 0 END AS readable_rows, CASE WHEN run % 8 IN (3, 4, 5) THEN 3 ELSE 1 END AS nights,
  DATE '2024-01-01' AS start, DATE '2024-01-01' + (CASE WHEN run % 8 IN (3, 4, 5, 6) THEN 3 ELSE 1 END - CASE WHEN run % 19 = 4 THEN 3 ELSE 0 END)::INT AS stop,
  CASE WHEN e % 3 = 0 THEN 'allowed' ELSE 'unresolved' END AS c0, CASE WHEN e % 4 = 0 THEN 'allowed' ELSE 'blocked' END AS c1, CASE WHEN e % 5 = 0 THEN 'allowed' ELSE 'rejected' END AS c2,
  CASE WHEN e % 6 = 0 THEN 'allowed' WHEN e % 6 = 1 THEN 'perhaps' ELSE 'blocked' END AS c3 FROM asked)
"""


ASKED = [
    "smoke", "single_night", "single_night", "multi_night", "full_week", "date_range", "date_range", "elsewhere", "smoke_delivery", "full_night", "full_night_all_alerts",
    "tag_filtered_smoke_delivery", "full_week_full_packet", "date_range", "full_month", "bounded_tag",
]


def runs(spark, sf_dir):
    """A run a user, with entries by fixed formulas that meet every branch of the rules."""
    u, n, e = F.col("run"), F.col("n"), F.col("e")
    one_of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("e"))
    long = lambda *k: F.when((u % 8).isin(*k), 3).otherwise(1)
    allowed = lambda k, other: F.when(e % k == 0, "allowed").otherwise(other)
    return g.select(
        "run", "n", one_of(ASKED, u).alias("scope"),
        one_of(["light_static", "light_static", "light_static", "light_static", "full", "unknown", "odd"], e).alias("packet_type"), (u % 11 != 3).alias("is_all_alert"),
        F.when(u % 13 == 1, F.array(F.lit("tag=x"))).otherwise(F.array().cast("array<string>")).alias("filters"),
        one_of(["declared", "raw_partial", "validated", "validated", "validated_with_warnings", "ingested", "failed", "nowhere"], e).alias("lifecycle_state"),
        one_of(["raw_inspected", "validated", "archived", "failed", "declared"], n).alias("later_state"), (u % 17 == 2).alias("execution_partial"),
        F.when(u % 5 == 0, "failed").otherwise("passed").alias("validation_status"), F.when(u % 9 != 0, u % 6 != 1).alias("lag_zero"),
        F.when(u % 3 != 0, n).alias("expected_total"), (n - F.when(u % 7 == 0, 1).otherwise(0)).alias("readable_rows"), long(3, 4, 5).alias("nights"),
        F.lit("2024-01-01").cast("date").alias("start"), F.date_add(F.lit("2024-01-01").cast("date"), long(3, 4, 5, 6) - F.when(u % 19 == 4, 3).otherwise(0)).alias("stop"),
        allowed(3, "unresolved").alias(R.CLAIMS[0]), allowed(4, "blocked").alias(R.CLAIMS[1]), allowed(5, "rejected").alias(R.CLAIMS[2]),
        F.when(e % 6 == 0, "allowed").when(e % 6 == 1, "perhaps").otherwise("blocked").alias(R.CLAIMS[3]),
    )


@query("completeness_claims", RUNS + """
, j AS (SELECT run, scope, CASE WHEN execution_partial OR n_filters > 0 OR NOT is_all_alert THEN 'partial/debug or filtered run cannot support completeness claims' WHEN packet_type = 'unknown' THEN 'packet type is unknown'
  WHEN validation_status = 'passed' AND lag_zero AND expected_total > 0 AND readable_rows = expected_total AND nights = 1 THEN 'strict single-night evidence is present' ELSE 'strict completeness evidence is not present' END AS reason FROM runs),
k AS (SELECT *, CASE WHEN reason LIKE 'partial%' THEN 'blocked' WHEN reason LIKE 'strict single%' THEN 'allowed' ELSE 'unresolved' END AS every FROM j)
SELECT run, every AS all_alert_completeness, every AS night_completeness, CASE WHEN scope = 'date_range' OR every <> 'unresolved' THEN 'blocked' ELSE 'unresolved' END AS week_completeness,
  CASE WHEN scope = 'date_range' AND every <> 'blocked' THEN 'unresolved' ELSE 'blocked' END AS range_completeness, reason FROM k""")
def completeness_claims(spark, sf_dir):
    return R.completeness_claims(runs(spark, sf_dir))


@query("default_claims", RUNS + """
, f AS (SELECT *, lifecycle_state IN ('declared', 'topic_registered', 'download_pending', 'download_active', 'raw_missing', 'raw_partial') AS raw, n_filters > 0 OR NOT is_all_alert AS bare FROM runs),
o AS (SELECT run, scope, CASE WHEN scope = 'date_range' THEN NOT (bare OR packet_type <> 'light_static' OR raw) ELSE NOT (raw OR bare) END AS open,
  CASE WHEN scope = 'date_range' THEN false WHEN raw THEN n_filters = 0 WHEN bare THEN false WHEN packet_type = 'unknown' THEN true ELSE scope IN ('full_week', 'full_month', 'multi_night') END AS week,
  scope = 'date_range' AND NOT bare AND packet_type = 'light_static' AS ranged FROM f)
SELECT run, CASE WHEN open THEN 'unresolved' ELSE 'blocked' END AS all_alert_completeness, CASE WHEN open THEN 'unresolved' ELSE 'blocked' END AS night_completeness,
  CASE WHEN week THEN 'unresolved' ELSE 'blocked' END AS week_completeness, CASE WHEN ranged THEN 'unresolved' ELSE 'blocked' END AS range_completeness FROM o""")
def default_claims(spark, sf_dir):
    return R.default_claims(runs(spark, sf_dir))


@query("run_problems", RUNS + """
, f AS (SELECT *, date_diff('day', start, stop) AS days, lifecycle_state IN ('declared', 'topic_registered', 'download_pending', 'download_active', 'raw_missing', 'raw_partial') AS raw FROM runs)
SELECT run, concat_ws('; ', CASE WHEN days <= 0 THEN 'startdate must be before stopdate' END, CASE WHEN days > 0 AND nights <> days THEN 'expected_nights must match the half-open UTC startdate/stopdate window' END,
  CASE WHEN scope = 'elsewhere' THEN 'Unsupported run scope: elsewhere' END, CASE WHEN lifecycle_state = 'nowhere' THEN 'Unsupported lifecycle state: nowhere' END, CASE WHEN c3 = 'perhaps' THEN 'range_completeness: Unsupported claim state: perhaps' END,
  CASE WHEN packet_type = 'odd' THEN 'packet_type must be one of [''full'', ''light_static'', ''medium'', ''unknown'']' END,
  CASE WHEN n_filters > 0 AND is_all_alert THEN 'filters imply is_all_alert = false' END, CASE WHEN n_filters > 0 AND is_all_alert THEN 'all-alert manifests must not have filters' END,
  CASE WHEN scope = 'date_range' AND packet_type <> 'light_static' THEN 'date_range scope is defined only for packet_type light_static' END,
  CASE WHEN scope = 'date_range' AND (n_filters > 0 OR NOT is_all_alert) THEN 'date_range scope is defined only for unfiltered all-alert requests' END,
  CASE WHEN scope = 'date_range' AND days < 2 THEN 'date_range scope needs at least two nights; use full_night for one night' END,
  CASE WHEN raw AND c0 = 'allowed' THEN 'all_alert_completeness cannot be allowed while lifecycle_state is ' || lifecycle_state END, CASE WHEN raw AND c1 = 'allowed' THEN 'night_completeness cannot be allowed while lifecycle_state is ' || lifecycle_state END,
  CASE WHEN raw AND c2 = 'allowed' THEN 'week_completeness cannot be allowed while lifecycle_state is ' || lifecycle_state END, CASE WHEN raw AND c3 = 'allowed' THEN 'range_completeness cannot be allowed while lifecycle_state is ' || lifecycle_state END,
  CASE WHEN n_filters > 0 AND c0 = 'allowed' THEN 'tag-filtered runs cannot allow all-alert completeness claims' END,
  CASE WHEN c2 = 'allowed' THEN 'week_completeness cannot be allowed by default' END, CASE WHEN c3 = 'allowed' THEN 'range_completeness cannot be allowed by default' END) AS problems,
  concat_ws('; ', CASE WHEN packet_type = 'unknown' THEN 'unknown packet_type keeps completeness claims strict' END,
  CASE WHEN NOT is_all_alert AND n_filters = 0 AND scope IN ('single_night', 'multi_night', 'full_week', 'full_month', 'date_range') THEN 'unfiltered non-all-alert manifest has conservative completeness claims' END,
  CASE WHEN lifecycle_state = 'validated_with_warnings' AND 'allowed' IN (c0, c1, c2, c3) THEN 'validated_with_warnings requires explicit review before allowing claims' END) AS warnings FROM f""")
def run_problems(spark, sf_dir):
    return R.run_rules(runs(spark, sf_dir)).select("run", F.array_join("errors", "; ").alias("problems"), F.array_join("warnings", "; ").alias("warnings"))


@query("illegal_transitions", RUNS + """
SELECT run, lifecycle_state AS from_state, later_state AS to_state FROM runs WHERE NOT ((lifecycle_state = later_state AND lifecycle_state <> 'nowhere') OR (lifecycle_state IN ('declared', 'raw_partial', 'validated_with_warnings', 'ingested') AND later_state = 'failed') OR (lifecycle_state = 'raw_partial' AND later_state = 'raw_inspected')
  OR (lifecycle_state IN ('validated', 'validated_with_warnings', 'failed') AND later_state = 'archived') OR (lifecycle_state IN ('validated_with_warnings', 'ingested') AND later_state = 'validated') OR (lifecycle_state = 'failed' AND later_state = 'declared'))""")
def illegal_transitions(spark, sf_dir):
    return R.illegal_steps(runs(spark, sf_dir).select("run", F.col("lifecycle_state").alias("from_state"), F.col("later_state").alias("to_state")))


@query("run_policies", """
WITH s AS (SELECT user_id AS run, (['smoke_delivery', 'tag_filtered_smoke_delivery', 'full_night', 'full_night_all_alerts', 'full_week', 'full_week_full_packet', 'date_range', 'elsewhere'])[(user_id % 8 + 1)::INT] AS given FROM events GROUP BY 1),
n AS (SELECT run, CASE given WHEN 'tag_filtered_smoke_delivery' THEN 'smoke_delivery' WHEN 'full_night_all_alerts' THEN 'full_night' ELSE given END AS scope FROM s),
p AS (SELECT * FROM (VALUES ('smoke_delivery', 'smoke_delivery', true, false, true, false, 'light_static', 'Light static packet', 'blocked', true), ('full_night', 'full_night', false, true, true, false, 'light_static', 'Light static packet', 'unresolved', true),
  ('full_week', 'full_week', false, true, false, true, 'light_static', 'Light static packet', 'unresolved', true), ('full_week_full_packet', 'full_week_full_packet', false, true, false, true, 'full', 'Full packet', 'unresolved', true),
  ('date_range', 'date_range', false, true, false, true, 'light_static', 'Light static packet', 'unresolved', true))
  p(scope, path_component, is_tag_filtered, is_all_alert, is_single_night, is_multi_night, packet_type, content_type, completeness_default, allow_completeness_only_after_validation))
SELECT n.run, n.scope, p.scope IS NOT NULL AS supported, p.* EXCLUDE (scope) FROM n LEFT JOIN p ON n.scope = p.scope""")
def run_policies(spark, sf_dir):
    given = ["smoke_delivery", "tag_filtered_smoke_delivery", "full_night", "full_night_all_alerts", "full_week", "full_week_full_packet", "date_range", "elsewhere"]
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("run")).distinct()
    return R.with_policy(users.withColumn("scope", F.element_at(F.array(*map(F.lit, given)), (F.col("run") % 8 + 1).cast("int"))))


READINESS = """
WITH a AS (SELECT l_suppkey AS delivery, l_suppkey % 10 <> 3 AS present, CASE WHEN l_suppkey % 10 = 4 THEN 0 ELSE count(*) END AS files, count(*) AS parquet_files,
  CASE WHEN l_suppkey % 10 = 5 THEN count(*) ELSE count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 10 = 6) END AS unreadable, l_suppkey % 10 = 7 AS active, CASE WHEN l_suppkey % 10 = 8 THEN 2 ELSE 0 END AS tiny,
  CASE WHEN l_suppkey % 30 = 19 THEN 0 ELSE sum(l_quantity)::BIGINT END AS readable_rows, CASE WHEN l_suppkey % 10 = 9 THEN 0 ELSE 600 * count(*) // 20 END AS expected_total, CASE WHEN l_suppkey % 4 <> 0 THEN 1000 END AS progress,
  CASE WHEN l_suppkey % 10 = 2 THEN 19.5::DOUBLE ELSE 20.0::DOUBLE END AS free_gb FROM lineitem GROUP BY 1),
s AS (SELECT *, nullif(expected_total, 0) AS expected, CASE WHEN free_gb < 20 THEN 1 WHEN NOT present THEN 2 WHEN files = 0 THEN 3 WHEN unreadable > 0 AND unreadable = parquet_files THEN 4 WHEN active THEN 5 WHEN unreadable > 0 THEN 6
  WHEN tiny > 0 THEN 7 WHEN expected_total > 0 AND readable_rows < expected_total THEN 8 WHEN expected_total > 0 THEN 9 WHEN readable_rows > 0 THEN 10 ELSE 11 END AS k FROM a),
l AS (SELECT * FROM (VALUES (1, 'blocked_disk_risk', 'Free disk space is below the configured safety threshold.'), (2, 'raw_missing', 'Raw directory is missing.'), (3, 'raw_missing', 'Raw directory exists but contains no delivery files.'),
  (4, 'blocked_corrupt_raw', 'All discovered Parquet files are unreadable.'), (5, 'download_active', 'Files were modified recently; download may still be active.'), (6, 'partial_with_errors', 'Some Parquet files are unreadable.'),
  (7, 'partial_download', 'Tiny suspicious files were detected.'), (8, 'partial_download', 'Readable rows are below the expected terminal total.'),
  (9, 'ready_for_raw_schema_inspection', 'Readable rows meet or exceed the expected total; raw download appears complete but unvalidated.'), (10, 'appears_complete_unverified', 'Readable rows exist, but no expected total was supplied.'),
  (11, 'partial_download', 'No readable rows were counted.')) l(k, state, reason))
"""


@query("raw_readiness", READINESS + """
SELECT delivery, state, reason, k = 9 AS raw_download_appears_complete, k IN (9, 10) AS ingestion_allowed, round(readable_rows / expected * 100, 6) AS apparent_percent_complete, greatest(expected - readable_rows, 0)::BIGINT * CASE WHEN expected IS NULL THEN NULL ELSE 1 END AS remaining_rows,
  (progress - readable_rows)::BIGINT AS terminal_progress_gap FROM s JOIN l USING (k)""")
def raw_readiness(spark, sf_dir):
    s, n = F.col("l_suppkey"), F.count("*")
    digit = lambda k: F.first(s) % 10 == k
    audits = table(spark, sf_dir, "lineitem").groupBy(s.alias("delivery")).agg(
        (~digit(3)).alias("present"), F.when(digit(4), 0).otherwise(n).alias("files"), n.alias("parquet_files"),
        F.when(digit(5), n).otherwise(F.count_if((F.col("l_returnflag") == "R") & (s % 10 == 6))).alias("unreadable"), digit(7).alias("active"), F.when(digit(8), 2).otherwise(0).alias("tiny"),
        F.when(F.first(s) % 30 == 19, 0).otherwise(F.sum("l_quantity").cast("long")).alias("readable_rows"), F.when(digit(9), 0).otherwise(F.floor(600 * n / 20)).alias("expected_total"),
        F.when(F.first(s) % 4 != 0, 1000).alias("progress"), F.when(digit(2), 19.5).otherwise(20.0).alias("free_gb"),
    )
    return R.raw_readiness(audits).withColumn("apparent_percent_complete", F.round("apparent_percent_complete", 6))


@query("run_scopes", """
WITH r AS (SELECT user_id AS run, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT run, ([1, 7, 8, 31, 32, 0, 2])[(run % 7 + 1)::INT] AS nights, run % 5 = 0 AS filtered, ([NULL, NULL, 'full_night', 'smoke_delivery', 'date_range', 'elsewhere', NULL, 'tag_filtered_smoke_delivery', 'full_night_all_alerts', 'full_week_full_packet', '', 'partial_schema_only'])[(n % 12 + 1)::INT] AS asked,
  (['Full-packet', 'Medium packet', 'Light static packet', 'Static', 'full medium', 'something', NULL])[(n % 7 + 1)::INT] AS content FROM r)
SELECT run, CASE asked WHEN 'full_night' THEN 'single_night' WHEN 'full_night_all_alerts' THEN 'single_night' WHEN 'smoke_delivery' THEN 'smoke' WHEN 'tag_filtered_smoke_delivery' THEN 'bounded_tag' WHEN 'full_week_full_packet' THEN 'full_week'
  WHEN 'date_range' THEN 'date_range' WHEN 'partial_schema_only' THEN 'partial_schema_only' WHEN 'elsewhere' THEN NULL
  ELSE CASE WHEN nights = 0 THEN NULL WHEN filtered THEN 'bounded_tag' WHEN nights = 1 THEN 'single_night' WHEN nights <= 7 THEN 'full_week' WHEN nights <= 31 THEN 'full_month' ELSE 'multi_night' END END AS scope,
  CASE WHEN content ILIKE '%full%' THEN 'full' WHEN content ILIKE '%medium%' THEN 'medium' WHEN content ILIKE '%light%' OR content ILIKE '%static%' THEN 'light_static' ELSE 'unknown' END AS packet_type FROM w""")
def run_scopes(spark, sf_dir):
    """A request a user: windows of all lengths, filters, and scopes that are asked for by name or alias."""
    asked = [None, None, "full_night", "smoke_delivery", "date_range", "elsewhere", None, "tag_filtered_smoke_delivery", "full_night_all_alerts", "full_week_full_packet", "", "partial_schema_only"]
    one_of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"))
    start = F.lit("2024-01-01").cast("date")
    stop = F.date_add(start, one_of([1, 7, 8, 31, 32, 0, 2], F.col("run")))
    filters = F.when(F.col("run") % 5 == 0, F.array(F.lit("tag=x"))).otherwise(F.array().cast("array<string>"))
    content = one_of(["Full-packet", "Medium packet", "Light static packet", "Static", "full medium", "something", None], F.col("n"))
    return r.select("run", R.infer_scope(start, stop, filters, one_of(asked, F.col("n")).cast("string")).alias("scope"), S.packet_type(content).alias("packet_type"))


@query("next_action", READINESS + """
SELECT delivery, state, CASE WHEN k = 1 THEN 'stop_due_to_disk_risk' WHEN k = 4 THEN 'inspect_partial_only' WHEN k = 5 THEN 'wait_and_check_again' WHEN k IN (9, 10) THEN 'ready_for_ingestion'
  ELSE 'resume_same_topic_same_directory' END AS action FROM s JOIN l USING (k)""")
def next_action(spark, sf_dir):
    return R.next_action(raw_readiness(spark, sf_dir))


@query("remaining_rows", RUNS + "SELECT run, CASE WHEN expected_total IS NOT NULL THEN greatest(expected_total - readable_rows, 0) END::BIGINT AS remaining FROM runs")
def remaining_rows(spark, sf_dir):
    return Q.remaining_rows(runs(spark, sf_dir).withColumnRenamed("expected_total", "expected_rows"))
