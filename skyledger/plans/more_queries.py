"""Queries of decisions, schema documents, and small conversions."""

import uuid

from pyspark.sql import functions as F

from skyledger.functions.nested import rewrite_counts, stable_json
from skyledger.functions.scalars import packet_type, text_of_bytes
from skyledger.functions.timescale import split_window, time_bucket, utc_to_tai
from skyledger.operators import decisions as Z
from skyledger.operators import documents as J
from skyledger.operators import lookup as L
from skyledger.operators.ingest import table_family
from skyledger.operators.sinks import write_tables
from skyledger.plans.catalog_queries import sources
from skyledger.plans.delivery_queries import scratch
from skyledger.plans.explore_queries import WINDOWS, capped_windows
from skyledger.plans.registry import query
from skyledger.plans.sql import over_packets
from skyledger.sources.adapters import packets, table


def asked(spark, sf_dir):
    return capped_windows(spark, sf_dir).withColumn("requested", F.lit(1300)).withColumn("rows", F.col("kept"))


@query("partition_checks", over_packets(WINDOWS + """
SELECT 'partition_status_recorded' AS "check", true AS passed, 'error' AS severity, 0::BIGINT AS bad_rows UNION ALL SELECT 'no_unbounded_queries', true, 'error', 0
UNION ALL SELECT 'row_count_within_requested_limit', true, 'error', count(*) FILTER (kept > 1300) FROM p UNION ALL SELECT 'cap_hits_marked_truncated', true, 'error', count(*) FILTER (kept = 1300 AND status <> 'possibly_truncated') FROM p
UNION ALL SELECT 'denominator_comparison_validity', true, 'error', 0"""))
def partition_checks(spark, sf_dir):
    return Z.partition_checks(asked(spark, sf_dir), comparable=False, has_fraction=False)


@query("feasibility_decision", over_packets(WINDOWS + """
SELECT CASE WHEN count(*) FILTER (status = 'possibly_truncated') = 0 THEN 'yes' ELSE 'unresolved' END AS decision, CASE WHEN count(*) FILTER (status = 'possibly_truncated') > 0 THEN 'At least one partition was failed, skipped, unsupported, unsafe, or possibly truncated.' ELSE '' END AS blockers,
  count(*) FILTER (status = 'possibly_truncated') > 0 AS transfer_considered FROM p"""))
def feasibility_decision(spark, sf_dir):
    parts = asked(spark, sf_dir)
    found = Z.feasibility(parts, Z.partition_checks(parts, True, True), all_alerts=True, by_tag=True, comparable=True)
    return found.withColumn("blockers", F.array_join("blockers", " "))


@query("bounded_checks", over_packets(WINDOWS + """
, t AS (SELECT 'extraction' AS "table", 'truncation_pagination' AS "check", count(*) FILTER (status = 'possibly_truncated') AS bad_rows, 'warning' AS severity FROM p UNION ALL SELECT 'extraction', 'detail_fetch_coverage', 0, 'info'
  UNION ALL SELECT 'object_summary', v, 0, 'error' FROM (VALUES ('non_empty'), ('required_columns'), ('object_id_present'), ('ra_range'), ('dec_range'), ('duplicate_keys')) x(v))
SELECT "table", "check", bad_rows = 0 AS passed, severity, bad_rows FROM t"""))
def bounded_checks(spark, sf_dir):
    """A bounded extraction: its objects, and its partitions under a cap."""
    objects = sources(spark, sf_dir).where("object_id is not null").groupBy("object_id").agg(F.min("ra").alias("ra"), F.min("dec").alias("dec"))
    return Z.bounded_checks({"object_summary": objects}, asked(spark, sf_dir))


@query("delivery_checks", over_packets("""
, f AS (SELECT count(*) AS n, count(raw_object_id) AS o, count(DISTINCT raw_object_id) AS objects, count(*) FILTER (mjd_tai < 60310 OR mjd_tai >= 60320) AS outside, count(*) - count(DISTINCT source_id) AS repeats FROM sources),
c AS (SELECT * FROM f, (VALUES ('raw_delivery_present', 1, 'warning', 3), ('raw_file_count_positive', 1, 'warning', 3), ('raw_row_count_positive', 1, 'warning', 4), ('delivery_present', 1, 'warning', 4), ('target_date_not_pre_alert', 1, 'error', 0), ('timezone_utc', 1, 'error', 0),
  ('processed_alerts_present', 1, 'error', 4), ('object_identifier_present', 1, 'error', 5), ('source_identifier_present', 1, 'error', 4), ('coordinate_fields_available', 1, 'warning', 6), ('time_fields_available', 1, 'warning', 4), ('band_fields_available', 1, 'warning', 4),
  ('duplicate_source_id_rate', 2, 'warning', 7), ('object_grouping_count', 1, 'warning', 8), ('date_window_consistency', 3, 'warning', 9), ('nested_sanitization_report_present', 0, 'error', 3), ('full_night_completeness_evidence', 0, 'warning', 0),
  ('completeness_claim_allowed', 0, 'warning', 0), ('smoke_completeness_blocked', 1, 'info', 0)) v(name, rule, level, what)),
j AS (SELECT *, CASE rule WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN repeats = 0 ELSE outside = 0 END AS passed FROM c)
SELECT name AS "check", passed, CASE WHEN passed THEN 'info' ELSE level END AS severity, CASE what WHEN 3 THEN 3 WHEN 4 THEN n WHEN 5 THEN o WHEN 6 THEN 2 * n WHEN 7 THEN repeats / n::DOUBLE WHEN 8 THEN objects WHEN 9 THEN outside END::DOUBLE AS value FROM j"""))
def delivery_checks(spark, sf_dir):
    """A delivery of three files with three nested columns and no report of them; rows beyond the window."""
    rows = packets(spark, sf_dir)
    raw = rows.agg(F.lit(3).alias("files"), F.count("*").alias("rows"), F.lit(3).alias("nested_columns"))
    return Z.validate_delivery(rows, raw, "2024-01-01", "2024-01-11", "2023-12-01")


@query("schema_doc_fields", """
WITH n AS (SELECT n_name, 'i:' || r_name AS field, 'nation ' || n_nationkey AS text, n_nationkey % 4 AS shape FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT field, CASE WHEN shape = 0 THEN n_name END AS family, CASE WHEN shape <> 1 THEN 'int' END AS type, text AS description, 'original alert/survey field' AS meaning FROM n
UNION ALL SELECT 'bare ' || n_name, NULL, NULL, NULL, 'unprefixed or service-specific field' FROM n WHERE shape = 2""")
def schema_doc_fields(spark, sf_dir):
    """A document a nation: nested with families, flat with texts, a list with a bare name behind, or flat with attributes."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    field, text, int_ = F.concat(F.lit("i:"), "r_name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit("int")
    j = lambda key, value: F.to_json(F.create_map(key, value))
    described = F.struct(int_.alias("type"), text.alias("doc"))
    shapes = [
        j(F.col("n_name"), F.create_map(field, described)), j(field, text),
        F.concat(F.lit("["), F.to_json(F.struct(int_.alias("type"), text.alias("description"), field.alias("name"))), F.lit(',"bare '), "n_name", F.lit('"]')), j(field, described),
    ]
    texts = joined.select(F.element_at(F.array(*shapes), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("doc"))
    return J.schema_fields(texts, "doc").drop("attributes").withColumn("meaning", Z.prefix_meaning(F.col("field")))


@query("field_concepts", """
WITH f AS (SELECT DISTINCT props_key AS field FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS props_key FROM benchmark) WHERE props_key <> ''),
m AS (SELECT * FROM (VALUES ('object_id', 'objectid|diaobjectid|diaobject|ssobjectid'), ('source_id', 'candid|diasourceid|diasource|alertid'), ('ra', ':ra| ra|jradeg|coord_ra|ra'), ('dec', ':dec|jdedeg|coord_dec|declination|dec'),
  ('time', ':jd|mjd|midpointtai|tai|time|timestamp'), ('band_or_filter', 'fid|band|filter'), ('magnitude_or_flux', 'mag|flux|psf|snr'), ('classification', 'class|classification|rf_|snn|cats'), ('tag', 'tag'),
  ('crossmatch_or_context', 'xmatch|simbad|tns|gaia|host|ssnamenr|mpc'), ('forced_photometry', 'forced|forcedsource|diaforcedsource'), ('cutout', 'cutout|stamp')) m(concept, mark)),
r AS (SELECT concept, field, row_number() OVER (PARTITION BY concept ORDER BY field) AS place FROM m, f WHERE regexp_matches(lower(field), mark))
SELECT m.concept, count(r.field) AS fields, coalesce(string_agg(r.field, ', ' ORDER BY r.field) FILTER (r.place <= 20), '') AS examples FROM m LEFT JOIN r ON r.concept = m.concept GROUP BY 1""")
def field_concepts(spark, sf_dir):
    """Concepts of names, for which the words of the items stand."""
    words = F.split(F.lower("text"), "[^a-z]+")
    return L.concepts(table(spark, sf_dir, "benchmark").select(F.explode(words).alias("field")))


@query("json_safe_bytes", r"SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE base64('\xFF'::BLOB || encode(text)) END AS safe FROM documents")
def json_safe_bytes(spark, sf_dir):
    """Whole texts as bytes; those of other languages behind a byte that makes them no UTF-8."""
    whole = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", text_of_bytes(F.when(F.col("lang") == "en", whole).otherwise(F.concat(F.unhex(F.lit("FF")), whole))).alias("safe"))


@query("json_safe_texts", r"SELECT doc_id, text AS safe, base64('\xFF'::BLOB || encode(text)) AS broken FROM documents")
def json_safe_texts(spark, sf_dir):
    """Whole texts of all rows, as they are and behind a byte that makes them no UTF-8."""
    whole = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", text_of_bytes(whole).alias("safe"), text_of_bytes(F.concat(F.unhex(F.lit("FF")), whole)).alias("broken"))


@query("packet_types", "SELECT event_type, 'full' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_type, 'light_static' FROM events WHERE event_type = 'click' UNION ALL SELECT event_type, 'unknown' FROM events WHERE event_type NOT IN ('view', 'click')")
def packet_types(spark, sf_dir):
    text = F.when(F.col("event_type") == "view", "Full packets").when(F.col("event_type") == "click", "LIGHT").otherwise("something")
    return table(spark, sf_dir, "events").select("event_type", packet_type(text).alias("kind"))


@query("window_parts", over_packets("""
SELECT floor((mjd_tai - (60310 + 37 / 86400.0::DOUBLE)) / 6.0)::INT AS part, count(*) AS rows FROM sources WHERE mjd_tai >= 60310 + 37 / 86400.0::DOUBLE AND mjd_tai < 60340 + 37 / 86400.0::DOUBLE GROUP BY 1"""))
def window_parts(spark, sf_dir):
    """Rows in five equal parts of thirty days."""
    parts = split_window("2024-01-01T00:00:00", "2024-01-31T00:00:00", 5)
    low, high = utc_to_tai(parts[0][0]), utc_to_tai(parts[-1][1])
    part = time_bucket(F.col("mjd_tai"), low, high, len(parts))
    return sources(spark, sf_dir).select(part.alias("part")).where("part is not null").groupBy("part").agg(F.count("*").alias("rows"))


@query("family_round_trip", over_packets("""
, t AS (SELECT 'alerts' AS "table", count(*) AS rows, 9::BIGINT AS columns, 0::BIGINT AS nested_values, 0::BIGINT AS nonfinite FROM sources
UNION ALL SELECT 'objects', count(DISTINCT raw_object_id) FILTER (raw_object_id > 0), 9, 0, 0 FROM sources UNION ALL SELECT 'forced_photometry', count(*), 3, 0, 0 FROM sources
UNION ALL SELECT 'classifications', count(*), 4, count(*), count(*) FILTER (k % 25 = 0) FROM sources UNION ALL SELECT 'lightcurve_features', count(*) FILTER (k % 10 <> 0), 8, 0, 0 FROM sources
UNION ALL SELECT 'nightly_summary', 1, 15, 0, 0)
SELECT *, rows AS rows_read FROM t"""))
def family_round_trip(spark, sf_dir):
    """All tables of the family written in turn; the report of the writer, and the rows that are read back by name."""
    at = scratch(spark)
    report, detail = write_tables(spark, table_family(packets(spark, sf_dir), run_name="demo"), at)
    back = None
    for r in report.collect():  # the tables of the family
        row = spark.read.parquet(f"{at}/{r.table}").agg(F.count("*").alias("rows_read")).select(F.lit(r.table).alias("table"), "rows_read")
        back = row if back is None else back.unionByName(row)
    kinds = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("values"))), F.lit(0))
    told = detail.groupBy("table").agg(kinds("nested").alias("nested_values"), kinds("nonfinite").alias("nonfinite"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return report.join(told, "table", "left").join(back, "table").where("status = 'written'").select("table", "rows", "columns", zero("nested_values"), zero("nonfinite"), "rows_read")


@query("nested_rewrites", over_packets("SELECT 'deep[]{}.score' AS path, 'nonfinite' AS what, 2 * count(*) FILTER (k % 25 = 0) AS values FROM sources UNION ALL SELECT 'deep[]{}.raw', 'bytes', 2 * count(*) FROM sources UNION ALL SELECT 'clf.cats_score', 'nonfinite', count(*) FILTER (k % 25 = 0) FROM sources"))
def nested_rewrites(spark, sf_dir):
    """What is rewritten in lists of maps of structs, by path."""
    inner = F.create_map("band", F.struct(F.col("clf.cats_score").alias("score"), F.encode("band", "UTF-8").alias("raw")))
    return rewrite_counts(packets(spark, sf_dir).select("diaSourceId", "clf", F.array(inner, inner).alias("deep")))


@query("stable_json", over_packets("""
SELECT source_id AS "diaSourceId", '[{"' || band || '":{"a":"' || band || '","z":' || CASE WHEN k % 25 = 0 THEN 'null' ELSE k::VARCHAR || '.5' END || '}}]' AS json FROM sources"""))
def stable_json_query(spark, sf_dir):
    """Lists of maps of structs as JSON: members in order, bytes as text, no number that is none."""
    score = F.when(F.isnan("clf.cats_score"), F.col("clf.cats_score")).otherwise(F.bround(F.col("clf.cats_score") * 100) + 0.5)
    deep = packets(spark, sf_dir).select("diaSourceId", F.array(F.create_map("band", F.struct(score.alias("z"), F.encode("band", "UTF-8").alias("a")))).alias("deep"))
    return deep.select("diaSourceId", stable_json(F.col("deep"), deep.schema["deep"].dataType).alias("json"))


@query("report_files", over_packets("SELECT band, count(*)::VARCHAR AS rows FROM sources GROUP BY 1"))
def report_files(spark, sf_dir):
    """A small report as one CSV file, read back."""
    at = f"{scratch(spark)}/report-{uuid.uuid4().hex}"
    sources(spark, sf_dir).groupBy("band").agg(F.count("*").alias("rows")).coalesce(1).write.option("header", True).csv(at)
    return spark.read.option("header", True).csv(at)


@query("newest_directory")
def newest_directory(spark, sf_dir):
    from skyledger.sources.delivery import discover
    from skyledger.sources.delivery import newest_directory as newest

    return newest(discover(spark, sf_dir, "*.parquet")).select(F.substring_index("directory", "/", -1).alias("directory"))
