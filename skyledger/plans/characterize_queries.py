"""Queries that characterise deliveries."""

from pyspark.sql import functions as F

from skyledger.operators import characterize as C
from skyledger.plans.registry import query
from skyledger.plans.sql import over_packets
from skyledger.sources.adapters import packets, table


@query("coverage_leaves", over_packets("""
, c AS (
  SELECT 'diaSourceId' AS path, count(*) AS observed, count(*) FILTER (source_id IS NULL) AS nulls, 0 AS nonfinite FROM sources
  UNION ALL SELECT 'diaObjectId', count(*), count(*) FILTER (raw_object_id IS NULL), 0 FROM sources
  UNION ALL SELECT 'midpointMjdTai', count(*), count(*) FILTER (mjd_tai IS NULL), 0 FROM sources UNION ALL SELECT 'pred.is_sso', count(*), count(*) FILTER (is_sso IS NULL), 0 FROM sources
  UNION ALL SELECT 'ra', count(*), 0, 0 FROM sources UNION ALL SELECT 'dec', count(*), 0, 0 FROM sources UNION ALL SELECT 'band', count(*), count(*) FILTER (band IS NULL), 0 FROM sources
  UNION ALL SELECT 'psfFlux', count(*), count(*) FILTER (flux IS NULL), count(*) FILTER (NOT isfinite(flux)) FROM sources UNION ALL SELECT 'psfFluxErr', count(*), 0, 0 FROM sources
  UNION ALL SELECT 'clf.cats_class', count(*), 0, 0 FROM sources UNION ALL SELECT 'clf.cats_score', count(*), 0, count(*) FILTER (NOT isfinite(cats_score)) FROM sources
  UNION ALL SELECT 'lc_features', count(*), count(*) FILTER (k % 10 = 0), 0 FROM sources
  UNION ALL SELECT 'lc_features.mean', count(*) FILTER (k % 10 <> 0), 0, 0 FROM sources UNION ALL SELECT 'lc_features.n', count(*) FILTER (k % 10 <> 0), 0, 0 FROM sources)
SELECT path, observed::BIGINT AS observed, nulls::BIGINT AS nulls, nonfinite::BIGINT AS nonfinite FROM c"""))
def coverage_leaves(spark, sf_dir):
    return C.coverage(packets(spark, sf_dir))


@query("coverage_elements", """
SELECT 'vec_id' AS path, count(*) AS observed, count(*) FILTER (vec_id IS NULL) AS nulls, 0::BIGINT AS nonfinite FROM embeddings
UNION ALL SELECT 'embedding', count(*), count(*) FILTER (embedding IS NULL), 0 FROM embeddings UNION ALL SELECT 'label', count(*), count(*) FILTER (label IS NULL), 0 FROM embeddings
UNION ALL SELECT 'embedding.[]', count(*), count(*) FILTER (v IS NULL), count(*) FILTER (NOT isfinite(v)) FROM (SELECT unnest(embedding) AS v FROM embeddings)""")
def coverage_elements(spark, sf_dir):
    return C.coverage(table(spark, sf_dir, "embeddings"))


@query("composition", over_packets("""
SELECT p.population, count(s.source_id) AS rows, count(*) FILTER (s.is_sso) AS flagged_sso, count(*) FILTER (s.source_id IS NOT NULL AND s.is_sso IS NULL) AS null_flag,
  count(*) FILTER (s.is_sso AND s.raw_object_id > 0) AS flag_disagrees, round(count(s.source_id) / (SELECT count(*) FROM sources)::DOUBLE, 9) AS fraction
FROM (VALUES ('DIA'), ('SSO'), ('AMBIGUOUS')) p(population) LEFT JOIN sources s USING (population) GROUP BY 1"""))
def composition(spark, sf_dir):
    return C.composition(packets(spark, sf_dir))


@query("repeat_sample_objects", over_packets("""
, sizes AS (SELECT raw_object_id AS object_id, count(*) AS n FROM sources WHERE raw_object_id > 0 GROUP BY 1 HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY n, object_id) - 1 AS place, count(*) OVER () AS total FROM sizes),
slots AS (SELECT *, floor(place * 11 / (total - 1)) AS slot FROM ranked),
chosen AS (SELECT object_id, n FROM slots WHERE total <= 12 OR place = ceil(slot * (total - 1) / 11) OR place = total - 1 ORDER BY n, object_id LIMIT 12),
rows AS (SELECT c.object_id, c.n, source_id, row_number() OVER (PARTITION BY c.object_id ORDER BY mjd_tai, source_id) AS from_start, row_number() OVER (PARTITION BY c.object_id ORDER BY mjd_tai DESC, source_id DESC) AS from_end
  FROM sources s JOIN chosen c ON s.raw_object_id = c.object_id)
SELECT object_id, n, source_id, from_start::INTEGER AS from_start FROM rows WHERE from_start <= 2 OR from_end <= 2"""))
def repeat_sample_objects(spark, sf_dir):
    return C.repeat_sample(packets(spark, sf_dir)).select("object_id", "n", "source_id", "from_start")


@query("schema_inventory", "SELECT 'event_id' AS path, 'bigint' AS type, 'leaf' AS kind, 'rows' AS unit UNION ALL SELECT 'ts', 'timestamp_ntz', 'leaf', 'rows' UNION ALL SELECT 'user_id', 'bigint', 'leaf', 'rows' UNION ALL SELECT 'event_type', 'string', 'leaf', 'rows' UNION ALL SELECT 'value', 'double', 'leaf', 'rows' UNION ALL SELECT 'props', 'string', 'leaf', 'rows'")
def schema_inventory(spark, sf_dir):
    return C.schema_inventory(table(spark, sf_dir, "events"))


@query("capability_matrix", over_packets("""
, f AS (SELECT count(*) > 0 AS rows, count(flux) > 0 AS flux, count(raw_object_id) > 0 AS obj, count(mjd_tai) > 0 AS t, count(band) > 0 AS band, count(*) FILTER (k % 10 <> 0) > 0 AS features, count(source_id) > count(DISTINCT source_id) AS repeated FROM sources),
c AS (SELECT UNNEST([
  {'analysis': 'source-level photometric analysis', 'status': CASE WHEN flux OR rows OR band THEN 1 ELSE 0 END, 'evidence': 'psfFlux,psfFluxErr,scienceFlux,scienceFluxErr,band,snr,reliability'},
  {'analysis': 'object-level population analysis', 'status': CASE WHEN obj OR rows THEN 1 ELSE 0 END, 'evidence': 'diaObjectId,xm,pred'},
  {'analysis': 'repeated-detection/time-domain analysis', 'status': CASE WHEN repeated THEN 1 WHEN obj AND rows AND t AND band THEN 2 WHEN obj OR rows OR t OR band THEN 1 ELSE 0 END, 'evidence': 'diaObjectId,diaSourceId,midpointMjdTai,band'},
  {'analysis': 'lightcurve reconstruction', 'status': CASE WHEN obj OR rows OR t OR flux OR band THEN 1 ELSE 0 END, 'evidence': 'diaObjectId,diaSourceId,midpointMjdTai,psfFlux,psfFluxErr,band'},
  {'analysis': 'variability-feature analysis', 'status': CASE WHEN features THEN 1 ELSE 0 END, 'evidence': 'lc_features'},
  {'analysis': 'broker classification/prediction analysis', 'status': CASE WHEN rows THEN 1 ELSE 0 END, 'evidence': 'clf,pred'},
  {'analysis': 'DIA/static-object selection', 'status': CASE WHEN rows OR obj THEN 1 ELSE 0 END, 'evidence': 'pred.is_sso,diaObjectId'},
  {'analysis': 'Solar System Object analysis', 'status': CASE WHEN rows OR t THEN 1 ELSE 0 END, 'evidence': 'pred.is_sso,ra,dec,midpointMjdTai'},
  {'analysis': 'basic sky-position filtering', 'status': CASE WHEN rows THEN 2 ELSE 0 END, 'evidence': 'ra,dec'},
  {'analysis': 'temporal filtering', 'status': CASE WHEN t THEN 2 ELSE 0 END, 'evidence': 'midpointMjdTai'},
  {'analysis': 'future crossmatch/enrichment workflows', 'status': CASE WHEN rows OR obj THEN 1 ELSE 0 END, 'evidence': 'ra,dec,diaObjectId,xm'},
  {'analysis': 'project cadence and band summaries', 'status': CASE WHEN repeated THEN 1 WHEN obj AND t AND band THEN 2 WHEN obj OR t OR band THEN 1 ELSE 0 END, 'evidence': 'diaObjectId,midpointMjdTai,band'},
  {'analysis': 'project upper-limit evolution', 'status': 0, 'evidence': ''},
  {'analysis': 'project candidate ranking', 'status': CASE WHEN rows OR features THEN 1 ELSE 0 END, 'evidence': 'clf,pred,lc_features,reliability'}]) AS c FROM f)
SELECT c.analysis, (['NOT_SUPPORTED', 'PARTIALLY_SUPPORTED', 'SUPPORTED'])[c.status + 1] AS status, c.evidence, CASE WHEN c.status = 0 THEN 'VERIFIED' ELSE 'STRONGLY SUPPORTED' END AS claim_status FROM c"""))
def capability_matrix(spark, sf_dir):
    return C.capability_matrix(packets(spark, sf_dir))


@query("schema_admission", """
SELECT * FROM (VALUES ('diaSourceId', 'required', 'bigint', 'admitted'), ('diaObjectId', 'required', 'bigint', 'admitted'), ('midpointMjdTai', 'required', 'double', 'admitted'), ('pred.is_sso', 'required', 'boolean', 'admitted'), ('ra', 'required', 'double', 'admitted'),
  ('dec', 'required', 'double', 'admitted'), ('band', 'required', 'string', 'admitted'), ('psfFlux', 'required', 'double', 'admitted'), ('psfFluxErr', 'required', 'double', 'admitted'),
  ('reliability', 'optional', 'ABSENT', 'absent'), ('scienceFlux', 'optional', 'ABSENT', 'absent'), ('scienceFluxErr', 'optional', 'ABSENT', 'absent'), ('snr', 'optional', 'ABSENT', 'absent'), ('templateFlux', 'optional', 'ABSENT', 'absent'), ('templateFluxErr', 'optional', 'ABSENT', 'absent'),
  ('pred', 'snapshot', 'struct<is_sso:boolean>', 'admitted'), ('clf', 'snapshot', 'struct<cats_class:bigint,cats_score:double>', 'admitted'), ('lc_features', 'snapshot', 'map<string,struct<mean:double,n:bigint>>', 'admitted'), ('xm', 'snapshot', 'ABSENT', 'absent'), ('misc', 'snapshot', 'ABSENT', 'absent')) a(path, role, type, status)""")
def schema_admission(spark, sf_dir):
    return C.schema_admission(packets(spark, sf_dir))


@query("feature_hash_changes", over_packets("""
SELECT raw_object_id AS object_id, count(DISTINCT CASE WHEN k % 10 <> 0 THEN band || ':' || flux || ':' || k ELSE '' END) > 1 AS changed FROM sources WHERE raw_object_id > 0 GROUP BY 1"""))
def feature_hash_changes(spark, sf_dir):
    """Objects whose feature map differs from row to row."""
    digest = F.coalesce(F.sha2(F.to_json("lc_features"), 256), F.lit(""))
    return packets(spark, sf_dir).where("diaObjectId > 0").groupBy(F.col("diaObjectId").alias("object_id")).agg((F.countDistinct(digest) > 1).alias("changed"))
