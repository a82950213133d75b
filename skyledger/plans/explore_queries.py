"""Queries of exploration and lookup."""

from pyspark.sql import functions as F

from skyledger.functions.scalars import sky_cell
from skyledger.functions.timescale import approximate_night, mjd_of, rows_in_window
from skyledger.operators import explore as X
from skyledger.operators import documents as J
from skyledger.operators import lookup as L
from skyledger.operators.ingest import lightcurve_features
from skyledger.plans.catalog_queries import sources
from skyledger.plans.registry import query
from skyledger.plans.sql import over_packets
from skyledger.sources.adapters import packets, table

LOW = float(mjd_of(__import__("datetime").date(2024, 1, 1)))
HIGH = LOW + 30


@query("band_counts", over_packets("SELECT band AS value, count(*) AS n FROM sources WHERE band IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20"))
def band_counts(spark, sf_dir):
    return X.value_counts(packets(spark, sf_dir), "band")


@query("text_value_counts", "SELECT substr(text, 1, 200) AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def text_value_counts(spark, sf_dir):
    return X.value_counts(table(spark, sf_dir, "documents"), "text")


@query("delivery_summary", over_packets("SELECT count(*) AS rows, count(DISTINCT source_id) AS unique_sources, count(DISTINCT raw_object_id) AS unique_objects FROM sources"))
def delivery_summary(spark, sf_dir):
    return X.delivery_summary(packets(spark, sf_dir), "diaSourceId", "diaObjectId")


def _ranges(columns, source):
    return "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count({c}) AS numeric, min({c})::DOUBLE + 0.0::DOUBLE AS least, max({c})::DOUBLE + 0.0::DOUBLE AS greatest FROM {source}" for c in columns)


@query("numeric_ranges", _ranges(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"))
def numeric_ranges(spark, sf_dir):
    return X.numeric_ranges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _missing(columns, source):
    return "\nUNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) FILTER ({x}) AS missing, round(avg(({x})::INT), 9) AS fraction FROM {source}" for n, x in columns)


@query("missingness", over_packets(_missing([("diaSourceId", "source_id IS NULL"), ("diaObjectId", "raw_object_id IS NULL"), ("lc_features", "k % 10 = 0"), ("psfFlux", "flux IS NULL OR isnan(flux)")], "sources")))
def missingness(spark, sf_dir):
    return X.missingness(packets(spark, sf_dir), ["diaSourceId", "diaObjectId", "lc_features", "psfFlux"])


@query("column_availability", "SELECT 'o_orderkey' AS \"column\", true AS present, count(o_orderkey) AS filled FROM orders UNION ALL SELECT 'o_absent', false, 0")
def column_availability(spark, sf_dir):
    return X.column_availability(table(spark, sf_dir, "orders"), ["o_orderkey", "o_absent"])


@query("variability_hooks", over_packets("""
, g AS (SELECT raw_object_id, count(*) AS n FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1) SELECT count(*) AS objects, count(*) FILTER (n >= 2) AS with_two_or_more, max(n) AS most_rows FROM g"""))
def variability_hooks(spark, sf_dir):
    return X.variability(packets(spark, sf_dir), "diaObjectId")


@query("flux_amplitude", over_packets("""
, g AS (SELECT raw_object_id, max(flux) - min(flux) AS a FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1) SELECT count(a) AS objects, count(*) FILTER (a > 0) AS nonzero, round(max(a), 6) AS greatest FROM g"""))
def flux_amplitude(spark, sf_dir):
    return X.flux_amplitude(packets(spark, sf_dir), "diaObjectId", "psfFlux").withColumn("greatest", F.round("greatest", 6))


@query("chi_like", over_packets("""
, m AS (SELECT raw_object_id AS object_id, flux, flux_err, avg(flux) OVER (PARTITION BY raw_object_id) AS m FROM sources WHERE raw_object_id IS NOT NULL AND flux_err > 0)
SELECT object_id, count(*) AS n, round(sum(((flux - m) / flux_err) ^ 2) / greatest(count(*) - 1, 1), 4) AS chi_like FROM m GROUP BY 1 HAVING count(*) >= 2"""))
def chi_like(spark, sf_dir):
    return X.chi_like(packets(spark, sf_dir), "diaObjectId", "psfFlux", "psfFluxErr").withColumn("chi_like", F.round("chi_like", 4))


HIST = """
WITH r AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {t}), b AS (SELECT least(floor(({c}::DOUBLE - lo) / (hi - lo) * {n}), {n} - 1)::INT AS bin, lo, hi FROM {t}, r WHERE {c} IS NOT NULL)
SELECT bin, count(*) AS n, round(lo + (hi - lo) * bin / {n}, 6) AS left_edge FROM b GROUP BY bin, lo, hi"""


@query("hist_flux", HIST.format(c="value", t="events", n=50))
def hist_flux(spark, sf_dir):
    return X.histogram(packets(spark, sf_dir), "psfFlux", 50)


@query("hist_price", HIST.format(c="l_extendedprice", t="lineitem", n=72))
def hist_price(spark, sf_dir):
    return X.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 72)


@query("hist_fixed_bounds", over_packets("SELECT least(floor((cats_score - 0.0) / 1.0 * 20), 19)::INT AS bin, count(*) AS n, round(0.0::DOUBLE + 1.0 * least(floor(cats_score * 20), 19)::INT / 20, 6) AS left_edge FROM sources WHERE NOT isnan(cats_score) GROUP BY 1, 3"))
def hist_fixed_bounds(spark, sf_dir):
    return X.histogram(packets(spark, sf_dir).select(F.col("clf.cats_score").alias("score")), "score", 20, 0.0, 1.0)


@query("hist_clipped", """
WITH q AS (SELECT quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events), b AS (SELECT least(floor((greatest(least(value, hi), lo) - lo) / (hi - lo) * 60), 59)::INT AS bin, lo, hi FROM events, q)
SELECT bin, count(*) AS n, round(lo + (hi - lo) * bin / 60, 6) AS left_edge FROM b GROUP BY bin, lo, hi""")
def hist_clipped(spark, sf_dir):
    return X.clipped_histogram(packets(spark, sf_dir), "psfFlux", 60)


@query("alerts_per_object", over_packets("""
, g AS (SELECT raw_object_id, count(*) AS alerts FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN raw_object_id = 0 THEN 'zero_id' ELSE 'object' END AS kind, alerts, count(*) AS objects FROM g GROUP BY 1, 2"""))
def alerts_per_object(spark, sf_dir):
    return X.alerts_per_object(packets(spark, sf_dir), "diaObjectId")


@query("top_repeated_objects", over_packets("SELECT raw_object_id AS object_id, count(*) AS rows FROM sources WHERE raw_object_id <> 0 GROUP BY 1 ORDER BY rows DESC, object_id LIMIT 20"))
def top_repeated_objects(spark, sf_dir):
    return X.rows_by(packets(spark, sf_dir).where("diaObjectId <> 0"), F.col("diaObjectId").alias("object_id")).orderBy(F.desc("rows"), "object_id").limit(20)


@query("band_class_crosstab", over_packets("""
SELECT cats_class::VARCHAR AS cats_class, count(*) FILTER (band = 'g') AS g, count(*) FILTER (band = 'r') AS r, count(*) FILTER (band = 'i') AS i, count(*) FILTER (band = 'z') AS z, count(*) FILTER (band = 'y') AS y FROM sources GROUP BY 1"""))
def band_class_crosstab(spark, sf_dir):
    p = packets(spark, sf_dir).select("band", F.col("clf.cats_class").alias("cats_class"))
    return X.crosstab(p, "cats_class", "band", ["g", "r", "i", "z", "y"])


@query("flag_status_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def flag_status_crosstab(spark, sf_dir):
    return X.crosstab(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("date_distribution", over_packets("SELECT CASE WHEN source_id % 2 = 0 THEN night ELSE DATE '1858-11-17' + round_even(mjd_tai, 0)::INTEGER END AS date, count(*) AS rows FROM sources GROUP BY 1"))
def date_distribution(spark, sf_dir):
    """Even sources have date parts, the others only a time."""
    p = packets(spark, sf_dir)
    night, even = approximate_night(F.col("midpointMjdTai")), F.col("diaSourceId") % 2 == 0
    parts = p.select(F.when(even, F.year(night)).alias("year"), F.month(night).alias("month"), F.day(night).alias("day"), "midpointMjdTai")
    return X.date_distribution(parts, "year", "month", "day", "midpointMjdTai")


@query("missing_percent", over_packets("""
SELECT 'diaObjectId' AS "column", round(100 * avg((raw_object_id IS NULL)::INT), 6) AS percent FROM sources UNION ALL SELECT 'lc_features', round(100 * avg((k % 10 = 0)::INT), 6) FROM sources"""))
def missing_percent(spark, sf_dir):
    m = X.missingness(packets(spark, sf_dir), ["diaObjectId", "lc_features"])
    return m.select("column", F.round(100 * F.col("fraction"), 6).alias("percent"))


@query("sky_sample", over_packets("SELECT source_id AS \"diaSourceId\", round(ra, 6) AS ra, round(dec, 6) AS dec FROM sources ORDER BY md5(source_id || ':42'), source_id LIMIT 2000"))
def sky_sample(spark, sf_dir):
    return X.sky_sample(packets(spark, sf_dir), "ra", "dec", "diaSourceId", 2000).withColumns({c: F.round(c, 6) for c in ("ra", "dec")})


@query("sky_sample_by_band", over_packets("SELECT source_id AS \"diaSourceId\", band FROM (SELECT source_id, band, row_number() OVER (PARTITION BY band ORDER BY md5(source_id || ':42'), source_id) AS k FROM sources) WHERE k <= 300"))
def sky_sample_by_band(spark, sf_dir):
    """The same number of rows of each band."""
    return X.sky_sample(packets(spark, sf_dir), "ra", "dec", "diaSourceId", 300, by="band").select("diaSourceId", "band")


@query("flux_quantiles", "\nUNION ALL ".join(f"SELECT {q}::DOUBLE AS share, round(quantile_cont(value, {q}), 9) AS flux FROM events" for q in (0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0)))
def flux_quantiles(spark, sf_dir):
    """Exact quantiles of all fluxes, in two scans."""
    shares = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    found = X.quantiles(packets(spark, sf_dir).select(F.col("psfFlux").alias("x")), shares, 500)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "share double, flux double").withColumn("flux", F.round("flux", 9))


@query("sky_cells", over_packets("""
SELECT least(floor(ra * 12 / 360.0::DOUBLE), 11)::INT || '-' || least(floor((dec + 90) * 6 / 180.0::DOUBLE), 5)::INT AS cell, count(*) AS rows FROM sources GROUP BY 1"""))
def sky_cells(spark, sf_dir):
    return X.rows_by(packets(spark, sf_dir), sky_cell(F.col("ra"), F.col("dec"), 12, 6).alias("cell"))


@query("ranked_files", "SELECT source AS path, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, source)::INT AS rank FROM documents GROUP BY 1")
def ranked_files(spark, sf_dir):
    """Rows by delivering unit, ranked; sources stand for files, whose names differ by machine."""
    return X.ranked_files(table(spark, sf_dir, "documents"), F.col("source"))


@query("nightly_stats_pivot", over_packets("""
SELECT night, count(*) AS alerts, count(DISTINCT raw_object_id) AS objects, count(*) FILTER (band = 'g') AS band_g, count(*) FILTER (band = 'r') AS band_r, count(*) FILTER (band = 'i') AS band_i,
  count(*) FILTER (is_sso) AS tag_sso, count(*) FILTER (flux > 20) AS tag_bright FROM sources GROUP BY 1"""))
def nightly_stats_pivot(spark, sf_dir):
    tags = {"sso": F.col("pred.is_sso"), "bright": F.col("psfFlux") > 20}
    return X.nightly_statistics(packets(spark, sf_dir), approximate_night(F.col("midpointMjdTai")), "band", ["g", "r", "i"], "diaObjectId", tags)


@query("readiness_report", over_packets("""
SELECT 'summary' AS section, 'rows' AS metric, count(*)::DOUBLE AS value FROM sources UNION ALL SELECT 'summary', 'sources', count(source_id) FROM sources UNION ALL SELECT 'summary', 'objects', count(raw_object_id) FROM sources
UNION ALL SELECT 'summary', 'unique_sources', count(DISTINCT source_id) FROM sources UNION ALL SELECT 'summary', 'unique_objects', count(DISTINCT raw_object_id) FROM sources
UNION ALL SELECT 'range', 'psfFlux_least', min(flux) FROM sources UNION ALL SELECT 'range', 'psfFlux_greatest', max(flux) FROM sources UNION ALL SELECT 'missing', 'psfFlux', count(*) FILTER (flux IS NULL) FROM sources
UNION ALL (SELECT 'values', 'band=' || band, count(*) FROM sources GROUP BY band) UNION ALL SELECT 'features', 'rows', count(*) FROM sources WHERE k % 10 <> 0 UNION ALL SELECT 'features', 'columns', 2
UNION ALL (SELECT 'features', 'feature_band=' || band, count(*) FROM sources WHERE k % 10 <> 0 GROUP BY band)"""))
def readiness_report(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return X.readiness_report(rows, "diaSourceId", "diaObjectId", ["psfFlux"], ["band"], lightcurve_features(rows))


@query("quick_report", over_packets("""
, g AS (SELECT raw_object_id, count(*) AS n, max(flux) - min(flux) AS a, avg(flux) AS m FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1),
x AS (SELECT raw_object_id, sum(((flux - m) / flux_err) ** 2) / greatest(count(*) - 1, 1) AS chi FROM sources JOIN g USING (raw_object_id) GROUP BY 1 HAVING count(*) >= 2)
SELECT 'rows' AS section, 'rows' AS metric, count(*)::DOUBLE AS value FROM sources UNION ALL SELECT 'rows', 'columns', 11 UNION ALL (SELECT 'bands', 'band=' || band, count(*) FROM sources GROUP BY band)
UNION ALL SELECT 'ids', 'unique_objects', count(DISTINCT raw_object_id) FROM sources UNION ALL SELECT 'ids', 'unique_sources', count(DISTINCT source_id) FROM sources
UNION ALL SELECT 'range', 'ra_numeric', count(ra) FROM sources UNION ALL SELECT 'range', 'ra_least', round(min(ra), 6) FROM sources UNION ALL SELECT 'range', 'ra_greatest', round(max(ra), 6) FROM sources
UNION ALL SELECT 'missing', c, CASE c WHEN 'diaObjectId' THEN (SELECT count(*) FROM sources WHERE raw_object_id IS NULL) WHEN 'lc_features' THEN (SELECT count(*) FROM sources WHERE k % 10 = 0) ELSE 0 END FROM (VALUES ('diaSourceId'), ('diaObjectId'), ('midpointMjdTai'), ('pred'), ('ra'), ('dec'), ('band'), ('psfFlux'), ('psfFluxErr'), ('clf'), ('lc_features')) v(c)
UNION ALL SELECT 'variability', 'objects_with_two_or_more', count(*) FILTER (n >= 2) FROM g UNION ALL SELECT 'variability', 'most_alerts', max(n) FROM g UNION ALL SELECT 'variability', 'amplitude_nonzero_objects', count(*) FILTER (a > 0) FROM g
UNION ALL SELECT 'variability', 'amplitude_greatest', round(max(a), 6) FROM g UNION ALL SELECT 'variability', 'chi_like_objects', count(*) FROM x UNION ALL SELECT 'variability', 'chi_like_greatest', round(max(chi), 6) FROM x"""))
def quick_report(spark, sf_dir):
    return X.quick_report(packets(spark, sf_dir), "diaSourceId", "diaObjectId", "band", "psfFlux", "psfFluxErr", ["ra"]).withColumn("value", F.round("value", 6))


@query("score_histograms", over_packets("""
, v AS (SELECT 'cats_score' AS "column", cats_score AS x FROM sources WHERE NOT isnan(cats_score) UNION ALL SELECT 'snr', flux / flux_err FROM sources UNION ALL SELECT 'k', k FROM sources),
r AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM v GROUP BY 1), b AS (SELECT "column", least(floor((x - lo) / (hi - lo) * 30), 29)::INT AS bin, lo, hi FROM v JOIN r USING ("column"))
SELECT "column", bin, count(*) AS n, round(lo + (hi - lo) * bin / 30, 6) AS left_edge FROM b GROUP BY "column", bin, lo, hi"""))
def score_histograms(spark, sf_dir):
    """Three scores, each over its own range."""
    rows = packets(spark, sf_dir).join(table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("diaSourceId"), F.get_json_object("props", "$.k").alias("k")), "diaSourceId")
    return X.histograms(rows, {"cats_score": F.col("clf.cats_score"), "snr": F.col("psfFlux") / F.col("psfFluxErr"), "k": F.col("k")}, 30)


@query("rows_in_window", over_packets("""
SELECT 'midpointMjdTai' AS "column", count(*) AS rows, count(*) FILTER (mjd_tai >= 60310 AND mjd_tai < 60320) AS inside, bool_and(mjd_tai >= 60310 AND mjd_tai < 60320) AS all_inside, round(min(mjd_tai), 9) AS least, round(max(mjd_tai), 9) AS greatest FROM sources"""))
def in_window(spark, sf_dir):
    out = rows_in_window(packets(spark, sf_dir), ["midpointMjdTai"], "2024-01-01", "2024-01-11")
    return out.withColumns({c: F.round(c, 9) for c in ("least", "greatest")})


@query("flat_packets", over_packets("SELECT source_id AS \"diaSourceId\", is_sso AS pred_is_sso, cats_class AS clf_cats_class FROM sources"))
def flat_packets(spark, sf_dir):
    flat, _ = X.flatten(packets(spark, sf_dir), {"clf": ["cats_class"]})
    return flat.select("diaSourceId", "pred_is_sso", "clf_cats_class")


@query("cone_search", over_packets("""
, s AS (SELECT source_id, degrees(2 * asin(least(1.0, sqrt(sin(radians(dec - 9.7) / 2) ^ 2 + cos(radians(dec)) * cos(radians(9.7)) * sin(radians(ra - 31.7) / 2) ^ 2)))) * 3600 AS d FROM sources)
SELECT source_id FROM s WHERE d <= 60 ORDER BY d, source_id LIMIT 100"""))
def cone_search(spark, sf_dir):
    return L.cone_search(sources(spark, sf_dir), 31.7, 9.7, 60.0, 100).select("source_id")


@query("for_known_ids", over_packets("""
SELECT source_id, object_id FROM sources WHERE object_id IN (SELECT DISTINCT object_id FROM sources WHERE band = 'z' AND object_id IS NOT NULL ORDER BY object_id LIMIT 10)"""))
def for_known_ids(spark, sf_dir):
    s = sources(spark, sf_dir)
    return L.for_known_ids(s, s.where("band = 'z'"), "object_id", 10).select("source_id", "object_id")


@query("tagged_rows", over_packets("SELECT source_id, (SELECT count(*) FROM sources WHERE flux > 20) >= 50 AS truncated FROM sources WHERE flux > 20 ORDER BY mjd_tai DESC, source_id LIMIT 50"))
def tagged_rows(spark, sf_dir):
    s = sources(spark, sf_dir)
    return L.tagged(s, F.col("flux") > 20, [F.desc("mjd_tai"), "source_id"], 50).select("source_id", "truncated")


WINDOWS = """
, w AS (SELECT least(floor((mjd_tai - 60310.0) / 3.75::DOUBLE), 7)::INT AS part FROM sources WHERE mjd_tai >= 60310 AND mjd_tai < 60340), c AS (SELECT part, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT r.part::INT AS part, coalesce(n, 0) AS rows, least(coalesce(n, 0), 1300)::BIGINT AS kept, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n >= 1300 THEN 'possibly_truncated' ELSE 'exhausted' END AS status
  FROM range(8) r(part) LEFT JOIN c ON c.part = r.part)
"""


@query("capped_windows", over_packets(WINDOWS + "SELECT * FROM p"))
def capped_windows(spark, sf_dir):
    return L.partition_windows(sources(spark, sf_dir), "mjd_tai", LOW, HIGH, 8, 1300)


@query("window_rollup", over_packets(WINDOWS + "SELECT status, count(*) AS parts, sum(rows)::BIGINT AS rows, sum(kept)::BIGINT AS kept FROM p GROUP BY 1"))
def window_rollup(spark, sf_dir):
    return L.partition_rollup(capped_windows(spark, sf_dir))


@query("safety_cap", over_packets(WINDOWS + "SELECT *, CASE WHEN coalesce(sum(kept) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4000 THEN 'skipped' ELSE 'taken' END AS action FROM p"))
def safety_cap(spark, sf_dir):
    return L.safety_cap(capped_windows(spark, sf_dir), 4000)


@query("window_completeness", over_packets(WINDOWS + "SELECT sum(kept)::BIGINT AS kept, count(*) FILTER (status = 'possibly_truncated') AS truncated_parts, round(sum(kept) / 10000.0::DOUBLE, 6) AS fraction FROM p"))
def window_completeness(spark, sf_dir):
    return L.completeness(capped_windows(spark, sf_dir), True, 10_000)


@query("refined_windows", over_packets("""
, n AS (SELECT unnest([2, 4, 8, 16, 32, 64]) AS parts), w AS (SELECT parts, least(floor((mjd_tai - 60310.0) / (30.0::DOUBLE / parts)), parts - 1)::INT AS part, count(*) AS n FROM sources, n WHERE mjd_tai >= 60310 AND mjd_tai < 60340 GROUP BY ALL),
t AS (SELECT coalesce(min(parts) FILTER (most < 1300), 64) AS parts FROM (SELECT parts, max(n) AS most FROM w GROUP BY 1))
SELECT r.part::INT AS part, coalesce(n, 0) AS rows, least(coalesce(n, 0), 1300)::BIGINT AS kept, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n >= 1300 THEN 'possibly_truncated' ELSE 'exhausted' END AS status
FROM (SELECT unnest(range(64)) AS part) r JOIN t ON r.part < t.parts LEFT JOIN w ON w.parts = t.parts AND w.part = r.part"""))
def refined_windows(spark, sf_dir):
    return L.refine_windows(sources(spark, sf_dir), "mjd_tai", LOW, HIGH, 2, 1300, 64)[0]


@query("classified_partitions", """
WITH p AS (SELECT l_suppkey AS part, count(*) FILTER (l_suppkey % 5 <> 1) AS n, l_suppkey % 7 <> 2 AS ok, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 600 END AS requested, CASE WHEN l_suppkey % 2 = 0 THEN 'timed out' END AS error FROM lineitem GROUP BY 1)
SELECT part, CASE WHEN ok THEN n ELSE 0 END AS rows, CASE WHEN NOT ok THEN 'failed' WHEN n = 0 THEN 'empty' WHEN n >= requested THEN 'possibly_truncated' ELSE 'exhausted' END AS status,
  CASE WHEN NOT ok THEN coalesce(error, 'request failed') WHEN n = 0 THEN 'Partition returned zero rows' WHEN n >= requested THEN 'Partition returned the requested row cap' ELSE 'Partition returned fewer rows than requested cap' END AS message FROM p""")
def classified_partitions(spark, sf_dir):
    """Answers by supplier: some failed, some without rows, some at their cap."""
    s = F.first("l_suppkey")
    answers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("part")).agg(
        F.count_if(F.col("l_suppkey") % 5 != 1).alias("rows"), (s % 7 != 2).alias("ok"), F.when(s % 3 != 0, 600).alias("requested"), F.when(s % 2 == 0, "timed out").alias("error")
    )
    return L.classify_partitions(answers)


@query("json_walk", "SELECT '$.k' AS path, 'k' AS field, json_extract_string(props, '$.k') AS value, 'integer' AS kind FROM events WHERE props IS NOT NULL")
def json_walk(spark, sf_dir):
    return L.walk_json(table(spark, sf_dir, "events"), "props")



IDS = """
WITH c AS (SELECT id_type, confidence, field, value, min(origin) AS origin, any_value(path) AS path FROM (
  SELECT 'diaObjectId' AS id_type, 'high' AS confidence, 'objectId' AS field, user_id::VARCHAR AS value, event_type AS origin, '$.objectId' AS path FROM events WHERE user_id > 0
  UNION ALL SELECT 'diaSourceId', 'high', 'r:diaSourceId', event_id::VARCHAR, event_type, '$.rows[0].r:diaSourceId' FROM events WHERE event_id > 0
  UNION ALL SELECT 'other_object_ids', 'medium', 'host-object-id', event_type, event_type, '$.host-object-id' FROM events) GROUP BY 1, 2, 3, 4)
"""


@query("json_candidate_ids", IDS + "SELECT * FROM c")
def json_candidate_ids(spark, sf_dir):
    """Identifiers found in nested JSON that is made of the events' own columns, and where they stand first."""
    inner = F.array(F.struct(F.col("event_id").alias("r:diaSourceId")).cast("struct<`r:diaSourceId`:bigint>"))
    text = F.to_json(F.struct(F.col("user_id").alias("objectId"), inner.alias("rows"), F.col("event_type").alias("host-object-id"), F.lit("none").alias("sourceId"), F.lit(True).alias("objectIdKnown")))
    return L.candidate_ids(L.walk_json(table(spark, sf_dir, "events").select("event_type", text.alias("j")), "j", "event_type"))


@query("candidate_summary", IDS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY id_type ORDER BY value) AS place FROM c),
o AS (SELECT id_type, count(*) AS origins, '[' || string_agg('"' || origin || '"', ',' ORDER BY origin) FILTER (k <= 5) || ']' AS first_origins FROM (SELECT id_type, origin, row_number() OVER (PARTITION BY id_type ORDER BY origin) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT t.id_type, count(r.value) AS ids, count(DISTINCT r.field) AS fields, '[' || coalesce(string_agg('"' || r.value || '"', ',' ORDER BY r.value) FILTER (r.place <= 5), '') || ']' AS examples,
  coalesce(any_value(o.origins), 0) AS origins, coalesce(any_value(o.first_origins), '[]') AS first_origins
FROM (VALUES ('diaObjectId'), ('diaSourceId'), ('other_object_ids'), ('other_source_ids')) t(id_type) LEFT JOIN r ON r.id_type = t.id_type LEFT JOIN o ON o.id_type = t.id_type GROUP BY 1""")
def candidate_summary(spark, sf_dir):
    return L.candidate_summary(json_candidate_ids(spark, sf_dir))


@query("best_candidate", IDS + "SELECT * FROM c WHERE id_type = 'diaSourceId' ORDER BY value LIMIT 1")
def best_candidate(spark, sf_dir):
    return L.best_candidate(json_candidate_ids(spark, sf_dir), "source")


@query("payload_rows", "SELECT event_id AS id, event_type AS name FROM events UNION ALL SELECT -event_id, NULL FROM events WHERE event_id % 9 = 6")
def payload_rows(spark, sf_dir):
    """Payloads of nine shapes, in turn, among them lists by column of different lengths."""
    e = table(spark, sf_dir, "events")
    id_, name = F.col("event_id").cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    one = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name")))
    around = lambda before, after: F.concat(F.lit(before), one, F.lit(after))
    shapes = [
        one, around("[", "]"), around('{"rows":[', "]}"), around("[[", "]]"), around('[{"data":[', "]}]"), F.concat(F.lit('{"results":{"items":{"id":['), id_, F.lit('],"name":['), name, F.lit("]}}}")),
        F.concat(F.lit('{"id":['), id_, F.lit(","), F.lit("-"), id_, F.lit('],"name":['), name, F.lit("]}")), around('[{"data":{"rows":[', ']}},{"data":null}]'), around('{"data":null,"alerts":{"objects":[', "]}}"),
    ]
    return J.payload_rows(e.select(F.element_at(F.array(*shapes), (F.col("event_id") % 9 + 1).cast("int")).alias("t")), "t", "id bigint, name string")


@query("partition_labels", over_packets("SELECT 'band=' || b.value AS label, count(s.source_id) AS rows FROM (VALUES ('g'), ('r'), ('u')) b(value) LEFT JOIN sources s ON s.band = b.value GROUP BY 1"))
def partition_labels(spark, sf_dir):
    return L.partition_labels(packets(spark, sf_dir), "band", ["g", "r", "u"])
