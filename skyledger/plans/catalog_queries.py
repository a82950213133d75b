"""Queries of the cohort catalog."""

from pyspark.sql import functions as F

from skyledger.operators import catalog as C
from skyledger.plans.registry import query
from skyledger.plans.sql import ACQUISITIONS, over_packets
from skyledger.sources.adapters import acquisition_table, deliveries

START, STOP = "2024-01-01", "2024-02-03"


def sources(spark, sf_dir):
    return C.cohort(deliveries(spark, sf_dir))


@query("population_qc", over_packets("""
SELECT acquisition_id, count(*) AS source_rows, count(DISTINCT source_id) AS distinct_sources, count(*) FILTER (source_id IS NULL) AS null_sources,
  count(source_id) - count(DISTINCT source_id) AS duplicate_excess, count(*) FILTER (population = 'DIA') AS dia, count(*) FILTER (population = 'SSO') AS sso,
  count(*) FILTER (population = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (is_sso IS NULL) AS null_flag, count(*) FILTER (raw_object_id IS NULL) AS null_object,
  count(*) FILTER (raw_object_id = 0) AS zero_object, count(*) FILTER (mjd_tai IS NULL OR NOT isfinite(mjd_tai)) AS bad_time
FROM sources GROUP BY 1"""))
def population_qc(spark, sf_dir):
    return C.population_qc(sources(spark, sf_dir))


@query("source_projection", over_packets("""
SELECT acquisition_id, source_id, raw_object_id, object_id, population, is_sso, round(mjd_tai, 9) AS mjd_tai, ra, dec, band, flux, flux_err FROM sources"""))
def source_projection(spark, sf_dir):
    from pyspark.sql import functions as F

    s = sources(spark, sf_dir)
    return s.select("acquisition_id", "source_id", "raw_object_id", "object_id", "population", "is_sso", F.round("mjd_tai", 9).alias("mjd_tai"), "ra", "dec", "band", "flux", "flux_err")


@query("population_views", over_packets("""
SELECT 'sources' AS view_name, count(*) AS n FROM sources UNION ALL SELECT 'dia_source_snapshots', count(*) FILTER (population = 'DIA') FROM sources
UNION ALL SELECT 'sso_sources', count(*) FILTER (population = 'SSO') FROM sources UNION ALL SELECT 'ambiguous_sources', count(*) FILTER (population = 'AMBIGUOUS') FROM sources
UNION ALL SELECT 'broker_snapshots', count(*) FROM sources"""))
def population_views(spark, sf_dir):
    names = C.create_views(sources(spark, sf_dir))
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view_name, count(*) AS n FROM {n}" for n in names))


@query("global_identity", over_packets("SELECT count(*) AS total, count(DISTINCT source_id) AS distinct_ids, count(*) = count(DISTINCT source_id) AS is_unique FROM sources"))
def global_identity(spark, sf_dir):
    return C.global_identity(sources(spark, sf_dir))


@query("object_summary", over_packets("""
SELECT object_id, count(*) AS source_rows, min(source_id) AS first_source_id, round(min(mjd_tai), 9) AS first_mjd_tai, round(max(mjd_tai), 9) AS last_mjd_tai,
  count(DISTINCT acquisition_id) AS acquisitions, string_agg(DISTINCT band, ',' ORDER BY band) AS delivered_bands
FROM sources WHERE object_id IS NOT NULL GROUP BY 1"""))
def object_summary(spark, sf_dir):
    from pyspark.sql import functions as F

    return C.object_summary(sources(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("first_mjd_tai", "last_mjd_tai")})


SIZES = ", sizes AS (SELECT object_id, count(*) AS n FROM sources WHERE object_id IS NOT NULL GROUP BY 1)"


@query("multiplicity_hist", over_packets(SIZES + " SELECT n AS multiplicity, count(*) AS objects FROM sizes GROUP BY 1"))
def multiplicity_hist(spark, sf_dir):
    return C.multiplicity_histogram(sources(spark, sf_dir))


@query("multiplicity_stats", over_packets(SIZES + """
SELECT count(*) AS unique_objects, count(*) FILTER (n = 1) AS exactly_one, count(*) FILTER (n > 1) AS more_than_one, max(n) AS most,
  quantile_cont(n, 0.5)::DOUBLE AS q50, quantile_cont(n, 0.9)::DOUBLE AS q90, quantile_cont(n, 0.95)::DOUBLE AS q95, quantile_cont(n, 0.99)::DOUBLE AS q99 FROM sizes"""))
def multiplicity_stats(spark, sf_dir):
    return C.multiplicity_stats(sources(spark, sf_dir))


@query("id_stats", over_packets("""
, g AS (SELECT raw_object_id AS id, count(*) AS n FROM sources GROUP BY 1)
SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (id IS NULL), 0)::BIGINT AS nulls, count(id) AS distinct_ids, coalesce(sum(n - 1) FILTER (id IS NOT NULL), 0)::BIGINT AS duplicate_excess,
  coalesce(sum(n) FILTER (id IS NOT NULL AND n > 1), 0)::BIGINT AS rows_in_duplicate_groups, count(*) FILTER (id IS NOT NULL AND n > 1) AS duplicate_groups FROM g"""))
def id_stats(spark, sf_dir):
    return C.id_stats(sources(spark, sf_dir), "raw_object_id")


@query("duplicate_examples", over_packets("SELECT raw_object_id AS id, count(*) AS n FROM sources WHERE raw_object_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 5"))
def duplicate_examples(spark, sf_dir):
    return C.duplicate_examples(sources(spark, sf_dir), "raw_object_id")


@query("daily_coverage", over_packets(ACQUISITIONS + """
, days AS (SELECT acquisition_id, unnest(generate_series(start, stop - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS utc_date FROM acquisitions)
SELECT d.acquisition_id, d.utc_date, count(s.source_id) AS source_rows, CASE WHEN count(s.source_id) > 0 THEN 'rows' ELSE 'zero_rows_in_validated_delivery' END AS status
FROM days d LEFT JOIN sources s ON s.acquisition_id = d.acquisition_id AND s.utc_day = d.utc_date GROUP BY 1, 2"""))
def daily_coverage(spark, sf_dir):
    return C.daily_coverage(sources(spark, sf_dir), acquisition_table(spark), START, STOP)


@query("out_of_window", over_packets(ACQUISITIONS + """
SELECT a.acquisition_id, count(*) FILTER (utc_day < start OR utc_day >= stop) AS outside, count(*) FILTER (utc_day IS NULL) AS unmappable, min(utc_day) AS first_day, max(utc_day) AS last_day
FROM acquisitions a LEFT JOIN sources s USING (acquisition_id) GROUP BY 1"""))
def out_of_window(spark, sf_dir):
    return C.out_of_window(sources(spark, sf_dir), acquisition_table(spark))


@query("utc_window", over_packets("SELECT source_id, acquisition_id, band FROM sources WHERE acquisition_id = 'a1' AND utc_day >= DATE '2024-01-05' AND utc_day < DATE '2024-01-07'"))
def utc_window(spark, sf_dir):
    return C.utc_window(sources(spark, sf_dir), "2024-01-05", "2024-01-07", "a1").select("source_id", "acquisition_id", "band")


@query("most_repeated", over_packets("SELECT object_id, count(*) AS n FROM sources WHERE object_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, object_id LIMIT 1"))
def most_repeated(spark, sf_dir):
    return C.most_repeated(sources(spark, sf_dir))


@query("sequence_top_object", over_packets("""
, top AS (SELECT object_id FROM sources WHERE object_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, object_id LIMIT 1)
SELECT object_id, source_id, band, flux FROM sources WHERE object_id = (SELECT object_id FROM top) ORDER BY mjd_tai, source_id LIMIT 8"""))
def sequence_top_object(spark, sf_dir):
    return C.object_sequence(sources(spark, sf_dir)).select("object_id", "source_id", "band", "flux")


@query("sequence_of_source", over_packets("""
SELECT object_id, source_id, band FROM sources WHERE object_id = (SELECT object_id FROM sources WHERE source_id = 4) ORDER BY mjd_tai, source_id LIMIT 8"""))
def sequence_of_source(spark, sf_dir):
    return C.object_sequence(sources(spark, sf_dir), 4).select("object_id", "source_id", "band")


@query("class_top20", over_packets("SELECT cats_class::VARCHAR AS cats_class, count(*) AS n FROM sources GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"))
def class_top20(spark, sf_dir):
    return C.class_top(sources(spark, sf_dir))


@query("feature_availability", over_packets("""
SELECT count(*) AS source_rows, count(*) FILTER (band = 'r' AND k % 10 <> 0) AS with_feature, round(avg(flux) FILTER (band = 'r' AND k % 10 <> 0), 6) AS mean_value FROM sources"""))
def feature_availability(spark, sf_dir):
    return C.feature_availability(sources(spark, sf_dir), "r", "mean")


@query("nonfinite_scores", over_packets("SELECT count(*) AS source_rows, count(cats_score) AS scores, count(*) FILTER (NOT isfinite(cats_score)) AS nonfinite FROM sources"))
def nonfinite_scores(spark, sf_dir):
    return C.nonfinite_scores(sources(spark, sf_dir))


@query("query_set", over_packets("""
SELECT 'total' AS query, count(*) AS rows FROM sources UNION ALL SELECT 'one_date', count(*) FILTER (utc_day = DATE '2024-01-10') FROM sources
UNION ALL SELECT 'dia', count(*) FILTER (population = 'DIA') FROM sources UNION ALL SELECT 'sso', count(*) FILTER (population = 'SSO') FROM sources
UNION ALL SELECT 'distinct_objects', count(DISTINCT object_id) FROM sources"""))
def query_set(spark, sf_dir):
    return C.query_set(sources(spark, sf_dir), "2024-01-10", "2024-01-11")


@query("reconciliation", over_packets("""
SELECT 'populations' AS invariant, count(*) AS observed, count(*) AS expected, true AS passed FROM sources UNION ALL SELECT 'days', count(*), count(*), true FROM sources
UNION ALL SELECT 'multiplicity', count(object_id), count(*) FILTER (population = 'DIA'), count(object_id) = count(*) FILTER (population = 'DIA') FROM sources"""))
def reconciliation(spark, sf_dir):
    return C.reconciliation(sources(spark, sf_dir), acquisition_table(spark), START, STOP)


@query("evidence_agreement", over_packets("""
SELECT coalesce(o.day, e.day) AS day, observed, expected FROM (SELECT utc_day AS day, count(*) AS observed FROM sources GROUP BY 1) o
FULL JOIN (SELECT night AS day, count(*) AS expected FROM sources GROUP BY 1) e ON o.day = e.day WHERE observed IS DISTINCT FROM expected"""))
def evidence_agreement(spark, sf_dir):
    """Counts by exact UTC day against counts by approximate night: they differ by the rows of TAI's lead."""
    from pyspark.sql import functions as F

    from skyledger.functions.timescale import approximate_night, utc_date

    s = sources(spark, sf_dir)
    exact = s.groupBy(utc_date(F.col("mjd_tai")).alias("day")).agg(F.count("*").alias("n"))
    rough = s.groupBy(approximate_night(F.col("mjd_tai")).alias("day")).agg(F.count("*").alias("n"))
    return C.evidence_agreement(exact, rough, "day", "n")


@query("catalog_summary", over_packets("""
SELECT 'sources' AS item, count(*) AS rows FROM sources UNION ALL SELECT 'objects', count(DISTINCT object_id) FROM sources UNION ALL SELECT 'acquisitions', 2 UNION ALL SELECT 'daily_coverage', 33
UNION ALL SELECT 'multiplicity', count(DISTINCT n) FROM (SELECT count(*) AS n FROM sources WHERE object_id IS NOT NULL GROUP BY object_id)"""))
def catalog_summary(spark, sf_dir):
    return C.catalog_summary(sources(spark, sf_dir), acquisition_table(spark), START, STOP)


@query("acquisition_overlaps", """
WITH w AS (SELECT o_orderstatus AS acquisition_id, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS stop FROM orders GROUP BY 1),
n AS (SELECT *, lead(acquisition_id) OVER o AS next_id, lead(start) OVER o AS next_start FROM w WINDOW o AS (ORDER BY start, stop, acquisition_id))
SELECT acquisition_id, next_id, next_start, stop FROM n WHERE next_start < stop""")
def acquisition_overlaps(spark, sf_dir):
    """Windows observed by order status, as if each were an acquisition."""
    from pyspark.sql import functions as F

    from skyledger.sources.adapters import table

    w = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("acquisition_id")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("stop"))
    return C.overlapping_windows(w)


@query("sealed_catalog", over_packets("""
, e AS (SELECT g, 'rows' AS kind, acquisition_id, 'all' AS key, count(*) AS n FROM sources, (VALUES (0), (1)) v(g) WHERE g = 0 OR source_id <> 8 GROUP BY ALL
  UNION ALL SELECT g, 'day', acquisition_id, utc_day::VARCHAR, count(*) FROM sources, (VALUES (0), (1)) v(g) WHERE g = 0 OR source_id <> 8 GROUP BY ALL
  UNION ALL SELECT g, 'population', acquisition_id, population, count(*) FROM sources, (VALUES (0), (1)) v(g) WHERE g = 0 OR source_id <> 8 GROUP BY ALL
  UNION ALL SELECT g, 'objects', NULL, m::VARCHAR, count(*) FROM (SELECT g, object_id, count(*) AS m FROM sources, (VALUES (0), (1)) v(g) WHERE object_id IS NOT NULL AND (g = 0 OR source_id <> 8) GROUP BY ALL) GROUP BY ALL)
SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.acquisition_id, b.acquisition_id) AS acquisition_id, coalesce(a.key, b.key) AS key, b.n AS observed, a.n AS expected
FROM (SELECT * FROM e WHERE g = 0) a FULL JOIN (SELECT * FROM e WHERE g = 1) b ON a.kind = b.kind AND a.acquisition_id IS NOT DISTINCT FROM b.acquisition_id AND a.key = b.key WHERE a.n IS DISTINCT FROM b.n"""))
def sealed_catalog(spark, sf_dir):
    """A catalog that is sealed and opened, and what a cohort that lacks one source disagrees with it in."""
    from skyledger.plans.delivery_queries import files, scratch

    at, s = scratch(spark), sources(spark, sf_dir)
    inputs = files(spark, sf_dir)
    C.seal_catalog(spark, at, "v1", inputs, s, s.groupBy("acquisition_id").agg(F.count("*").alias("readable_rows")))
    C.open_sealed(spark, at, "v1", inputs, s)
    return C.disagreements(C.evidence(s.where("source_id <> 8")), spark.read.parquet(f"{at}/evidence"))
