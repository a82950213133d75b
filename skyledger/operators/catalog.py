"""The cohort catalog: typed projections of deliveries, populations, QC, and the fixed query set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.scalars import AMBIGUOUS, DIA, SSO, population
from skyledger.functions.timescale import is_finite, utc_date, window_bounds
from skyledger.sources.delivery import stat_fingerprint

#: name, path in the packet, type; the first three and the flag must exist with just these types
FLAT = [
    ("source_id", "diaSourceId", "long"), ("raw_object_id", "diaObjectId", "long"), ("mjd_tai", "midpointMjdTai", "double"),
    ("ra", "ra", "double"), ("dec", "dec", "double"), ("band", "band", "string"), ("flux", "psfFlux", "double"), ("flux_err", "psfFluxErr", "double"),
    ("is_sso", "pred.is_sso", "boolean"),
]
SNAPSHOTS = ["pred", "clf", "xm", "misc", "lc_features"]
STRICT = {"diaSourceId": T.LongType(), "diaObjectId": T.LongType(), "midpointMjdTai": T.DoubleType(), "pred.is_sso": T.BooleanType()}


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path, or None."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def admission_errors(schema: T.StructType) -> list[str]:
    """Why packets of this schema are refused: a strict path that is missing or of another type."""
    return [f"{p}: {'missing' if (k := field_type(schema, p)) is None else k.simpleString()}" for p, want in STRICT.items() if field_type(schema, p) != want]


def project_sources(packets: DataFrame, acquisition: str, *keep: str) -> DataFrame:
    """One typed row a packet, with the columns ``keep`` beside it; optional paths that are missing become typed nulls."""
    if errors := admission_errors(packets.schema):
        raise ValueError("; ".join(errors))
    flat = [(F.col(path).cast(kind) if field_type(packets.schema, path) else F.lit(None).cast(kind)).alias(name) for name, path, kind in FLAT]
    options = {"ignoreNullFields": "false"}
    shots = [(F.to_json(c, options) if c in packets.columns else F.lit(None).cast("string")).alias(f"{c}_json") for c in SNAPSHOTS]
    typed = packets.select(F.lit(acquisition).alias("acquisition_id"), *flat, *shots, *keep)
    kind = population(F.col("is_sso"), F.col("raw_object_id"))
    return typed.withColumn("population", kind).withColumn("object_id", F.when(kind == DIA, F.col("raw_object_id")))


def cohort(deliveries: list[tuple[str, DataFrame]]) -> DataFrame:
    """All deliveries as one table, each through its own projection."""
    return reduce(DataFrame.unionByName, (project_sources(df, name) for name, df in deliveries))


def population_views(sources: DataFrame) -> dict[str, DataFrame]:
    part = lambda p: sources.where(F.col("population") == p)
    return {
        "sources": sources, "dia_source_snapshots": part(DIA), "sso_sources": part(SSO), "ambiguous_sources": part(AMBIGUOUS),
        "broker_snapshots": sources.select("acquisition_id", "source_id", *(f"{c}_json" for c in SNAPSHOTS)),
    }


def create_views(sources: DataFrame) -> list[str]:
    views = population_views(sources)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def population_qc(sources: DataFrame) -> DataFrame:
    """Counts of identity and composition by acquisition. The distinct count comes from a grouping by id
    first, so that one shuffle serves all counts."""
    is_kind = lambda p: F.count_if(F.col("population") == p)
    by_id = sources.groupBy("acquisition_id", "source_id").agg(
        F.count("*").alias("n"), is_kind(DIA).alias("dia"), is_kind(SSO).alias("sso"), is_kind(AMBIGUOUS).alias("ambiguous"),
        F.count_if(F.col("is_sso").isNull()).alias("null_flag"), F.count_if(F.col("raw_object_id").isNull()).alias("null_object"),
        F.count_if(F.col("raw_object_id") == 0).alias("zero_object"), F.count_if(~is_finite(F.col("mjd_tai"))).alias("bad_time"),
    )
    names = ["dia", "sso", "ambiguous", "null_flag", "null_object", "zero_object", "bad_time"]
    return by_id.groupBy("acquisition_id").agg(
        F.sum("n").alias("source_rows"), F.count("source_id").alias("distinct_sources"),
        F.sum(F.when(F.col("source_id").isNull(), F.col("n")).otherwise(0)).alias("null_sources"),
        F.sum(F.when(F.col("source_id").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_excess"), *(F.sum(c).alias(c) for c in names),
    )


def id_stats(df: DataFrame, column: str) -> DataFrame:
    """Nulls, distinct values, duplicates in excess and in groups of one id column."""
    groups = df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    known, twice = F.col("id").isNotNull(), F.col("id").isNotNull() & (F.col("n") > 1)
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), total(~known, F.col("n")).alias("nulls"), F.count("id").alias("distinct_ids"),
        total(known, F.col("n") - 1).alias("duplicate_excess"), total(twice, F.col("n")).alias("rows_in_duplicate_groups"), F.count_if(twice).alias("duplicate_groups"),
    )


def duplicate_examples(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "id").limit(most)


def global_identity(sources: DataFrame) -> DataFrame:
    return id_stats(sources, "source_id").select("total", "distinct_ids", (F.col("total") == F.col("distinct_ids")).alias("is_unique"))


def object_summary(sources: DataFrame) -> DataFrame:
    """A row for each derived object: rows, least source, first and last time, acquisitions, bands."""
    return sources.where(F.col("object_id").isNotNull()).groupBy("object_id").agg(
        F.count("*").alias("source_rows"), F.min("source_id").alias("first_source_id"), F.min("mjd_tai").alias("first_mjd_tai"), F.max("mjd_tai").alias("last_mjd_tai"),
        F.size(F.collect_set("acquisition_id")).cast("long").alias("acquisitions"), F.array_join(F.array_sort(F.collect_set("band")), ",").alias("delivered_bands"),
    )


def multiplicity_histogram(sources: DataFrame) -> DataFrame:
    sizes = sources.where(F.col("object_id").isNotNull()).groupBy("object_id").agg(F.count("*").alias("multiplicity"))
    return sizes.groupBy("multiplicity").agg(F.count("*").alias("objects"))


def multiplicity_stats(sources: DataFrame) -> DataFrame:
    """Objects seen once and more often, the most rows, and exact linear quantiles. The quantiles come
    from the histogram, weighted by its counts, so that no list of all objects is gathered."""
    q = [0.5, 0.9, 0.95, 0.99]
    m, n = F.col("multiplicity"), F.col("objects")
    values = F.percentile(m, F.array(*map(F.lit, q)), n)
    out = multiplicity_histogram(sources).agg(
        F.sum("objects").alias("unique_objects"), F.sum(F.when(m == 1, n).otherwise(0)).alias("exactly_one"),
        F.sum(F.when(m > 1, n).otherwise(0)).alias("more_than_one"), F.max(m).alias("most"), values.alias("q"),
    )
    return out.select("unique_objects", "exactly_one", "more_than_one", "most", *(F.col("q")[k].alias(f"q{int(100 * x)}") for k, x in enumerate(q)))


def daily_coverage(sources: DataFrame, acquisitions: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows of each requested UTC day of each acquisition. Days without rows are results too.

    The range join of times with day edges becomes an equi-join: the day of a time is computed exactly, and the days
    of each window that was asked for are joined to day counts.
    """
    first, last = F.greatest("start", F.lit(start).cast("date")), F.date_sub(F.least("stop", F.lit(stop).cast("date")), 1)
    days = acquisitions.where(first <= last).select("acquisition_id", F.explode(F.sequence(first, last)).alias("utc_date"))
    seen = sources.groupBy("acquisition_id", utc_date(F.col("mjd_tai")).alias("utc_date")).agg(F.count("*").alias("n"))
    rows = F.coalesce("n", F.lit(0))
    status = F.when(rows > 0, F.lit("rows")).otherwise(F.lit("zero_rows_in_validated_delivery"))
    return days.join(seen, ["acquisition_id", "utc_date"], "left").select("acquisition_id", "utc_date", rows.alias("source_rows"), status.alias("status"))


def out_of_window(sources: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """By acquisition: rows outside its window, and rows whose time has no day."""
    day = utc_date(F.col("mjd_tai"))
    dated = sources.select("acquisition_id", day.alias("day")).groupBy("acquisition_id", "day").agg(F.count("*").alias("n"))
    outside = (F.col("day") < F.col("start")) | (F.col("day") >= F.col("stop"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return acquisitions.join(dated, "acquisition_id", "left").groupBy("acquisition_id").agg(count(outside)("outside"), count(F.col("day").isNull())("unmappable"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def utc_window(sources: DataFrame, start: str, stop: str, acquisition: str | None = None) -> DataFrame:
    """Rows of a half-open UTC window; the bounds are plain numbers, so the filter reaches the scan."""
    low, high = window_bounds(start, stop)
    kept = sources.where((F.col("mjd_tai") >= low) & (F.col("mjd_tai") < high))
    return kept.where(F.col("acquisition_id") == acquisition) if acquisition else kept


def most_repeated(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("object_id").isNotNull()).groupBy("object_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object_id").limit(1)


def object_sequence(sources: DataFrame, source_id: int | None = None, most: int = 8) -> DataFrame:
    """The first detections of the object that owns a source (without one: of the most repeated object)."""
    chosen = most_repeated(sources) if source_id is None else sources.where((F.col("source_id") == source_id) & F.col("object_id").isNotNull()).select("object_id").limit(1)
    found = sources.join(F.broadcast(chosen.select("object_id")), "object_id", "left_semi")  # one row
    return found.select("object_id", "source_id", "mjd_tai", "band", "flux").orderBy("mjd_tai", "source_id").limit(most)


def class_top(sources: DataFrame, most: int = 20) -> DataFrame:
    label = F.get_json_object("clf_json", "$.cats_class")
    return sources.groupBy(label.alias("cats_class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("cats_class").asc_nulls_last()).limit(most)


def feature_availability(sources: DataFrame, band: str, feature: str) -> DataFrame:
    """Rows with one feature of one band, and its mean."""
    x = F.get_json_object("lc_features_json", f"$.{band}.{feature}").try_cast("double")
    return sources.agg(F.count("*").alias("source_rows"), F.count(x).alias("with_feature"), F.round(F.avg(x), 6).alias("mean_value"))


def nonfinite_scores(sources: DataFrame) -> DataFrame:
    x = F.get_json_object("clf_json", "$.cats_score").try_cast("double")
    return sources.agg(F.count("*").alias("source_rows"), F.count(x).alias("scores"), F.count_if(x.isNotNull() & ~is_finite(x)).alias("nonfinite"))


def query_set(sources: DataFrame, day: str, next_day: str) -> DataFrame:
    """The fixed smoke queries as ``query, rows``; one grouping by object serves the distinct count and all others."""
    low, high = window_bounds(day, next_day)
    on_day = (F.col("mjd_tai") >= low) & (F.col("mjd_tai") < high)
    counts = {"one_date": on_day, "dia": F.col("population") == DIA, "sso": F.col("population") == SSO}
    by_object = sources.groupBy("object_id").agg(F.count("*").alias("total"), *(F.count_if(x).alias(k) for k, x in counts.items()))
    facts = by_object.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", *counts)), F.count("object_id").alias("distinct_objects"))
    return facts.unpivot([], facts.columns, "query", "rows")


def reconciliation(sources: DataFrame, acquisitions: DataFrame, start: str, stop: str) -> DataFrame:
    """Sums that must agree: populations, days (with rows outside) and multiplicity, each with the total.

    One grouping by acquisition, day and population, whose rows are few, gives the first two, and one by object the third.
    """
    small = sources.groupBy("acquisition_id", utc_date(F.col("mjd_tai")).alias("day"), "population").agg(F.count("*").alias("n"))
    asked = acquisitions.groupBy("acquisition_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    low, high = F.greatest("start", F.lit(start).cast("date")), F.least("stop", F.lit(stop).cast("date"))
    inside, outside = (F.col("day") >= low) & (F.col("day") < high), F.col("day").isNull() | (F.col("day") < F.col("start")) | (F.col("day") >= F.col("stop"))
    known = F.col("start").isNotNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    totals = small.join(F.broadcast(asked), "acquisition_id", "left").agg(  # acquisitions are a short list
        total(F.lit(True)).alias("total"), total(F.col("population") == DIA).alias("dia"), total(F.col("population").isin(DIA, SSO, AMBIGUOUS)).alias("populations"),
        total(known & inside).alias("days"), total(known & outside).alias("outside"),
    )
    sizes = multiplicity_histogram(sources).agg(F.coalesce(F.sum(F.col("multiplicity") * F.col("objects")), F.lit(0)).alias("by_object"))
    joined = totals.join(sizes)  # one row each
    check = lambda name, x, y: F.struct(F.lit(name).alias("invariant"), x.cast("long").alias("observed"), y.cast("long").alias("expected"), (x == y).alias("passed"))
    c = F.col
    rows = F.array(check("populations", c("populations"), c("total")), check("days", c("days") + c("outside"), c("total")), check("multiplicity", c("by_object"), c("dia")))
    return joined.select(F.explode(rows).alias("r")).select("r.*")


def overlapping_windows(acquisitions: DataFrame) -> DataFrame:
    """Pairs of neighbouring acquisitions whose windows overlap (the table is a short list)."""
    after = W.orderBy("start", "stop", "acquisition_id")
    following = acquisitions.withColumn("next_id", F.lead("acquisition_id").over(after)).withColumn("next_start", F.lead("start").over(after))
    return following.where("next_start < stop").select("acquisition_id", "next_id", "next_start", "stop")


def duplicate_acquisitions(acquisitions: DataFrame) -> DataFrame:
    return acquisitions.groupBy("acquisition_id").agg(F.count("*").alias("n")).where("n > 1")


def evidence_agreement(observed: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, or that one side lacks: one row a disagreement."""
    o, e = observed.select(key, F.col(value).alias("observed")), expected.select(key, F.col(value).alias("expected"))
    return o.join(e, key, "full_outer").where(~F.col("observed").eqNullSafe(F.col("expected")))


def catalog_summary(sources: DataFrame, acquisitions: DataFrame, start: str, stop: str) -> DataFrame:
    """``item, rows`` of the catalog's tables; one grouping by object tells the rows of all sources, of objects and of their histogram."""
    by_object = sources.groupBy("object_id").agg(F.count("*").alias("n"))
    by_size = by_object.groupBy(F.when(F.col("object_id").isNotNull(), F.col("n")).alias("multiplicity")).agg(F.count("*").alias("objects"), F.sum("n").alias("rows"))
    facts = by_size.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("sources"), F.coalesce(F.sum(F.when(F.col("multiplicity").isNotNull(), F.col("objects"))), F.lit(0)).alias("objects"), F.count("multiplicity").alias("multiplicity")
    )
    first, last = F.greatest("start", F.lit(start).cast("date")), F.least("stop", F.lit(stop).cast("date"))
    asked = acquisitions.agg(F.count("*").alias("acquisitions"), F.coalesce(F.sum(F.greatest(F.datediff(last, first), F.lit(0))), F.lit(0)).alias("daily_coverage"))
    whole = facts.join(asked)  # one row each
    return whole.select(*(F.col(c).cast("long").alias(c) for c in whole.columns)).unpivot([], whole.columns, "item", "rows")



def open_catalog(spark: SparkSession, manifest: DataFrame, contract: str, fingerprint: str) -> None:
    """Refuse a catalog whose manifest (``contract, status, fingerprint``) isn't of this contract, passed, and of the same inputs."""
    row = manifest.first()
    if row is None or row.contract != contract or row.status != "PASS" or row.fingerprint != fingerprint:
        raise ValueError("the catalog is not of this contract, did not pass, or its inputs have changed")


#: Columns of what a catalog is proved by: rows, days and populations by acquisition, and how many objects have how many rows.
EVIDENCE = ["kind", "acquisition_id", "key", "n"]


def evidence(sources: DataFrame) -> DataFrame:
    """``kind, acquisition_id, key, n``: the facts of a catalog as one table. All come from two groupings, one by acquisition, day and population, one by object."""
    small = sources.groupBy("acquisition_id", utc_date(F.col("mjd_tai")).cast("string").alias("day"), "population").agg(F.count("*").alias("n"))
    days = small.groupBy("acquisition_id", F.coalesce("day", F.lit("unmappable")).alias("day"), "population").agg(F.sum("n").alias("n"))
    sets = days.groupingSets([["acquisition_id"], ["acquisition_id", "day"], ["acquisition_id", "population"]], "acquisition_id", "day", "population").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("day").isNotNull(), "day").when(F.col("population").isNotNull(), "population").otherwise("rows")
    told = sets.select(kind.alias("kind"), "acquisition_id", F.coalesce("day", "population", F.lit("all")).alias("key"), "n")
    sizes = multiplicity_histogram(sources).select(F.lit("objects").alias("kind"), F.lit(None).cast("string").alias("acquisition_id"), F.col("multiplicity").cast("string").alias("key"), F.col("objects").alias("n"))
    return told.unionByName(sizes)


def disagreements(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """``kind, acquisition_id, key, observed, expected`` where two tables of evidence differ, or one lacks what the other has. Only kinds that both tell are compared."""
    both = observed.select("kind").distinct().join(expected.select("kind").distinct(), "kind", "left_semi")
    o, e = (df.join(F.broadcast(both), "kind", "left_semi").select("kind", "acquisition_id", "key", F.col("n").alias(name)) for df, name in ((observed, "observed"), (expected, "expected")))  # four kinds
    e = e.toDF("_kind", "_acquisition", "_key", "expected")
    met = o.join(e, (F.col("kind") == F.col("_kind")) & F.col("acquisition_id").eqNullSafe(F.col("_acquisition")) & (F.col("key") == F.col("_key")), "full_outer")
    return met.where(~F.col("observed").eqNullSafe(F.col("expected"))).select(
        F.coalesce("kind", "_kind").alias("kind"), F.coalesce("acquisition_id", "_acquisition").alias("acquisition_id"), F.coalesce("key", "_key").alias("key"), "observed", "expected"
    )


def receipt_evidence(receipts: DataFrame) -> DataFrame:
    """Readable rows of deliveries (``acquisition_id, readable_rows``) as evidence; an acquisition may have several."""
    total = receipts.groupBy("acquisition_id").agg(F.sum("readable_rows").alias("n"))
    return total.select(F.lit("rows").alias("kind"), "acquisition_id", F.lit("all").alias("key"), "n")


class Refused(ValueError):
    """A catalog that can't be sealed or opened, and why."""


def refuse(what: str, wrong: DataFrame, most: int = 5) -> None:
    """Raise if there are disagreements; the first are named."""
    found = [f"{r.kind} {r.acquisition_id or ''} {r.key}: {r.observed} instead of {r.expected}" for r in wrong.orderBy("kind", "acquisition_id", "key").limit(most).collect()]
    if found:
        raise Refused(f"{what}: " + "; ".join(found))


def seal_catalog(spark: SparkSession, folder: str, contract: str, files: DataFrame, sources: DataFrame, receipts: DataFrame, accepted: DataFrame | None = None) -> None:
    """Write what proves a catalog, and last, if nothing contradicts it, the manifest that it passed.

    files: ``path, length, modified`` of its inputs. The counted rows must be those of the receipts, and every source id must be there once; where a characterisation was
    accepted before (a table of ``evidence``), days, populations and objects must be the same. A folder that holds a catalog is never overwritten.
    """
    before = stat_fingerprint(files).first().fingerprint
    evidence(sources).write.mode("errorifexists").parquet(f"{folder}/evidence")
    found = spark.read.parquet(f"{folder}/evidence")
    refuse("rows differ from the receipts", disagreements(found.where("kind = 'rows'"), receipt_evidence(receipts)))
    ids = id_stats(sources, "source_id").first()
    if ids.nulls or ids.duplicate_excess:
        raise Refused(f"source ids: {ids.nulls} missing, {ids.duplicate_excess} repeated")
    if accepted is not None:
        refuse("the catalog differs from its accepted characterisation", disagreements(found, accepted))
    if stat_fingerprint(files).first().fingerprint != before:
        raise Refused("the inputs changed while they were read")
    manifest = spark.createDataFrame([(contract, "PASS", before, ids.total)], "contract string, status string, fingerprint string, source_rows long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")


def open_sealed(spark: SparkSession, folder: str, contract: str, files: DataFrame, sources: DataFrame, recount: bool = True) -> list[str]:
    """Make the views of a sealed catalog (their names are returned), unless it is of another contract, did not pass, its inputs are no longer those that were
    sealed, or, with ``recount``, a day, population or multiplicity counted now is not the one sealed."""
    row = spark.read.parquet(f"{folder}/manifest").first() if path_exists(spark, f"{folder}/manifest") else None
    if row is None or row.status != "PASS":
        raise Refused("the catalog has not passed")
    if row.contract != contract:
        raise Refused(f"the catalog is of contract {row.contract}")
    if stat_fingerprint(files).first().fingerprint != row.fingerprint:
        raise Refused("the inputs have changed since the catalog was sealed")
    if recount:
        refuse("the catalog is not what was sealed", disagreements(evidence(sources), spark.read.parquet(f"{folder}/evidence")))
    return create_views(sources)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
