"""Lookups and capped windows: cone search, known ids, partitions of a window, identifiers in any JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.functions.scalars import angular_distance
from skyledger.functions.timescale import time_bucket


def cone_search(df: DataFrame, ra: float, dec: float, radius_arcsec: float, most: int) -> DataFrame:
    """Rows within a radius of at most 60 arc seconds, nearest first. A box on plain columns, which reaches the scan,
    goes before the exact distance; it knows the wrap at 0 h and the poles."""
    if not 0 < radius_arcsec <= 60:
        raise ValueError("the radius must be above 0 and at most 60 arc seconds")
    import math

    r = radius_arcsec / 3600 * 1.0001
    box = F.col("dec").between(dec - r, dec + r)
    if abs(dec) + r < 89.9:
        w = r / math.cos(math.radians(abs(dec) + r))
        low, high = ra - w, ra + w
        near = F.col("ra").between(low, high)
        if low < 0:
            near = near | (F.col("ra") >= low + 360)
        if high >= 360:
            near = near | (F.col("ra") <= high - 360)
        box = box & near
    found = df.where(box).withColumn("separation", angular_distance(F.col("ra"), F.col("dec"), ra, dec))
    return found.where(F.col("separation") <= radius_arcsec).orderBy("separation", "source_id").limit(most)


def for_known_ids(df: DataFrame, ids: DataFrame, key: str, most_ids: int = 1000) -> DataFrame:
    """All rows of the first ``most_ids`` distinct ids; that cap, which is the feature, bounds the broadcast."""
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(most_ids)
    return df.join(F.broadcast(wanted), key, "left_semi")


def tagged(df: DataFrame, tag: Column, order: list, most: int) -> DataFrame:
    """The first ``most`` rows with a tag, and whether the result may be cut."""
    top = df.where(tag).orderBy(*order).limit(most)
    return top.withColumn("truncated", F.count("*").over(W.partitionBy()) >= most)


def partition_windows(df: DataFrame, time: str, low: float, high: float, parts: int, cap: int) -> DataFrame:
    """``part, rows, kept, status`` of equal parts of a window: empty, exhausted, or possibly truncated at the cap."""
    bucket = time_bucket(F.col(time), low, high, parts)
    counts = df.select(bucket.alias("part")).where("part is not null").groupBy("part").agg(F.count("*").alias("rows"))
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    rows = F.coalesce("rows", F.lit(0))
    status = F.when(rows == 0, "empty").when(rows >= cap, "possibly_truncated").otherwise("exhausted")
    return every.join(counts, "part", "left").select("part", rows.alias("rows"), F.least(rows, F.lit(cap)).cast("long").alias("kept"), status.alias("status"))


def classify_partitions(results: DataFrame) -> DataFrame:
    """``part, rows, status, message`` of answers ``part, ok, rows, requested, error``: failed, empty, possibly truncated at the rows that were asked for, or exhausted.

    A failed answer has no rows, whatever came with it; one that asked for no number of rows can't have been cut.
    """
    ok, rows, cap = F.coalesce(F.col("ok"), F.lit(False)), F.coalesce(F.col("rows"), F.lit(0)), F.coalesce(F.col("requested"), F.lit(0))
    case = F.when(~ok, 0).when(rows == 0, 1).when((cap > 0) & (rows >= cap), 2).otherwise(3)
    told = results.withColumns({"_case": case, "_rows": F.when(ok, rows).otherwise(0).cast("long")})
    of = lambda *values: F.element_at(F.array(*values), F.col("_case") + 1)
    fixed = ["Partition returned zero rows", "Partition returned the requested row cap", "Partition returned fewer rows than requested cap"]
    message = of(F.coalesce(F.col("error"), F.lit("request failed")), *map(F.lit, fixed))
    return told.select("part", F.col("_rows").alias("rows"), of(*map(F.lit, ["failed", "empty", "possibly_truncated", "exhausted"])).alias("status"), message.alias("message"))


def refine_windows(df: DataFrame, time: str, low: float, high: float, parts: int, cap: int, most_parts: int) -> tuple[DataFrame, int]:
    """Double the number of parts until none may be truncated; at most log2(most_parts / parts) small jobs."""
    while True:
        found = partition_windows(df, time, low, high, parts, cap)
        if 2 * parts > most_parts or found.where("status = 'possibly_truncated'").isEmpty():
            return found, parts
        parts *= 2


def partition_rollup(parts: DataFrame) -> DataFrame:
    return parts.groupBy("status").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("kept").alias("kept"))


def safety_cap(parts: DataFrame, cap: int) -> DataFrame:
    """Parts in order; once the rows of those before reach the cap, the rest are skipped. (Parts are a short list.)"""
    before = F.coalesce(F.sum("kept").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("action", F.when(before >= cap, "skipped").otherwise("taken"))


def completeness(parts: DataFrame, comparable: bool, expected: int | None) -> DataFrame:
    """Rows kept of all parts; a fraction only if what is expected is comparable, for counts alone prove nothing."""
    share = F.sum("kept") / F.lit(float(expected)) if comparable and expected else F.lit(None).cast("double")
    return parts.agg(F.sum("kept").alias("kept"), F.count_if(F.col("status") == "possibly_truncated").alias("truncated_parts"), F.round(share, 6).alias("fraction"))


#: Scalars that a task hands on at once.
WALKED = 20_000


def walk_json(texts: DataFrame, column: str, origin: str | None = None) -> DataFrame:
    """``path, field, value, kind`` (and ``origin``, where a column tells it) of every scalar at any depth; each text is read once. kind: integer, number, text, boolean or null.
    Text that is no JSON has none. The field of a list's own scalars is the one that the list stands under."""
    named = texts.select(column, F.col(origin).cast("string").alias("origin") if origin else F.lit(None).cast("string").alias("origin")).where(F.col(column).isNotNull())
    found = named.mapInPandas(walk_batch, "path string, field string, value string, kind string, origin string")
    return found if origin else found.drop("origin")


def walk_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scalars of JSON texts, at most about ``WALKED`` at once; without recursion, so that depth has no limit but the parser's."""
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "field", "value", "kind", "origin"])
    for batch in batches:
        found = []
        for text, origin in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
            try:
                todo = [("$", "", json.loads(text))]
            except (ValueError, RecursionError):
                continue
            while todo:
                p, f, x = todo.pop()
                if isinstance(x, dict):
                    todo += [(f"{p}.{k}", k, v) for k, v in x.items()]
                elif isinstance(x, list):
                    todo += [(f"{p}[{k}]", f, v) for k, v in enumerate(x)]
                elif isinstance(x, str):
                    found.append((p, f, x, "text", origin))
                else:
                    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number"
                    found.append((p, f, None if x is None else json.dumps(x), kind, origin))
                if len(found) >= WALKED:
                    yield frame(found)
                    found = []
        yield frame(found)


# Names of identifiers.
OBJECT_NAMES = ["diaobjectid", "r:diaobjectid", "dia_object_id", "objectid"]
SOURCE_NAMES = ["diasourceid", "r:diasourceid", "dia_source_id"]
ID_TYPES = ["diaObjectId", "diaSourceId", "other_object_ids", "other_source_ids"]


def candidate_ids(scalars: DataFrame) -> DataFrame:
    """``id_type, confidence, field, value, path`` (and ``origin``, if the scalars have one) of what looks like an identifier, each value of a field once, where it stands first.

    The field's name tells the type: names that are known are of high confidence, others that speak of an object's or a source's id of medium.
    A number must be whole and positive; text must not be blank or say that it is nothing. A list's own scalars are no fields.
    """
    name, text = F.translate(F.lower("field"), "-", "_"), F.lower(F.trim("value"))
    kind = (
        F.when(name.isin(OBJECT_NAMES) | name.endswith("diaobjectid"), "diaObjectId").when(name.isin(SOURCE_NAMES) | name.endswith("diasourceid"), "diaSourceId")
        .when(name.contains("object") & name.contains("id"), "other_object_ids").when(name.contains("source") & name.contains("id"), "other_source_ids")
    )
    number = F.col("value").try_cast("double")
    usable = F.when(F.col("kind").isin("integer", "number"), (number > 0) & (number == F.floor(number))).when(F.col("kind") == "text", (text != "") & ~text.isin("nan", "none", "null"))
    found = scalars.withColumn("id_type", kind).where(kind.isNotNull() & F.coalesce(usable, F.lit(False)) & ~F.col("path").endswith("]"))
    confidence = F.when(F.col("id_type").isin("diaObjectId", "diaSourceId"), "high").otherwise("medium")
    named = found.select("id_type", confidence.alias("confidence"), "field", "value", F.struct(*([F.col("origin")] if "origin" in scalars.columns else []), "path").alias("at"))
    first = named.groupBy("id_type", "confidence", "field", "value").agg(F.min("at").alias("at"))
    return first.select("id_type", "confidence", "field", "value", "at.*")


def best_candidate(candidates: DataFrame, kind: str) -> DataFrame:
    """The candidate object or source id of the highest confidence, of those the least value as text."""
    types = [t for t in ID_TYPES if kind in t.lower()]
    return candidates.where(F.col("id_type").isin(types)).orderBy(F.col("confidence") != "high", "value", "field").limit(1)


def candidate_summary(candidates: DataFrame, most: int = 5) -> DataFrame:
    """``id_type, ids, fields, examples`` of all four types, and ``origins, first_origins`` if the candidates have them; the examples are the ``most`` least values, as a JSON
    list, the first origins likewise. Values and origins are counted before they meet, and no list is longer than ``most``."""
    types = candidates.sparkSession.createDataFrame([(t,) for t in ID_TYPES], "id_type string")
    counts = candidates.groupBy("id_type", "field").agg(F.count("*").alias("n")).groupBy("id_type").agg(F.sum("n").alias("ids"), F.count("*").alias("fields"))

    def firsts(values: DataFrame, name: str) -> DataFrame:
        ranked = values.withColumn("place", F.row_number().over(W.partitionBy("id_type").orderBy("value"))).where(F.col("place") <= most)
        return ranked.groupBy("id_type").agg(F.to_json(F.array_sort(F.collect_list("value"))).alias(name))

    joined = types.join(counts, "id_type", "left").join(firsts(candidates.select("id_type", "value"), "examples"), "id_type", "left")
    zero, none = (lambda c: F.coalesce(c, F.lit(0)).alias(c)), (lambda c: F.coalesce(c, F.lit("[]")).alias(c))
    columns = ["id_type", zero("ids"), zero("fields"), none("examples")]
    if "origin" in candidates.columns:
        origins = candidates.where("origin is not null").groupBy("id_type", F.col("origin").alias("value")).agg(F.lit(1))
        joined = joined.join(origins.groupBy("id_type").agg(F.count("*").alias("origins")), "id_type", "left").join(firsts(origins.select("id_type", "value"), "first_origins"), "id_type", "left")
        columns += [zero("origins"), none("first_origins")]
    return joined.select(*columns)


#: Concepts, and what a field's name holds that speaks of one.
CONCEPTS = {
    "object_id": ["objectid", "diaobjectid", "diaobject", "ssobjectid"],
    "source_id": ["candid", "diasourceid", "diasource", "alertid"],
    "ra": [":ra", " ra", "jradeg", "coord_ra", "ra"],
    "dec": [":dec", "jdedeg", "coord_dec", "declination", "dec"],
    "time": [":jd", "mjd", "midpointtai", "tai", "time", "timestamp"],
    "band_or_filter": ["fid", "band", "filter"],
    "magnitude_or_flux": ["mag", "flux", "psf", "snr"],
    "classification": ["class", "classification", "rf_", "snn", "cats"],
    "tag": ["tag"],
    "crossmatch_or_context": ["xmatch", "simbad", "tns", "gaia", "host", "ssnamenr", "mpc"],
    "forced_photometry": ["forced", "forcedsource", "diaforcedsource"],
    "cutout": ["cutout", "stamp"],
}


def concepts(fields: DataFrame, marks: dict[str, list[str]] = CONCEPTS, most: int = 20) -> DataFrame:
    """``concept, fields, examples`` of every concept: how many different field names speak of it, and the first ``most`` of them by name."""
    names = fields.select("field").where("field <> ''").distinct()
    has = lambda ms: F.lower("field").rlike("|".join(ms))  # noqa: E731  (marks are plain letters, colons and blanks)
    told = names.select("field", F.explode(F.array_compact(F.array(*(F.when(has(ms), c) for c, ms in marks.items())))).alias("concept"))
    ranked = told.withColumn("place", F.row_number().over(W.partitionBy("concept").orderBy("field")))  # names of columns: a small table
    counted = ranked.groupBy("concept").agg(F.count("*").alias("fields"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("field")))), ", ").alias("examples"))
    every = fields.sparkSession.createDataFrame([(c,) for c in marks], "concept string")
    return every.join(counted, "concept", "left").select("concept", F.coalesce("fields", F.lit(0)).alias("fields"), F.coalesce("examples", F.lit("")).alias("examples"))


def partition_labels(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """``label, rows`` of each wanted value of a band or tag column, those without rows included."""
    labels = df.sparkSession.createDataFrame([(w,) for w in wanted], "value string")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return labels.join(counts, "value", "left").select(F.concat(F.lit(f"{column}="), "value").alias("label"), F.coalesce("rows", F.lit(0)).alias("rows"))
