"""From packets to the table family: aliases, nested columns, per-band features, nights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.nested import stable_json
from skyledger.functions.scalars import number
from skyledger.functions.timescale import approximate_night

#: Internal names, and the names by which deliveries call them, best first.
ALIASES = {
    "internal_object_id": ["diaObjectId", "r:diaObjectId", "objectId"],
    "internal_source_id": ["diaSourceId", "r:diaSourceId", "diaForcedSourceId", "r:diaForcedSourceId"],
    "ra": ["ra", "r:ra"],
    "dec": ["dec", "r:dec"],
    "time_mjd": ["midpointMjdTai", "r:midpointMjdTai", "firstDiaSourceMjdTai", "f:firstDiaSourceMjdTaiFink"],
    "band": ["band", "r:band"],
    "mag": ["mag", "r:mag"],
    "mag_err": ["magErr", "r:magErr"],
    "flux": ["psfFlux", "r:psfFlux", "scienceFlux", "r:scienceFlux"],
    "flux_err": ["psfFluxErr", "r:psfFluxErr", "scienceFluxErr", "r:scienceFluxErr"],
    "class_label": ["main_label_classifier", "f:main_label_classifier", "clf_cats_class", "f:clf_cats_class"],
    "tag": ["tag", "f:tag"],
}
NUMERIC = {"ra", "dec", "time_mjd", "mag", "mag_err", "flux", "flux_err"}
CLASS_MARKS, FORCED_MARKS = ("clf", "class", "score", "tag"), ("forced", "fp", "prv")


def quoted(name: str):
    return F.col(f"`{name}`")


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def normalize(df: DataFrame, table_type: str = "sources") -> DataFrame:
    """All columns as they came, and internal ones beside them: the table's type, each internal name of which an alias is there (from the
    first one; numbers as doubles, null where text is none), and the names of columns that nothing maps, as JSON in their order.

    An internal column takes the place of an original one of its name.
    """
    found = {k: c for k, names in ALIASES.items() if (c := first_present(df, names))}
    rest = [c for c in df.columns if c not in found.values()]
    new = {k: number(quoted(c)) if k in NUMERIC else quoted(c) for k, c in found.items()}
    unmapped = F.to_json(F.array(*map(F.lit, rest))) if rest else F.lit("[]")
    return df.withColumns({"internal_table_type": F.lit(table_type), **new, "_unmapped_fields": unmapped})


def outer_union(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shadow_json(df: DataFrame) -> DataFrame:
    """Add ``<column>_json`` for each nested column."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    return df.withColumns({f"{c}_json": F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


def nested_summary(df: DataFrame, *order: str, most: int = 3, chars: int = 500) -> DataFrame:
    """``column, kind, rows, filled, examples`` of nested columns; the examples are the ``most`` first filled values in ``order``, as stable JSON cut at ``chars``."""
    nested = [f for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    facts = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(type(f.dataType).__name__.removesuffix("Type").lower()).alias("kind"), F.count("*").alias("rows"), F.count(f.name).alias("filled")) for f in nested))
    told = df.agg(facts.alias("f")).select(F.explode("f").alias("f")).select("f.*")
    keys = [quoted(c) for c in order]
    first = [df.where(quoted(f.name).isNotNull()).select(F.struct(*keys).alias("at"), F.lit(f.name).alias("column"), F.substring(stable_json(quoted(f.name), f.dataType), 1, chars).alias("json")).orderBy("at").limit(most) for f in nested]
    shown = reduce(DataFrame.unionByName, first).groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda x: x["json"]), " ").alias("examples"))  # `most` rows a column
    return told.join(shown, "column", "left")


def lightcurve_features(packets: DataFrame, column: str = "lc_features", keep: tuple = ("diaSourceId", "diaObjectId", "midpointMjdTai")) -> DataFrame:
    """A row for each source and band, with ``feature_*`` columns; lists of (band, features) work like maps."""
    kind = packets.schema[column].dataType
    entries = F.map_entries(column) if isinstance(kind, T.MapType) else F.col(column)
    value = kind.valueType if isinstance(kind, T.MapType) else kind.elementType.fields[1].dataType
    names = kind.elementType.names if isinstance(kind, T.ArrayType) else ["key", "value"]
    out = packets.select(*keep, F.explode(entries).alias("e")).select(*keep, F.col(f"e.{names[0]}").cast("string").alias("feature_band"), F.col(f"e.{names[1]}").alias("v"))
    return out.select(*keep, "feature_band", *(F.col(f"v.{n}").alias(f"feature_{n}") for n in value.names), F.to_json("v").alias("features_json"))


def first_rows(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in a total order; null keys make one row. First rows are chosen in the task before the shuffle, so that
    rows of one key, or without one, never meet in one task."""
    columns = F.struct(*map(quoted, df.columns))
    rows = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(columns, F.struct(*order)).alias("_row"))
    return rows.select("_row.*")


def marked_columns(df: DataFrame, marks: tuple[str, ...], always: tuple[str, ...]) -> DataFrame:
    """Columns whose name has one of the marks, after those that identify a row."""
    names = [c for c in df.columns if c in always or any(m in c.lower() for m in marks)]
    return df.select(*names)


# Columns that tell a row's time, best first: MJDs, then timestamps.
MJD_COLUMNS = ["time_mjd", "midpointMjdTai", "r:midpointMjdTai", "firstDiaSourceMjdTai", "brokerIngestMjd"]
TIMESTAMP_COLUMNS = ["timestamp", "candidate_timestamp", "alert_timestamp", "brokerIngestTimestamp", "created_at"]


def with_night(df: DataFrame, *times: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Add ``night_key``: the approximate UTC night of the first usable time of the row, ``out_of_window`` for nights not in
    [start, stop) where both are given, and ``unknown`` without a time.

    times: the columns that are looked at (all usual ones that are there, if none are named); timestamps among them are read as UTC.
    """
    times = times or tuple(c for c in MJD_COLUMNS + TIMESTAMP_COLUMNS if c in df.columns)
    nights = []
    for c in times:
        stamped = c in TIMESTAMP_COLUMNS or isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        nights.append(F.col(f"`{c}`").cast("string").try_cast("timestamp_ntz").cast("date") if stamped else approximate_night(F.col(f"`{c}`")))
    night = F.coalesce(*nights).cast("string") if nights else F.lit(None).cast("string")
    if start and stop:
        night = F.when((night >= start) & (night < stop), night).when(night.isNotNull(), "out_of_window")
    return df.withColumn("night_key", F.coalesce(night, F.lit("unknown")))


def split_nights(df: DataFrame, nights: list[str], time: str) -> DataFrame:
    """Counts of rows of the wanted nights, ``out_of_window`` and ``unknown``."""
    key = F.col("night_key")
    label = F.when(key.isin(*nights, "unknown"), key).otherwise(F.lit("out_of_window"))
    return with_night(df, time).groupBy(label.alias("night")).agg(F.count("*").alias("rows"))


def stamp(df: DataFrame, **manifest: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in manifest.items()})


def table_family(packets: DataFrame, **manifest: str) -> dict[str, DataFrame]:
    """alerts, objects, forced_photometry, classifications, lightcurve_features and nightly_summary, as projections of one plan."""
    ids = ("diaSourceId", "diaObjectId")
    flat = [f.name for f in packets.schema.fields if not isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    family = {
        "alerts": packets.select(*flat),
        "objects": first_rows(packets.select(*flat).where("diaObjectId > 0"), "diaObjectId", ["diaSourceId"]),
        "forced_photometry": marked_columns(packets, FORCED_MARKS, ids),
        "classifications": marked_columns(packets, CLASS_MARKS, ids),
        "lightcurve_features": lightcurve_features(packets),
        "nightly_summary": nightly_summary(packets),
    }
    return {k: stamp(df, **manifest) for k, df in family.items()}


def nightly_summary(packets: DataFrame, by_night: bool = False) -> DataFrame:
    """One row (or one a night) of counts, ranges and bands."""
    x = lambda c: number(F.col(c))
    grouped = with_night(packets, "midpointMjdTai").groupBy(*(["night_key"] if by_night else []))
    return grouped.agg(
        F.count("*").alias("alerts"), F.count("diaSourceId").alias("with_source"), F.count("diaObjectId").alias("with_object"),
        F.size(F.collect_set("band")).cast("long").alias("bands"), F.to_json(F.array_sort(F.collect_set("band"))).alias("band_list"),
        F.min(x("midpointMjdTai")).alias("first_mjd"), F.max(x("midpointMjdTai")).alias("last_mjd"), F.min(x("ra")).alias("ra_min"), F.max(x("ra")).alias("ra_max"),
        F.min(x("dec")).alias("dec_min"), F.max(x("dec")).alias("dec_max"), F.min(x("psfFlux")).alias("flux_min"), F.max(x("psfFlux")).alias("flux_max"),
        F.count_if(x("psfFlux") < 0).alias("negative_flux"),
    )


def sample_objects(df: DataFrame) -> DataFrame:
    """Objects of a sample: rows, sources, first and last time, bands, and the place of the first row. Rows are grouped by object and source first, so that sources need no distinct count."""
    order = F.struct(F.col("midpointMjdTai").alias("t"), F.col("diaSourceId").alias("s"))
    by_source = df.where("diaObjectId is not null").groupBy("diaObjectId", "diaSourceId").agg(
        F.count("*").alias("n"), F.min("midpointMjdTai").alias("first_mjd"), F.max("midpointMjdTai").alias("last_mjd"), F.collect_set("band").alias("b"), F.min(order).alias("at"), F.min_by(F.struct("ra", "dec"), order).alias("place"),
    )
    return by_source.groupBy("diaObjectId").agg(
        F.sum("n").alias("rows"), F.count("diaSourceId").alias("sources"), F.min("first_mjd").alias("first_mjd"), F.max("last_mjd").alias("last_mjd"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("b")))), ",").alias("bands"), F.min_by("place", "at").alias("place"),
    ).select("diaObjectId", "rows", "sources", "first_mjd", "last_mjd", "bands", "place.ra", "place.dec")


def table_counts(family: dict[str, DataFrame], time: str = "midpointMjdTai") -> DataFrame:
    """``table_name, night_key, rows`` of each table of a family; a table without the time is of the night ``unsplit``."""
    by = [(with_night(df, time) if time in df.columns else df.withColumn("night_key", F.lit("unsplit"))).groupBy("night_key").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "night_key", "rows") for n, df in family.items()]
    return reduce(DataFrame.unionByName, by)


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without repeats of the first key that any row has, and ``key, rows, kept, duplicates, rate``."""
    present = df.agg(*(F.count(quoted(k)).alias(k) for k in keys if k in df.columns)).first().asDict()
    key = next((k for k in keys if present.get(k)), None)
    if key is None:
        return df, df.agg(F.lit(None).cast("string").alias("key"), F.count("*").alias("rows"), F.count("*").alias("kept"), F.lit(0).cast("long").alias("duplicates"), F.lit(0.0).alias("rate"))
    kept = first_rows(df, f"`{key}`", [quoted(c) for c in order])
    sizes = df.groupBy(quoted(key).alias("k")).agg(F.count("*").alias("n"))
    extra = F.sum(F.col("n") - 1)
    facts = sizes.agg(F.lit(key).alias("key"), F.sum("n").alias("rows"), F.count("*").alias("kept"), extra.alias("duplicates"), F.round(extra / F.sum("n"), 9).alias("rate"))
    return kept, facts


def tag_rows(texts: DataFrame, column: str) -> DataFrame:
    """``tag, description`` rows of a JSON dictionary name -> {description}."""
    parsed = F.from_json(column, "map<string,struct<description:string>>")
    return texts.select(F.explode(parsed).alias("tag", "v")).select("tag", F.col("v.description").alias("description"))
