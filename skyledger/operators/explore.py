"""Exploration: value counts, ranges, missingness, variability, histograms and crosstabs as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.scalars import number
from skyledger.functions.timescale import mjd_to_date


def value_counts(df: DataFrame, column: str, most: int = 20, chars: int = 200) -> DataFrame:
    """The commonest values as text, cut at ``chars``; ties in text order."""
    value = F.substring(F.col(column).cast("string"), 1, chars)
    return df.where(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def delivery_summary(df: DataFrame, source: str, obj: str) -> DataFrame:
    """Rows, and distinct sources and objects: one grouping by each id beside the count, so that no row is expanded."""
    distinct = lambda c, name: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1)).agg(F.count("*").alias(name))
    return df.agg(F.count("*").alias("rows")).crossJoin(distinct(source, "unique_sources")).crossJoin(distinct(obj, "unique_objects"))  # one row each


def stacked(df: DataFrame, facts: list[Column]) -> DataFrame:
    """One aggregate row of structs as rows."""
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, filled, numeric, least, greatest``; text that is a number counts as one, and -0 as 0."""
    x = {c: number(F.col(c)) + F.lit(0.0) for c in columns}
    return stacked(df, [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.count(v).alias("numeric"), F.min(v).alias("least"), F.max(v).alias("greatest")) for c, v in x.items()])


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, missing, fraction``; NaN is missing."""
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False))
    return stacked(df, [F.struct(F.lit(c).alias("column"), F.count_if(gone(c)).alias("missing"), F.round(F.avg(gone(c).cast("int")), 9).alias("fraction")) for c in columns or df.columns])


def column_availability(df: DataFrame, names: list[str]) -> DataFrame:
    """``column, present, filled`` of wanted columns."""
    return stacked(df, [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), (F.count(c) if c in df.columns else F.lit(0).cast("long")).alias("filled")) for c in names])


def rows_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def variability(df: DataFrame, obj: str) -> DataFrame:
    """Objects with two rows or more, and the most rows of one."""
    sizes = df.where(F.col(obj).isNotNull()).groupBy(obj).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("objects"), F.count_if(F.col("n") >= 2).alias("with_two_or_more"), F.max("n").alias("most_rows"))


def flux_amplitude(df: DataFrame, obj: str, flux: str) -> DataFrame:
    """Objects whose flux varies, and the greatest range."""
    x = number(F.col(flux))
    spread = df.where(F.col(obj).isNotNull()).groupBy(obj).agg((F.max(x) - F.min(x)).alias("amplitude"))
    return spread.agg(F.count("amplitude").alias("objects"), F.count_if(F.col("amplitude") > 0).alias("nonzero"), F.max("amplitude").alias("greatest"))


def chi_like(df: DataFrame, obj: str, flux: str, error: str) -> DataFrame:
    """By object: sum of ((flux - mean) / error)^2 over max(n - 1, 1), for positive errors and two rows or more.

    The mean is joined back before anything is squared, since a difference of sums of squares would lose all digits where fluxes are large
    beside their errors. Both groupings are merged before the shuffle, and Spark splits the join where an object is hot.
    """
    f, e = number(F.col(flux)), number(F.col(error))
    rows = df.where(F.col(obj).isNotNull() & f.isNotNull() & (e > 0)).select(F.col(obj).alias("object_id"), f.alias("f"), e.alias("e"))
    means = rows.groupBy("object_id").agg(F.count("*").alias("n"), F.avg("f").alias("m")).where("n >= 2")
    z = (F.col("f") - F.col("m")) / F.col("e")
    return rows.join(means, "object_id").groupBy("object_id", "n").agg(F.sum(z * z).alias("s")).select("object_id", "n", (F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))).alias("chi_like"))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last one is closed. A single value lies in the middle bin of a range of one."""
    usual = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when(high > low, F.greatest(usual, F.lit(0))).otherwise(F.lit(bins // 2)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, n, left_edge`` of a column's finite numbers; empty bins have no row. Bounds default to its range."""
    x = number(F.col(column))
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    if low is None or high is None:
        values = values.join(F.broadcast(values.agg(F.min("x").alias("low"), F.max("x").alias("high"))))  # one row
    else:
        values = values.where(F.col("x").between(low, high)).withColumns({"low": F.lit(low), "high": F.lit(high)})
    counted = values.groupBy("low", "high", bin_of(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", "n", F.round(F.col("low") + (F.col("high") - F.col("low")) * F.col("bin") / bins, 6).alias("left_edge"))


def brackets(values: DataFrame, shares: list[float], accuracy: int) -> tuple[list[tuple[float, float]], int]:
    """Closed intervals, apart from each other and rising, that hold the quantiles of ``shares`` of the column ``x``, and the number of values. One mergeable sketch tells
    them all; its ranks are off by one part in ``accuracy`` at most."""
    wide = 2.0 / accuracy
    asked = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-wide, wide)})
    told = values.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", asked, accuracy).alias("q")).first()
    if not told.n:
        return [], 0
    at = dict(zip(asked, told.q, strict=True)) | {0.0: told.low, 1.0: told.high}
    out: list[tuple[float, float]] = []
    for low, high in sorted((at[max(s - wide, 0.0)], at[min(s + wide, 1.0)]) for s in shares):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out, told.n


def ranked_values(values: DataFrame, inside: list[tuple[float, float]], ranks: list[int]) -> DataFrame:
    """``rank, value`` of the column ``x`` at those ``ranks`` (from 0) that lie inside the intervals; one scan. Values between intervals are only counted,
    those inside are counted by value, and both before the shuffle; ranks inside an interval come from running counts."""
    part, value = F.lit(2 * len(inside)), F.lit(None).cast("double")
    for k, (low, high) in reversed(list(enumerate(inside))):
        part = F.when(F.col("x") < low, 2 * k).when(F.col("x") <= high, 2 * k + 1).otherwise(part)
        value = F.when((F.col("x") >= low) & (F.col("x") <= high), F.col("x")).otherwise(value)
    counted = values.where("x is not null").groupBy(part.alias("part"), value.alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("part").orderBy("value"))
    running = counted.withColumn("upto", total)
    whole = running.groupBy("part").agg(F.sum("n").alias("all"))  # a row an interval and a row between
    before = F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = running.where("value is not null").join(F.broadcast(whole.select("part", before.alias("before"))), "part")
    first, last = F.col("before") + F.col("upto") - F.col("n"), F.col("before") + F.col("upto")
    asked = F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r >= first) & (r < last))
    return placed.select(F.explode(asked).alias("rank"), "value")


def quantiles(values: DataFrame, shares: list[float], accuracy: int = 10_000) -> list[float]:
    """Exact quantiles of the column ``x`` (finite numbers and nulls), each between two neighbouring values in proportion; no values, no quantiles.

    Two scans for any number of shares: a sketch brackets all wanted ranks, and the values inside the brackets, about 4 / accuracy of all for each, are counted and ranked. Should
    a rank ever lie outside its bracket, as the sketch's bound excludes, brackets are widened and counted once more.
    """
    inside, n = brackets(values, shares, accuracy)
    if not n:
        return []
    spots = [s * (n - 1) for s in shares]
    ranks = sorted({r for at in spots for r in (int(at), min(int(at) + 1, n - 1))})
    found = dict(ranked_values(values, inside, ranks).collect())  # a row a rank
    if len(found) < len(ranks):
        found = dict(ranked_values(values, [(-float("inf"), float("inf"))], ranks).collect())
    return [found[int(at)] + (found[min(int(at) + 1, n - 1)] - found[int(at)]) * (at - int(at)) for at in spots]


def clipped_histogram(df: DataFrame, column: str, bins: int, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Finite values beyond two exact quantiles are moved to them first."""
    x = number(F.col(column))
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    edges = quantiles(values, [low, high])
    if not edges:
        return histogram(values, "x", bins)
    return histogram(values.select(F.greatest(F.least("x", F.lit(edges[1])), F.lit(edges[0])).alias(column)), column, bins, *edges)


def alerts_per_object(df: DataFrame, obj: str) -> DataFrame:
    """``kind, alerts, objects``: how many objects have how many rows; id 0 stands apart."""
    sizes = df.where(F.col(obj).isNotNull()).groupBy(obj).agg(F.count("*").alias("alerts"))
    return sizes.groupBy(F.when(F.col(obj) == 0, "zero_id").otherwise("object").alias("kind"), "alerts").agg(F.count("*").alias("objects"))


def crosstab(df: DataFrame, row: str, column: str, columns: list[str], most: int = 12) -> DataFrame:
    """Counts of the commonest values of ``row`` by listed values of ``column``."""
    tops = value_counts(df, row, most).select(F.col("value").alias(row))
    counted = df.withColumn(row, F.col(row).cast("string")).join(F.broadcast(tops), row, "left_semi")  # at most `most` rows
    return counted.groupBy(row).pivot(column, columns).agg(F.count(F.lit(1))).fillna(0)


def date_distribution(df: DataFrame, year: str, month: str, day: str, mjd: str) -> DataFrame:
    """Rows by date from year, month and day, else from the time rounded to a day."""
    parts = F.try_make_timestamp(*(F.col(c).cast("int") for c in (year, month, day)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return rows_by(df, F.coalesce(parts, mjd_to_date(F.bround(F.col(mjd)))).alias("date"))


def drawn(key: str, seed: int) -> Column:
    """A repeatable place in an even order of rows, by a hash of key and seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sky_sample(df: DataFrame, ra: str, dec: str, key: str, most: int = 60_000, seed: int = 42, by: str | None = None) -> DataFrame:
    """A repeatable even choice of at most ``most`` rows with a position, or of as many for each value of ``by``, a null one included.

    Each task keeps the first rows of each group before anything is shuffled, so that a band with a third of all rows sends no more than others.
    """
    placed = df.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).select(key, ra, dec, *([by] if by else []))
    order = [drawn(key, seed), F.col(key)]
    if by is None:
        return placed.orderBy(*order).limit(most)
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return placed.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def ranked_files(df: DataFrame, path: Column) -> DataFrame:
    """Files by their rows, most first."""
    sizes = df.groupBy(path.alias("path")).agg(F.count("*").alias("rows"))
    return sizes.withColumn("rank", F.row_number().over(W.orderBy(F.desc("rows"), "path")))


def nightly_statistics(df: DataFrame, night: Column, band: str, bands: list[str], obj: str, tags: dict[str, Column]) -> DataFrame:
    """A row a night: alerts, objects, alerts by band, rows by tag. Conditional counts by night and object first, so that objects need no distinct count and no row is expanded."""
    counts = {**{f"band_{b}": F.col(band) == b for b in bands}, **{f"tag_{t}": c for t, c in tags.items()}}
    by_object = df.groupBy(night.alias("night"), F.col(obj).alias("_object")).agg(F.count("*").alias("alerts"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    return by_object.groupBy("night").agg(F.sum("alerts").alias("alerts"), F.count("_object").alias("objects"), *(F.sum(k).alias(k) for k in counts))


def fact(section: str, metric: Column | str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.cast("double").alias("value"))


def counted_values(df: DataFrame, section: str, column: str) -> DataFrame:
    return value_counts(df, column).select(F.lit(section).alias("section"), F.concat(F.lit(f"{column}="), "value").alias("metric"), F.col("n").cast("double").alias("value"))


def readiness_report(df: DataFrame, source: str, obj: str, numeric: list[str], counted: list[str], features: DataFrame | None = None, band: str = "feature_band") -> DataFrame:
    """``section, metric, value``: summary with unique ids, ranges, missingness, commonest values and, if it is given, the table of features in one table."""
    facts = [fact("summary", "rows", F.count("*")), fact("summary", "sources", F.count(source)), fact("summary", "objects", F.count(obj))]
    for c in numeric:
        x = number(F.col(c))
        facts += [fact("range", f"{c}_least", F.min(x)), fact("range", f"{c}_greatest", F.max(x)), fact("missing", c, F.count_if(x.isNull()))]
    unique = delivery_summary(df, source, obj)
    parts = [stacked(df, facts), unique.select(F.explode(F.array(*(fact("summary", c, F.col(c)) for c in ("unique_sources", "unique_objects")))).alias("f")).select("f.*")]
    parts += [counted_values(df, "values", c) for c in counted]
    if features is not None:
        names = [c for c in features.columns if c.startswith("feature_") and c != band]
        parts += [stacked(features, [fact("features", "rows", F.count("*")), fact("features", "columns", F.lit(len(names)))]), counted_values(features, "features", band)]
    return reduce(DataFrame.unionByName, parts)


def quick_report(df: DataFrame, source: str, obj: str, band: str, flux: str, error: str, ranged: list[str]) -> DataFrame:
    """``section, metric, value``: a first look at rows that may be a part of a delivery: sizes, bands, unique ids, ranges of time and sky, what is missing of
    every column, and what hints at variable objects: those with two alerts or more, the most alerts of one, alerts by band, amplitudes, and chi-square-like values.

    Nothing in it claims that an object varies. All counts of columns come from one scan, those of objects from one grouping (the chi-square-like value needs its mean first).
    """
    facts = [fact("rows", "rows", F.count("*")), fact("rows", "columns", F.lit(len(df.columns)))]
    for c in ranged:
        x = number(F.col(c))
        facts += [fact("range", f"{c}_numeric", F.count(x)), fact("range", f"{c}_least", F.min(x)), fact("range", f"{c}_greatest", F.max(x))]
    facts += [fact("missing", c, F.count_if(F.col(f"`{c}`").isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)))) for c in df.columns]
    x = number(F.col(flux))
    objects = df.where(F.col(obj).isNotNull()).groupBy(obj).agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("amplitude"))
    hooks = [
        fact("ids", "unique_objects", F.count("*")), fact("variability", "objects_with_two_or_more", F.count_if(F.col("n") >= 2)), fact("variability", "most_alerts", F.coalesce(F.max("n"), F.lit(0))),
        fact("variability", "amplitude_nonzero_objects", F.count_if(F.col("amplitude") > 0)), fact("variability", "amplitude_greatest", F.max("amplitude")),
    ]
    chi = chi_like(df, obj, flux, error)
    sources = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.lit(1))
    return reduce(DataFrame.unionByName, [
        stacked(df, facts), counted_values(df, "bands", band), stacked(objects, hooks), stacked(sources, [fact("ids", "unique_sources", F.count("*"))]),
        stacked(chi, [fact("variability", "chi_like_objects", F.count("*")), fact("variability", "chi_like_greatest", F.max("chi_like"))]),
    ])


def histograms(df: DataFrame, columns: dict[str, Column], bins: int) -> DataFrame:
    """``column, bin, n, left_edge`` of the finite numbers of several columns, each over its own range: two scans for all of them."""
    values = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), number(c).alias("x")) for n, c in columns.items()))).alias("v")).select("v.*")
    values = values.where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    ranges = values.groupBy("column").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    met = values.join(F.broadcast(ranges), "column")  # a row a column
    counted = met.groupBy("column", "low", "high", bin_of(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("column", "bin", "n", F.round(F.col("low") + (F.col("high") - F.col("low")) * F.col("bin") / bins, 6).alias("left_edge"))


def sampled(paths: DataFrame, how: str, most: int, seed: int = 0) -> DataFrame:
    """``path`` of at most ``most`` files: the first, evenly spaced ones, or a seeded choice. (Files are a small table.)"""
    ranked = paths.withColumn("i", F.row_number().over(W.orderBy("path")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    if how == "first":
        return ranked.where(F.col("i") < most).select("path")
    if how == "random":
        return paths.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(most).select("path")
    step = F.when(F.lit(most) > 1, (F.col("n") - 1) / F.lit(max(1, most - 1))).otherwise(0.0)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * step).cast("int"))
    return ranked.where((F.col("n") <= most) | F.array_contains(wanted, F.col("i"))).select("path")


def flatten(packets: DataFrame, keep: dict[str, list[str]], skip: tuple[str, ...] = ("cutout", "stamp", "image", "fits", "bytes", "binary")) -> tuple[DataFrame, list[str]]:
    """Flat columns and the wanted members of structs as ``struct_member``; heavy columns never reach the scan's schema. Also the skipped names."""
    out, skipped = [], []
    for f in packets.schema.fields:
        if any(m in f.name.lower() for m in skip) or isinstance(f.dataType, T.BinaryType):
            skipped.append(f.name)
        elif isinstance(f.dataType, T.StructType):
            members = keep.get(f.name, f.dataType.names)
            out += [F.col(f.name)[m].alias(f"{f.name}_{m}") for m in members if m in f.dataType.names]
        elif not isinstance(f.dataType, (T.MapType, T.ArrayType)):
            out.append(F.col(f.name))
        else:
            skipped.append(f.name)
    return packets.select(*out), skipped
