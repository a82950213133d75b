"""UTC days and TAI times: exact edges with leap seconds, and the approximate MJD night."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MJD_EPOCH = date(1858, 11, 17)
#: Fixed values, published by the IERS: from the first of (year, month) on, TAI - UTC in whole seconds.
LEAPS = [
    (1972, 1, 10), (1972, 7, 11), (1973, 1, 12), (1974, 1, 13), (1975, 1, 14), (1976, 1, 15), (1977, 1, 16), (1978, 1, 17), (1979, 1, 18), (1980, 1, 19),
    (1981, 7, 20), (1982, 7, 21), (1983, 7, 22), (1985, 7, 23), (1988, 1, 24), (1990, 1, 25), (1991, 1, 26), (1992, 7, 27), (1993, 7, 28), (1994, 7, 29),
    (1996, 1, 30), (1997, 7, 31), (1999, 1, 32), (2006, 1, 33), (2009, 1, 34), (2012, 7, 35), (2015, 7, 36), (2017, 1, 37),
]
LEAP_DAYS = [((date(y, m, 1) - MJD_EPOCH).days, s) for y, m, s in LEAPS]


def mjd_of(day: date) -> int:
    return (day - MJD_EPOCH).days


def offset_on(day: int) -> int:
    """TAI - UTC on a UTC day, given as MJD; before 1972: that of 1972."""
    return next((s for d, s in reversed(LEAP_DAYS) if day >= d), LEAP_DAYS[0][1])


def utc_to_tai(text: str) -> float:
    """TAI MJD of an ISO instant in UTC. A 60th second is read where a leap second ends the day;
    instants with an offset are refused."""
    plain = text.strip().removesuffix("Z")
    day_text, _, clock = plain.partition("T")
    if "+" in clock or "-" in clock:
        raise ValueError(f"{text}: give UTC, without an offset")
    day = mjd_of(date.fromisoformat(day_text))
    hours, minutes, seconds = (clock.split(":") + ["0", "0", "0"])[:3] if clock else ("0", "0", "0")
    second = float(seconds or 0)
    if second >= 60 and not (second < 61 and hours == "23" and minutes == "59" and offset_on(day + 1) > offset_on(day)):
        raise ValueError(f"{text}: no leap second there")
    return day + (int(hours) * 3600 + int(minutes) * 60 + second + offset_on(day)) / 86400


def window_bounds(start: str, stop: str) -> tuple[float, float]:
    """TAI MJD bounds of a half-open UTC window."""
    low, high = utc_to_tai(start), utc_to_tai(stop)
    if not low < high:
        raise ValueError(f"{start} is not before {stop}")
    return low, high


def offset_column(day: Column, table: list[tuple[int, int]] = LEAP_DAYS) -> Column:
    """TAI - UTC on a UTC day: halves of the table in nested conditions, so that a row meets five comparisons and not one for each leap."""
    if len(table) == 1:
        return F.lit(table[0][1])
    half = len(table) // 2
    return F.when(day >= table[half][0], offset_column(day, table[half:])).otherwise(offset_column(day, table[:half]))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def utc_date(mjd_tai: Column) -> Column:
    """The UTC date of a TAI MJD: TAI runs ahead by less than a day, so it is the TAI day or the one before."""
    d0 = F.floor(mjd_tai)
    day = F.when(mjd_tai < d0 + offset_column(d0) / F.lit(86400.0), d0 - 1).otherwise(d0)
    return F.when(is_finite(mjd_tai), F.date_add(F.lit(MJD_EPOCH), day.cast("int")))


def approximate_night(*columns: Column) -> Column:
    """The night of the first usable MJD, read as if it were UTC."""
    nights = [F.when(is_finite(c), F.date_add(F.lit(MJD_EPOCH), F.floor(c).cast("int"))) for c in (x.cast("string").try_cast("double") for x in columns)]
    return F.coalesce(*nights)


def date_to_mjd(day: Column) -> Column:
    return F.datediff(day, F.lit(MJD_EPOCH)).cast("long")


def mjd_to_date(mjd: Column) -> Column:
    return F.date_add(F.lit(MJD_EPOCH), mjd.cast("int"))


def calendar(spark: SparkSession, start: str, stop: str) -> DataFrame:
    """``utc_date, tai_start, tai_stop`` of each day in [start, stop)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(stop).cast("date"), 1))).alias("utc_date"))
    edge = lambda d: date_to_mjd(d) + offset_column(date_to_mjd(d)) / F.lit(86400.0)
    return days.select("utc_date", edge(F.col("utc_date")).alias("tai_start"), edge(F.date_add("utc_date", 1)).alias("tai_stop"))


def split_window(start: str, stop: str, parts: int) -> list[tuple[str, str]]:
    """Equal half-open parts of a UTC window, as ISO instants."""
    low, high = datetime.fromisoformat(start), datetime.fromisoformat(stop)
    if parts < 1 or not low < high:
        raise ValueError("a window needs a start before its stop, and one part at least")
    edges = [low + (high - low) * k / parts for k in range(parts)] + [high]
    return [(a.isoformat(), b.isoformat()) for a, b in zip(edges, edges[1:], strict=False)]


def time_bucket(mjd: Column, low: float, high: float, parts: int) -> Column:
    """The part of [low, high) in which a time lies; null outside."""
    inside = (mjd >= low) & (mjd < high)
    return F.when(inside, F.least(F.floor((mjd - low) / F.lit((high - low) / parts)), F.lit(parts - 1)).cast("int"))


def parse_date(text: Column, earliest: str) -> Column:
    """``struct(day, usable)`` of a date text: usable if it is a date, and not before the earliest one."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.struct(day.alias("day"), F.coalesce(day >= F.lit(earliest).cast("date"), F.lit(False)).alias("usable"))


def rows_in_window(df: DataFrame, columns: list[str], start: str, stop: str) -> DataFrame:
    """One row a time column: rows with a time, inside the approximate window, all of them inside, least and greatest."""
    low, high = float(mjd_of(date.fromisoformat(start))), float(mjd_of(date.fromisoformat(stop)))
    t = {c: F.col(c).cast("string").try_cast("double") for c in columns}
    usable = {c: F.when(is_finite(x), x) for c, x in t.items()}
    facts = F.array(*(
        F.struct(
            F.lit(c).alias("column"), F.count(x).alias("rows"), F.count_if((x >= low) & (x < high)).alias("inside"),
            F.coalesce(F.bool_and((x >= low) & (x < high)), F.lit(True)).alias("all_inside"), F.min(x).alias("least"), F.max(x).alias("greatest"),
        )
        for c, x in usable.items()
    ))
    return df.agg(facts.alias("facts")).select(F.explode("facts").alias("f")).select("f.*")


def previous_day(day: str) -> str:
    return (date.fromisoformat(day) - timedelta(days=1)).isoformat()
