"""Event rows as alert packets, and the acquisitions they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, first day, day after the last (UTC)
ACQUISITIONS = [("a1", "2024-01-01", "2024-01-16"), ("a2", "2024-01-16", "2024-02-03")]
BANDS = {"view": "g", "click": "r", "purchase": "i", "signup": "z", "error": "y"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(events: DataFrame) -> DataFrame:
    """Light packets: flat ids, coordinates and flux, with nested broker snapshots. Fixed formulas."""
    e, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    band = F.element_at(F.create_map(*(F.lit(x) for pair in BANDS.items() for x in pair)), F.col("event_type"))
    score = F.when(k % 25 == 0, F.lit(float("nan"))).otherwise(k / F.lit(100.0))
    features = F.when(k % 10 != 0, F.create_map(band, F.struct(F.col("value").alias("mean"), k.alias("n"))))
    return events.select(
        (e + 1).alias("diaSourceId"),
        F.when(user % 7 == 0, F.lit(0)).when(user % 11 != 0, user).cast("long").alias("diaObjectId"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) + 37000000) / F.lit(86400000000.0) + 40587).alias("midpointMjdTai"),
        F.struct((e % 5 == 0).alias("is_sso")).alias("pred"),
        ((e * 7919) % 360000 / F.lit(1000.0)).alias("ra"),
        ((e * 104729) % 180001 / F.lit(1000.0) - 90).alias("dec"),
        band.alias("band"),
        F.col("value").alias("psfFlux"),
        (1 + (e % 10) / F.lit(10.0)).alias("psfFluxErr"),
        F.struct((11 + k % 3).alias("cats_class"), score.alias("cats_score")).alias("clf"),
        features.alias("lc_features"),
    )


def acquisition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACQUISITIONS, "acquisition_id string, start string, stop string").select(
        "acquisition_id", F.col("start").cast("date").alias("start"), F.col("stop").cast("date").alias("stop")
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(table(spark, sf_dir, "events"))


def deliveries(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The packets of each acquisition, cut at its first day."""
    events, split = table(spark, sf_dir, "events"), F.lit(ACQUISITIONS[1][1]).cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    return [("a1", alerts(events.where(ts < split))), ("a2", alerts(events.where(ts >= split)))]
