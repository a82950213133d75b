"""Incremental ingestion with Structured Streaming: each file once, restarts included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyledger.sources.audit import plain_path, visit


def file_stream(spark: SparkSession, root: str, schema: T.StructType, files_per_trigger: int = 5000) -> DataFrame:
    """New Parquet files below a root, with the file each row comes from; the schema is fixed, never inferred."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(root)
    return rows.select("*", F.col("_metadata.file_path").alias("_raw_file"))


def ingest_available(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, partition_by: str | None = None) -> StreamingQuery:
    """Write what has arrived and stop. The checkpoint makes a restart read no file twice."""
    writer = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


STATUS = "path string, length long, modified timestamp, run string, batch long, status string, rows long, errors array<string>, warnings array<string>"


def dropped(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_status(spark: SparkSession, out: str) -> DataFrame:
    """A row for each file and run (see ``STATUS``): ``completed``, ``failed`` or ``skipped_completed``."""
    folder = f"{out}/file_status"
    spark.createDataFrame([], STATUS).write.mode("ignore").parquet(f"{folder}/none")
    return spark.read.schema(STATUS).option("recursiveFileLookup", True).parquet(folder)


def judged(visits: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """Add ``errors, warnings``: what a footer alone tells against a file, and what it tells besides."""
    have = F.transform("fields", lambda x: x["name"])
    say = lambda text, names: F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(names, ", ")))
    missing = F.array_except(F.array(*map(F.lit, required)), have)
    absent = F.array_except(F.array(*map(F.lit, [n for n in schema.names if n not in required])).cast("array<string>"), have)
    extra = F.array_except(have, F.array(*map(F.lit, schema.names)))
    return visits.withColumns({
        "errors": F.array_compact(F.array(F.col("error"), say("missing columns: ", missing))),
        "warnings": F.array_compact(F.array(say("optional columns are null: ", absent), say("columns are not kept: ", extra))),
    })


def ingest_run(
    spark: SparkSession, root: str, out: str, schema: T.StructType, tables: Callable[[DataFrame], dict[str, DataFrame]], run: str, required: list[str] | None = None, files_per_batch: int = 5000
) -> StreamingQuery:
    """All files below ``root`` that no run has completed, into a table family, each file for itself: a broken one fails alone.

    The stream is one of files, whose contents it does not read, and a run has its own checkpoint: started again, it goes on after its last batch.
    A file fails if its footer can't be read, if it lacks a required column, or if not all of its rows can be read; then none of its rows go
    anywhere, and a later run tries it again. A file without a byte is not seen until it has some. Files that a run completed, and that have not changed since, are skipped by all later ones. A batch writes under its own
    name and its status last, so that a repeated batch changes nothing.
    """
    required = schema.names if required is None else required
    listing = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
    files = listing.option("maxFilesPerTrigger", files_per_batch).load(root).select("path", "length", F.col("modificationTime").alias("modified"))

    def write(batch: DataFrame, number: int) -> None:
        place, staging = f"{run}/{number:06d}", f"{out}/_staging/{run}-{number}"
        spark = batch.sparkSession
        done = file_status(spark, out).where((F.col("status") == "completed") & ~((F.col("run") == run) & (F.col("batch") == number)))
        listed = batch.join(done.select("path", "length", "modified").distinct().withColumn("_done", F.lit(True)), ["path", "length", "modified"], "left")
        listed.write.mode("overwrite").parquet(f"{staging}/files")
        listed = spark.read.parquet(f"{staging}/files")
        judged(visit(listed.where("_done is null"), digest=False, parquet=F.lit(True)), schema, required).write.mode("overwrite").parquet(f"{staging}/visits")
        visits = spark.read.parquet(f"{staging}/visits")
        paths = [r.path for r in visits.where("size(errors) = 0").select("path").collect()]  # files_per_batch at most
        reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        rows = reader.parquet(*paths).select("*", plain_path(F.col("_metadata.file_path")).alias("_raw_file")) if paths else spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_raw_file", T.StringType())]))
        rows.write.mode("overwrite").parquet(f"{staging}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
        counts = rows.groupBy(F.col("_raw_file").alias("path")).agg(F.count("*").alias("read"))
        told = visits.drop("error").join(counts, "path", "left").withColumn("read", F.coalesce("read", F.lit(0)))
        short = F.when((F.size("errors") == 0) & (F.col("read") != F.col("rows")), F.concat(F.lit("read "), "read", F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows")))
        told = told.withColumn("errors", F.array_compact(F.array_append("errors", short)))
        told.write.mode("overwrite").parquet(f"{staging}/told")
        told = spark.read.parquet(f"{staging}/told")
        bad = told.where("size(errors) > 0").select(F.col("path").alias("_raw_file"))
        for name, df in tables(rows.join(F.broadcast(bad), "_raw_file", "left_anti")).items():  # files_per_batch at most
            df.write.mode("overwrite").parquet(f"{out}/{name}/{place}")
        failed = F.size("errors") > 0
        kept = F.when(~failed, F.col("read"))
        now = told.select("path", "length", "modified", F.when(failed, "failed").otherwise("completed").alias("status"), kept.alias("rows"), "errors", "warnings")
        none = F.array().cast("array<string>")
        skipped = listed.where("_done").select("path", "length", "modified", F.lit("skipped_completed").alias("status"), F.lit(None).cast("long").alias("rows"), none.alias("errors"), none.alias("warnings"))
        whole = now.unionByName(skipped).withColumns({"run": F.lit(run), "batch": F.lit(number).cast("long")})
        whole.select(*T.StructType.fromDDL(STATUS).names).write.mode("overwrite").parquet(f"{out}/file_status/{place}")
        dropped(spark, staging)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoints/{run}").trigger(availableNow=True).start()


def unique_in_bound(stream: DataFrame, key: str, time: str, bound: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``bound`` of the first."""
    return stream.withWatermark(time, bound).dropDuplicatesWithinWatermark([key])


def nightly_band_counts(stream: DataFrame, time: str, band: str, lateness: str) -> DataFrame:
    """Rows by UTC day and band; a day's counts are final once the watermark has passed it."""
    days = stream.withWatermark(time, lateness).groupBy(F.window(time, "1 day"), band).agg(F.count("*").alias("alerts"))
    return days.select(F.col("window.start").cast("date").alias("night"), band, "alerts")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; only a local session may do with a temporary one."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skyledger-stream-")
        spark.sparkContext.setCheckpointDir(found)
    return found
