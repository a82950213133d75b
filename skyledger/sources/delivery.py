"""Deliveries: file discovery, footers, hashes, reconciliation and receipts, as jobs over the file list."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY_BYTES, SETTLED_SECONDS = 1024, 300


def empty_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, modified`` of the files without a byte, which Spark's readers pass over. Executors list the folders, a task each (see ``opened`` for the stores)."""

    def place(path: str):
        from pyarrow import fs

        return (fs.LocalFileSystem(), re.sub("^file:/+", "/", path), "file:") if path.startswith(("file:", "/")) else (*fs.FileSystem.from_uri(path), path.split("/", 3)[0] + "//")

    def look(deep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import fnmatch

            from pyarrow import fs

            for b in batches:
                for folder in b["path"]:
                    store, at, scheme = place(folder)
                    for x in store.get_file_info(fs.FileSelector(at, recursive=deep)):
                        folder_here = not deep and x.type == fs.FileType.Directory
                        if folder_here or (x.type == fs.FileType.File and not x.size and fnmatch.fnmatch(x.base_name, glob)):
                            yield pd.DataFrame([(scheme + x.path, None if folder_here else 0, x.mtime)], columns=["path", "length", "modified"]).astype({"length": "Int64"})

        return run

    schema = "path string, length long, modified timestamp"
    here = spark.createDataFrame([(root,)], "path string").mapInPandas(look(False), schema)
    folders = here.where("length is null").select("path")
    return here.where("length is not null").unionByName(folders.repartition(F.xxhash64("path")).mapInPandas(look(True), schema)).where(~F.col("path").endswith(".gitkeep"))


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, modified`` of all files below a root that hold anything; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(~F.col("path").endswith(".gitkeep"))


def file_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in {"parquet": "parquet", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "avro": "avro"}.items() for x in pair))
    return F.coalesce(F.element_at(known, suffix), F.lit("other"))


def size_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("length") <= TINY_BYTES).alias("tiny"), F.min("length").alias("smallest"), F.max("length").alias("largest"))


def extremes(files: DataFrame, most: int = 20, largest: bool = True) -> DataFrame:
    return files.orderBy(F.desc("length") if largest else F.asc("length"), "path").limit(most)


def aged(files: DataFrame, as_of: str | None) -> DataFrame:
    """Add ``age`` in seconds at ``as_of``, or else at the time of the newest file."""
    if as_of is not None:
        return files.withColumn("age", F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("modified"))
    newest = files.agg(F.max("modified").alias("_newest"))  # one row
    return files.crossJoin(F.broadcast(newest)).withColumn("age", F.unix_timestamp("_newest") - F.unix_timestamp("modified")).drop("_newest")


def partial_files(files: DataFrame, as_of: str | None = None, tiny: int = TINY_BYTES) -> DataFrame:
    """Files that may still be written: tiny, or modified less than ``SETTLED_SECONDS`` before ``as_of`` (or the newest file)."""
    return aged(files, as_of).where((F.col("length") <= tiny) | (F.col("age") < SETTLED_SECONDS)).drop("age")


def activity(files: DataFrame, as_of: str | None = None, minutes: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    return aged(files, as_of).agg(*(F.count_if(F.col("age") <= 60 * m).alias(f"last_{m}_min") for m in minutes), F.max_by("path", F.struct("modified", "path")).alias("newest"), F.min_by("path", F.struct("modified", "path")).alias("oldest"))


def opened(path: str):
    """A file that executors read by ranges, in any store that Arrow knows (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def footers(files: DataFrame) -> DataFrame:
    """``path, readable, rows, row_groups, columns, nested, binary, schema_hash, names``, read on the executors.

    Only each file's footer is read, whatever its size; the paths never pass through the driver. A broken file is a row, not an error.
    """
    schema = "path string, readable boolean, rows long, row_groups long, columns long, nested boolean, binary boolean, schema_hash string, names array<string>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for path in b["path"]:
                try:
                    with opened(path) as source:
                        f = pq.ParquetFile(source)
                        s = f.schema_arrow
                        text = "\n".join(f"{x.name}:{x.type}" for x in s)
                        nested = any(pa.types.is_nested(x.type) for x in s)
                        binary = any(pa.types.is_binary(x.type) for x in s)
                        out.append((path, True, f.metadata.num_rows, f.metadata.num_row_groups, len(s), nested, binary, hashlib.sha256(text.encode()).hexdigest()[:16], s.names))
                except (pa.ArrowException, OSError):
                    out.append((path, False, 0, 0, 0, False, False, None, None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return files.select("path").mapInPandas(read, schema)


def readability(metadata: DataFrame) -> DataFrame:
    return metadata.agg(F.count("*").alias("files"), F.count_if("readable").alias("readable"), F.count_if(~F.col("readable")).alias("unreadable"), F.sum("rows").alias("rows"), F.countDistinct("schema_hash").alias("schema_groups"))


def schema_groups(metadata: DataFrame) -> DataFrame:
    return metadata.where("readable").groupBy("schema_hash").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.first("columns").alias("columns"), F.min("path").alias("example"))


def hash_inventory(files: DataFrame, block: int = 8 << 20) -> DataFrame:
    """``path, length, sha256`` of each file, hashed on the executors by blocks, so that no file is held whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests = []
            for path in b["path"]:
                digest = hashlib.sha256()
                with opened(path) as source:
                    while part := source.read(block):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield b.assign(sha256=digests)

    return files.select("path", "length").mapInPandas(read, "path string, length long, sha256 string")


def shard_digests(inventory: DataFrame) -> DataFrame:
    """A digest for each of at most 256 shards of paths; a changed file changes just one of them."""
    line = F.concat_ws(" ", "path", "length", "sha256")
    shard = F.substring(F.sha2("path", 256), 1, 2)
    return inventory.groupBy(shard.alias("shard")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def root_digest(shards: DataFrame) -> DataFrame:
    return shards.agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "shard", "digest"))), "\n"), 256).alias("root"))


def stat_fingerprint(files: DataFrame) -> DataFrame:
    """Of names, sizes and modification times (Spark shows no change time)."""
    shards = files.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("shard")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "length", F.unix_micros("modified")))), "\n"), 256).alias("d"))
    return shards.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "shard", "d"))), "\n"), 256).alias("fingerprint"))


def load_files(spark: SparkSession, root: str, formats: tuple[str, ...] = ("parquet", "json", "csv")) -> DataFrame:
    """All readable files below a root as one table, with ``_raw_file`` and ``_raw_file_index`` (by path)."""
    from functools import reduce

    frames = []
    for kind in formats:
        for suffix in {"json": ("json", "jsonl")}.get(kind, (kind,)):
            reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")
            reader = reader.option("header", True) if kind == "csv" else reader
            if not discover(spark, root, f"*.{suffix}").isEmpty():
                df = reader.format(kind).load(root)
                frames.append(df.select("*", F.col("_metadata.file_path").alias("_raw_file")))
    if not frames:
        raise FileNotFoundError(f"no readable files below {root}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    index = whole.select("_raw_file").distinct().withColumn("_raw_file_index", F.row_number().over(W.orderBy("_raw_file")) - 1)  # a row a file
    return whole.join(index, "_raw_file")


def reconcile(deliveries: DataFrame) -> DataFrame:
    """``passed``: expected, committed and local rows are equal and above 0, and nothing lags."""
    c = F.col
    same = (c("expected") == c("committed")) & (c("expected") == c("local_rows")) & (c("lag") == 0) & (c("expected") > 0)
    return deliveries.withColumn("passed", F.coalesce(same, F.lit(False)))


def expected_messages(watermarks: DataFrame) -> DataFrame:
    """Sum of high - low over a topic's partitions, with what is wrong with them."""
    bad = F.col("low").isNull() | F.col("high").isNull() | (F.col("low") < 0) | (F.col("high") < F.col("low"))
    sizes = watermarks.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.sum(F.col("high") - F.col("low")).alias("messages"), F.count_if(bad).alias("bad"))
    return sizes.groupBy("topic").agg(F.sum("messages").alias("expected"), F.sum("bad").alias("invalid"), F.count_if(F.col("n") > 1).alias("repeated_partitions"))


def receipt(metadata: DataFrame, sizes: DataFrame, root: DataFrame) -> DataFrame:
    """One row a delivery: files, bytes, readable rows, schema groups and the root digest (three one-row tables)."""
    return readability(metadata).join(sizes.select("bytes")).join(root.select("root"))


def newest_directory(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("path", "/[^/]+$", "")
    return files.agg(F.max_by(folder, F.struct("modified", "path")).alias("directory"))


def by_dropzone(files: DataFrame, root: str) -> DataFrame:
    """Files, bytes and types by the first folder below a root."""
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    zone = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(F.lit("."))
    return files.groupBy(zone.alias("zone")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(file_type(F.col("path")) == "parquet").alias("parquet_files"))


def heavy_fields(df: DataFrame, marks: str = "cutout|stamp|image|fits|bytes|binary") -> DataFrame:
    """``path, type`` of fields that are large by name or type."""
    from skyledger.operators.characterize import schema_inventory

    return schema_inventory(df).where(F.lower("path").rlike(marks) | (F.col("type") == "binary")).select("path", "type")


def null_fractions(df: DataFrame, most: int | None = None) -> DataFrame:
    """``column, missing, fraction`` of all columns, or of the first ``most``."""
    from skyledger.operators.explore import missingness

    return missingness(df, df.columns[:most])
