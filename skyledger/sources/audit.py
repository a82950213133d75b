"""One visit to each file of a delivery: stat, digest and footer facts together, from which all audits follow without a second look.

``visit`` opens every file once, on the executors, and gives one row a file. Write its result (it is small: facts, not contents) and aggregate
it in as many ways as needed. A file that can't be read is a row with its error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.sources.delivery import SETTLED_SECONDS, TINY_BYTES, file_type, opened

FIELD = "struct<name:string,type:string,nullable:boolean,nested:boolean,nulls:bigint>"
VISIT = f"path string, length long, modified timestamp, sha256 string, readable boolean, error string, rows long, row_groups long, schema_hash string, fields array<{FIELD}>"


def footer_facts(source) -> tuple:
    """``rows, row_groups, schema_hash, fields`` of an open Parquet file; nulls come from statistics, where all row groups have them."""
    import pyarrow.parquet as pq

    file = pq.ParquetFile(source)
    meta, schema = file.metadata, file.schema_arrow
    nulls: dict[str, int | None] = {}
    filled = [meta.row_group(g) for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
    for k in range(meta.num_columns):
        counts = [s.null_count if (s := g.column(k).statistics) is not None and s.has_null_count else None for g in filled]
        nulls[meta.schema.column(k).path] = None if None in counts else sum(counts)
    fields = [{"name": x.name, "type": str(x.type), "nullable": x.nullable, "nested": pa.types.is_nested(x.type), "nulls": nulls.get(x.name)} for x in schema]
    text = "\n".join(f"{x.name}:{x.type}" for x in schema)
    return meta.num_rows, meta.num_row_groups, hashlib.sha256(text.encode()).hexdigest()[:16], fields


def visit_file(path: str, parquet: bool, open_: Callable = opened, block: int = 8 << 20, digest: bool = True) -> dict:
    """What one look at a file gives. It is opened once: the digest, if it is wanted, goes over it by blocks, the footer by ranges."""
    found = {"sha256": None, "readable": False, "error": None, "rows": None, "row_groups": None, "schema_hash": None, "fields": None}
    try:
        with open_(path) as source:
            if digest:
                whole = hashlib.sha256()
                while part := source.read(block):
                    whole.update(part)
                found["sha256"] = whole.hexdigest()
            if parquet:
                source.seek(0)
                found["rows"], found["row_groups"], found["schema_hash"], found["fields"] = footer_facts(source)
            found["readable"] = True
    except (pa.ArrowException, OSError, ValueError) as problem:
        found["error"] = f"{type(problem).__name__}: {problem}"[:500]
    return found


def visit(files: DataFrame, digest: bool = True, parquet: Column | None = None) -> DataFrame:
    """A row a file (see ``VISIT``) of ``path, length, modified``. Files are dealt out evenly, so that a folder of many small ones is no long task.

    digest: whether contents are read and not footers alone. parquet: which files must be Parquet (those with its suffix).
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            facts = pd.DataFrame([visit_file(p, q, digest=digest) for p, q in zip(b["path"], b["parquet"], strict=True)], index=b.index, dtype=object)
            out = pd.concat([b[["path", "length", "modified"]], facts], axis=1)
            yield out.astype({"rows": "Int64", "row_groups": "Int64"})

    listed = files.select("path", "length", "modified", (file_type(F.col("path")) == "parquet" if parquet is None else parquet).alias("parquet"))
    return listed.repartition(F.xxhash64("path")).mapInPandas(look, VISIT)


def delivery_facts(visits: DataFrame) -> DataFrame:
    """One row: files, bytes, tiny files, readable and unreadable ones, rows, schema groups and the root digest of all contents.

    The digest is of at most 256 shards of paths, each of which is digested by itself, so that a changed file changes its shard's digest and the root's alone.
    """
    parquet = file_type(F.col("path")) == "parquet"
    line = F.concat_ws(" ", "path", "length", F.coalesce("sha256", F.lit("-")))
    shards = visits.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("shard")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("length") <= TINY_BYTES).alias("tiny"), F.count_if("readable").alias("readable"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.collect_set(F.when(parquet, F.col("schema_hash"))).alias("schemas"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"),
    )
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return shards.agg(
        add("files").alias("files"), add("bytes").alias("bytes"), add("tiny").alias("tiny"), add("readable").alias("readable"), (add("files") - add("readable")).alias("unreadable"),
        add("rows").alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_list("schemas")))).cast("long").alias("schema_groups"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "shard", "digest"))), "\n"), 256).alias("root"),
    )


def schema_groups(visits: DataFrame) -> DataFrame:
    """``schema_hash, files, rows, columns, nested_columns, example`` of readable Parquet files."""
    known = visits.where("readable and schema_hash is not null")
    names = F.array_sort(F.transform(F.filter("fields", lambda x: x["nested"]), lambda x: x["name"]))
    return known.groupBy("schema_hash").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.size(F.first("fields")).alias("columns"), F.first(F.array_join(names, ",")).alias("nested_columns"), F.min("path").alias("example"),
    )


def column_union(visits: DataFrame) -> DataFrame:
    """``column, types, files, missing_files, nested, conflict, nulls, null_fraction``: the columns of all Parquet footers as one list.

    conflict: files give the column different types. nulls and null_fraction are null where some file has no statistics of it (as for nested columns).
    Files are counted by type in the task before anything is shuffled.
    """
    known = visits.where("readable and fields is not null")
    x = known.select("rows", F.explode("fields").alias("f"))
    typed = x.groupBy(F.col("f.name").alias("column"), F.col("f.type").alias("type")).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("f.nested").alias("nested"), F.sum("f.nulls").alias("nulls"), F.count("f.nulls").alias("told"),
    )
    total = known.agg(F.count("*").alias("all_files"))  # one row
    whole = typed.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("type")), " | ").alias("types"), F.sum("files").alias("files"), F.max("nested").alias("nested"), (F.count("*") > 1).alias("conflict"),
        F.when(F.sum("told") == F.sum("files"), F.sum("nulls")).alias("nulls"), F.sum("rows").alias("rows"),
    )
    share = F.round(F.col("nulls") / F.nullif(F.col("rows"), F.lit(0)), 9)
    return whole.crossJoin(F.broadcast(total)).select("column", "types", "files", (F.col("all_files") - F.col("files")).alias("missing_files"), "nested", "conflict", "nulls", share.alias("null_fraction"))


def type_conflicts(visits: DataFrame) -> DataFrame:
    """``column, type, files, example`` of each type of the columns whose type files disagree on."""
    x = visits.where("readable").select("path", F.explode("fields").alias("f"))
    typed = x.groupBy(F.col("f.name").alias("column"), F.col("f.type").alias("type")).agg(F.count("*").alias("files"), F.min("path").alias("example"))
    torn = typed.groupBy("column").agg(F.count("*").alias("n")).where("n > 1").select("column")
    return typed.join(torn, "column", "left_semi")


def field_inventory(visits: DataFrame, marks: str = "cutout|stamp|fits|image|bytes|binary") -> DataFrame:
    """``column, types, files, heavy, binary, nested`` of all Parquet footers: what is heavy by its name, and what is bytes or nested by its type in some file."""
    is_binary = F.lower("types").rlike("binary|bytes")
    return column_union(visits).select("column", "types", "files", F.lower("column").rlike(marks).alias("heavy"), is_binary.alias("binary"), "nested")


def delivery_audits(visits: DataFrame, expected: DataFrame, root: str, as_of: str, free_gb: float) -> DataFrame:
    """The state of each delivery, a folder below ``root``, for ``operators.runs.raw_readiness``: its files, rows and times of one visit.

    expected: ``delivery, expected_total, progress`` (both may be null). Deliveries that are expected and have no file are there as well, not present. active: some
    file was modified less than ``SETTLED_SECONDS`` before ``as_of``. free_gb: what is free on the disk that takes the deliveries.
    """
    below = F.substring_index(plain_path(F.col("path")), root.rstrip("/") + "/", -1)
    parquet = file_type(F.col("path")) == "parquet"
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("modified")
    seen = visits.groupBy(F.substring_index(below, "/", 1).alias("delivery")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(parquet).alias("parquet_files"), F.count_if(parquet & ~F.col("readable")).alias("unreadable"),
        (F.min(age) < SETTLED_SECONDS).alias("active"), F.count_if(F.col("length") <= TINY_BYTES).alias("tiny"), F.coalesce(F.sum("rows"), F.lit(0)).alias("readable_rows"),
        F.max_by("path", F.struct("modified", "path")).alias("newest"), F.min_by("path", F.struct("modified", "path")).alias("oldest"),
    )
    met = expected.join(seen, "delivery", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(
        "delivery", F.col("files").isNotNull().alias("present"), zero("files"), zero("bytes"), zero("parquet_files"), zero("unreadable"), F.coalesce("active", F.lit(False)).alias("active"), zero("tiny"),
        zero("readable_rows"), "expected_total", "progress", F.lit(free_gb).alias("free_gb"), "newest", "oldest",
    )


def json_shapes(spark: SparkSession, root: str) -> DataFrame:
    """``path, shape, rows, columns`` of the JSON files below a root: ``list``, ``dict``, another kind, ``jsonl``, or ``invalid``.

    columns: the names in a document, or in the first row of a list or of lines, sorted. A document is parsed whole, as any parser must;
    a file of lines is read by lines, and no task holds more than one of them.
    """
    whole = lambda v, kind: F.try_variant_get(v, "$", kind)
    keys = lambda v: F.array_join(F.array_sort(F.map_keys(whole(v, "map<string,variant>"))), ",")
    reader = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    path, v = F.col("_metadata.file_path").alias("path"), F.col("v")
    docs = reader("*.json").text(root, wholetext=True).select(path, F.try_parse_json("value").alias("v"))
    items = whole(v, "array<variant>")
    kind = F.when(v.isNull(), "invalid").when(items.isNotNull(), "list").when(whole(v, "map<string,variant>").isNotNull(), "dict")
    of_docs = docs.select(
        "path", F.coalesce(kind, F.lower(F.schema_of_variant(v))).alias("shape"), F.when(v.isNull(), 0).otherwise(F.coalesce(F.size(items), F.lit(1))).cast("long").alias("rows"),
        F.when(items.isNotNull(), keys(F.get(items, 0))).otherwise(keys(v)).alias("columns"),
    )
    lines = reader("*.{jsonl,ndjson}").text(root).select(path, F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")
    first = lines.groupBy("path").agg(F.count("*").alias("rows"), F.min_by("value", F.struct("at", "line")).alias("value"))
    return of_docs.unionByName(first.select("path", F.lit("jsonl").alias("shape"), "rows", keys(F.try_parse_json("value")).alias("columns")))


def pinned(spark: SparkSession, visits: DataFrame, refuse: Callable[[T.StructType], list[str]], project: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Just the files that were visited, by schema group: a scan of those whose schema is admitted, and ``schema_hash, files, rows, admitted, errors`` of all groups.

    Each admitted group is one branch with its own fixed schema, read from its pinned list of files and nothing else (folders named like partitions
    add no columns), with ``_file`` beside the columns of ``project``; branches are joined by column name, so a filter or column list reaches every
    scan. refuse: why a schema is not admitted (no reasons: it is). There are few groups; the list of files is what any file scan keeps on the driver.
    """
    groups = schema_groups(visits).select("schema_hash", "files", "rows", "example").orderBy("schema_hash").collect()
    branches, told = [], []
    for g in groups:
        schema = spark.read.option("recursiveFileLookup", True).parquet(g.example).schema
        errors = refuse(schema)
        told.append((g.schema_hash, g.files, g.rows, not errors, "; ".join(errors)))
        if not errors:
            paths = [r.path for r in visits.where(F.col("schema_hash") == g.schema_hash).select("path").orderBy("path").toLocalIterator()]
            rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
            name = F.col("_metadata.file_name").alias("_file")
            branches.append(project(rows.select("*", name)))
    report = spark.createDataFrame(told, "schema_hash string, files long, rows long, admitted boolean, errors string")
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches) if branches else None), report


def plain_path(path: Column) -> Column:
    """Paths of the file scheme with one slash, as the listing has them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def plain(path: str) -> str:
    """The same for one path, without its scheme."""
    return re.sub("^file:/+", "/", path)
