"""Queries of delivery audit and incremental ingestion."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.operators import catalog as C
from skyledger.operators import runs as R
from skyledger.operators.explore import sampled
from skyledger.operators.ingest import table_family
from skyledger.operators.sinks import write_nights
from skyledger.plans.registry import query
from skyledger.plans.sql import over_packets
from skyledger.sources import audit as A
from skyledger.sources import delivery as D
from skyledger.sources.adapters import alerts, table
from skyledger.sources.chain import broken_entries


def files(spark, sf_dir):
    return D.discover(spark, sf_dir, "*.parquet")


def named(df):
    """Paths differ by machine; names do not."""
    return df.withColumn("name", F.substring_index(F.regexp_replace("path", "\\.parquet/.*$", ".parquet"), "/", -1))


#: The files themselves, where DuckDB sees them: the folder of the scale at which results are compared.
AT = "/root/testdata/sf0.01"
BLOBS = f"""
WITH b AS (SELECT filename AS path, parse_filename(filename) AS name, size AS length, sha256(content) AS sha256, last_modified, 'file:' || filename AS uri FROM read_blob('{AT}/*.parquet')),
m AS (SELECT file_name AS path, num_rows AS rows, num_row_groups AS row_groups FROM parquet_file_metadata('{AT}/*.parquet')),
c AS (SELECT file_name AS path, name, type FROM parquet_schema('{AT}/*.parquet') WHERE name NOT IN ('schema', 'list', 'element'))
"""


def visits(spark, sf_dir):
    """The visit of all files, written once: every audit reads this."""
    at = f"{scratch(spark)}/visits"
    A.visit(files(spark, sf_dir)).write.parquet(at)
    return spark.read.parquet(at)


@query("file_types", BLOBS + "SELECT 'parquet' AS type, count(*) AS files FROM b")
def file_types(spark, sf_dir):
    return files(spark, sf_dir).groupBy(D.file_type(F.col("path")).alias("type")).agg(F.count("*").alias("files"))


@query("file_sizes", BLOBS + "SELECT count(*) AS files, sum(length)::BIGINT AS bytes, count(*) FILTER (length <= 1024) AS tiny, min(length) AS smallest, max(length) AS largest FROM b")
def file_sizes(spark, sf_dir):
    return D.size_summary(files(spark, sf_dir))


@query("largest_files", BLOBS + "SELECT name, length FROM b ORDER BY length DESC, path LIMIT 20")
def largest_files(spark, sf_dir):
    return named(D.extremes(files(spark, sf_dir))).select("name", "length")


@query("partial_files", BLOBS + "SELECT name, length FROM b WHERE length <= 30000")
def partial_files(spark, sf_dir):
    """At a time when all are settled: those below a size that a part of the tables is below."""
    return named(D.partial_files(files(spark, sf_dir), "2100-01-01 00:00:00", tiny=30_000)).select("name", "length")


@query("download_activity", BLOBS + ", a AS (SELECT (SELECT max(floor(epoch(last_modified))) FROM b) - floor(epoch(last_modified)) AS age FROM b) SELECT count(*) FILTER (age <= 0) AS last_0_min, count(*) FILTER (age <= 60) AS last_1_min, count(*) FILTER (age <= 300) AS last_5_min FROM a")
def download_activity(spark, sf_dir):
    return D.activity(files(spark, sf_dir), minutes=(0, 1, 5)).drop("newest", "oldest")


@query("file_audit", BLOBS + "SELECT name, length, sha256, rows, row_groups, (SELECT count(*) FROM c WHERE c.path = b.path) AS columns FROM b JOIN m USING (path)")
def file_audit(spark, sf_dir):
    """What one visit tells of each file."""
    return named(visits(spark, sf_dir)).select("name", "length", "sha256", "rows", "row_groups", F.size("fields").cast("long").alias("columns"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("footer_rows", "\nUNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def footer_rows(spark, sf_dir):
    return named(D.footers(files(spark, sf_dir))).groupBy("name").agg(F.sum("rows").alias("rows"))


@query("readability_audit", BLOBS + "SELECT count(*) AS files, count(*) AS readable, 0::BIGINT AS unreadable, sum(rows)::BIGINT AS rows, (SELECT count(DISTINCT s) FROM (SELECT path, list(name || type ORDER BY name) AS s FROM c GROUP BY 1)) AS schema_groups FROM m")
def readability_audit(spark, sf_dir):
    return D.readability(D.footers(files(spark, sf_dir)))


@query("schema_groups", BLOBS + ", g AS (SELECT path, list(name || type ORDER BY name) AS s, count(*)::INT AS columns, coalesce(max(CASE WHEN type IS NULL THEN name END), '') AS nested_columns FROM c GROUP BY 1) SELECT count(*) AS files, sum(rows)::BIGINT AS rows, any_value(columns) AS columns, any_value(nested_columns) AS nested_columns FROM g JOIN m USING (path) GROUP BY s")
def schema_groups(spark, sf_dir):
    return A.schema_groups(visits(spark, sf_dir)).drop("example", "schema_hash")


@query("column_union", BLOBS + f"""
, k AS (SELECT path_in_schema AS name, sum(stats_null_count)::BIGINT AS nulls, sum(num_values)::BIGINT AS n FROM parquet_metadata('{AT}/*.parquet') GROUP BY 1)
SELECT c.name AS "column", count(*) AS files, (SELECT count(*) FROM m) - count(*) AS missing_files, bool_or(type IS NULL) AS nested, count(DISTINCT type) > 1 AS conflict, any_value(nulls) AS nulls, round(any_value(nulls / n), 9) AS null_fraction FROM c LEFT JOIN k USING (name) GROUP BY 1""")
def column_union(spark, sf_dir):
    """All columns of all footers, with the nulls that their statistics tell."""
    return A.column_union(visits(spark, sf_dir)).drop("types")


@query("hash_inventory", BLOBS + "SELECT name, length, sha256 FROM b")
def hash_inventory(spark, sf_dir):
    return named(D.hash_inventory(files(spark, sf_dir))).select("name", "length", "sha256")


@query("delivery_receipt", BLOBS + """
, s AS (SELECT sha256(uri)[1:2] AS shard, sha256(string_agg(concat_ws(' ', uri, length, sha256), chr(10) ORDER BY concat_ws(' ', uri, length, sha256))) AS digest FROM b GROUP BY 1)
SELECT count(*) AS files, sum(length)::BIGINT AS bytes, count(*) FILTER (length <= 1024) AS tiny, count(*) AS readable, 0::BIGINT AS unreadable, sum(rows)::BIGINT AS rows,
  (SELECT count(DISTINCT g) FROM (SELECT list(name || type ORDER BY name) AS g FROM c GROUP BY path)) AS schema_groups, (SELECT sha256(string_agg(shard || ' ' || digest, chr(10) ORDER BY shard)) FROM s) AS root FROM b JOIN m USING (path)""")
def delivery_receipt(spark, sf_dir):
    """The receipt of a delivery from one visit to each file."""
    return A.delivery_facts(visits(spark, sf_dir))


def cut_in_files(rows, part, key, most, files=10):
    """The rows, dealt so that many tasks write each part: all but one take a multiple of ``most`` rows of it, so that no more files are begun than by one task.

    Rows of a part are numbered by buckets of a hash, with the counts of the buckets before (a short list).
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(256)).cast("int"))
    before = W.partitionBy(part).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(part, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(W.partitionBy(part, "_bucket").orderBy(key)) - 1
    told = dealt.withColumn("_number", number).join(F.broadcast(starts), [part, "_bucket"])  # 256 rows a part
    group = F.floor((F.col("_start") + F.col("_number")) / (most * files))
    return told.repartition(part, group).select(*rows.columns)


@query("small_files", """
WITH p AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey % 8)
SELECT sum(ceil(n / 100.0))::BIGINT AS files, sum(ceil(n / 100.0))::BIGINT AS readable, 0::BIGINT AS unreadable, sum(n)::BIGINT AS rows, 1::BIGINT AS schema_groups FROM p""")
def small_files(spark, sf_dir):
    """A delivery of very many small files, a hundred orders each, audited in one visit to each file."""
    at, part = scratch(spark), (F.col("o_orderkey") % 8).alias("part")
    cut_in_files(table(spark, sf_dir, "orders").select("*", part), "part", "o_orderkey", 100).write.option("maxRecordsPerFile", 100).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part").parquet(at)
    return A.delivery_facts(A.visit(D.discover(spark, at, "*.parquet"))).select("files", "readable", "unreadable", "rows", "schema_groups")


@query("stat_fingerprint")
def stat_fingerprint(spark, sf_dir):
    return D.stat_fingerprint(files(spark, sf_dir))


@query("dropzones", BLOBS + "SELECT '.' AS zone, count(*) AS files, sum(length)::BIGINT AS bytes, count(*) AS parquet_files FROM b")
def dropzones(spark, sf_dir):
    return D.by_dropzone(files(spark, sf_dir), sf_dir.rstrip("/").rsplit("/", 1)[-1])


@query("sampled_files", BLOBS + "SELECT name FROM (SELECT name, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM b) WHERE k IN (0, round_even((n - 1) / 4.0, 0)::INT, round_even((n - 1) / 2.0, 0)::INT, round_even(3 * (n - 1) / 4.0, 0)::INT, n - 1)")
def sampled_files(spark, sf_dir):
    return named(sampled(files(spark, sf_dir).select("path"), "evenly_spaced", 5)).select("name")


def delivered(spark, sf_dir):
    """Events as files of three schemas: whole packets, packets without features, and some whose object ids are text."""
    at = scratch(spark)
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    alerts(e.where(kind == 0)).coalesce(1).write.parquet(f"{at}/night=1")
    alerts(e.where(kind == 1)).drop("lc_features").coalesce(1).write.parquet(f"{at}/night=2")
    alerts(e.where(kind == 2)).withColumn("diaObjectId", F.col("diaObjectId").cast("string")).coalesce(1).write.parquet(f"{at}/night=3")
    A.visit(D.discover(spark, at, "*.parquet")).write.parquet(f"{at}-visits")
    return spark.read.parquet(f"{at}-visits")


@query("pinned_groups", "SELECT event_id % 3 < 2 AS admitted, count(*) AS rows, 1::BIGINT AS files, CASE WHEN event_id % 3 < 2 THEN '' ELSE 'diaObjectId: string' END AS errors FROM events GROUP BY event_id % 3")
def pinned_groups(spark, sf_dir):
    """Files by the schema of their footers, and why a group is refused."""
    return A.pinned(spark, delivered(spark, sf_dir), C.admission_errors, lambda df: df)[1].select("admitted", "rows", "files", "errors")


@query("pinned_sources", over_packets("SELECT population, count(*) AS rows, count(*) FILTER (k % 10 <> 0 AND (source_id - 1) % 3 = 0) AS with_features, count(DISTINCT (source_id - 1) % 3) AS files FROM sources WHERE (source_id - 1) % 3 < 2 GROUP BY 1"))
def pinned_sources(spark, sf_dir):
    """The admitted groups as one typed table, by population, and how many files they come from."""
    scan = A.pinned(spark, delivered(spark, sf_dir), C.admission_errors, lambda df: C.project_sources(df, "a1", "_file"))[0]
    by_file = scan.groupBy("population", "_file").agg(F.count("*").alias("rows"), F.count("lc_features_json").alias("with_features"))
    return by_file.groupBy("population").agg(F.sum("rows").alias("rows"), F.sum("with_features").alias("with_features"), F.count("*").alias("files"))


@query("heavy_fields", "SELECT 'text_bytes' AS path, 'binary' AS type UNION ALL SELECT 'cutout.size', 'int'  UNION ALL SELECT 'cutout', 'struct<size:int>'")
def heavy_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.heavy_fields(docs.select("doc_id", F.col("text").cast("binary").alias("text_bytes"), F.struct(F.length("text").alias("size")).alias("cutout")))


@query("field_inventory", BLOBS + "SELECT name AS \"column\", count(*) AS files, name IN ('text_bytes', 'image') AS heavy, false AS binary, bool_or(type IS NULL) AS nested FROM c GROUP BY 1")
def field_inventory(spark, sf_dir):
    """Heavy, binary and nested columns of all delivered files, from their footers."""
    return A.field_inventory(visits(spark, sf_dir)).drop("types")


@query("delivery_progress", """
WITH o AS (SELECT o_orderkey % 6 AS d, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT d, n, CASE d WHEN 0 THEN 'ready_for_raw_schema_inspection' WHEN 1 THEN 'partial_download' WHEN 2 THEN 'appears_complete_unverified' WHEN 3 THEN 'blocked_corrupt_raw' WHEN 4 THEN 'partial_with_errors' ELSE 'raw_missing' END AS state,
  CASE d WHEN 1 THEN n + 10 WHEN 2 THEN NULL ELSE n END AS expected, CASE WHEN d IN (3, 5) THEN 0 ELSE n END AS rows FROM o)
SELECT 'd' || d AS delivery, CASE d WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 1 END::BIGINT AS files, rows::BIGINT AS readable_rows, state, CASE state WHEN 'ready_for_raw_schema_inspection' THEN 'ready_for_ingestion' WHEN 'appears_complete_unverified' THEN 'ready_for_ingestion'
  WHEN 'blocked_corrupt_raw' THEN 'inspect_partial_only' ELSE 'resume_same_topic_same_directory' END AS action, greatest(expected - rows, 0)::BIGINT * CASE WHEN expected IS NULL THEN NULL ELSE 1 END AS remaining_rows FROM s""")
def delivery_progress(spark, sf_dir):
    """Deliveries of orders: whole, short, without an expectation, broken, broken in part, and missing; where each stands and what to do next."""
    at, orders = scratch(spark), table(spark, sf_dir, "orders")
    part = lambda k: orders.where(F.col("o_orderkey") % 6 == k).coalesce(1)
    for k in (0, 1, 2, 4):
        part(k).write.parquet(f"{at}/d{k}")
    for k in (3, 4):  # text under a name that promises Parquet
        part(k).select(F.to_json(F.struct("*"))).write.text(f"{at}-text{k}")
        renamed(spark, f"{at}-text{k}", f"{at}/d{k}/broken.parquet")
    expected = orders.groupBy(F.concat(F.lit("d"), F.col("o_orderkey") % 6).alias("delivery")).agg(F.count("*").alias("n"))
    expected = expected.select("delivery", F.when(F.col("delivery") == "d1", F.col("n") + 10).when(F.col("delivery") != "d2", F.col("n")).alias("expected_total"), F.lit(None).cast("long").alias("progress"))
    found = A.visit(D.discover(spark, at, "*.parquet"), digest=False)
    found.write.parquet(f"{at}-visits")
    audits = A.delivery_audits(spark.read.parquet(f"{at}-visits"), expected, A.plain(at), "2100-01-01 00:00:00", 100.0)
    ready = R.raw_readiness(audits)
    return R.next_action(ready).join(ready.select("delivery", "remaining_rows"), "delivery").join(audits.select("delivery", "files", "readable_rows"), "delivery")


def renamed(spark, folder, to):
    """The one file of a folder under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(to).getParent())
    fs.rename(fs.globStatus(path(folder, "part-*"))[0].getPath(), path(to))


ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


@query("null_fractions", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round(avg(({c} IS NULL)::INT), 9) AS fraction FROM orders" for c in ORDER_COLUMNS))
def null_fractions(spark, sf_dir):
    return D.null_fractions(table(spark, sf_dir, "orders"))


@query("delivery_reconciliation", """
WITH d AS (SELECT event_type AS delivery, count(*) AS expected, count(*) - CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS committed, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS lag, count(event_id) AS local_rows FROM events GROUP BY 1)
SELECT delivery, expected = committed AND expected = local_rows AND lag = 0 AND expected > 0 AS passed FROM d""")
def delivery_reconciliation(spark, sf_dir):
    kind = F.col("event_type")
    d = table(spark, sf_dir, "events").groupBy(kind.alias("delivery")).agg(F.count("*").alias("expected"), F.count("event_id").alias("local_rows"))
    k = F.col("delivery")
    d = d.withColumns({"committed": F.col("expected") - F.when(k == "click", 1).otherwise(0), "lag": F.when(k == "view", 1).otherwise(0)})
    return D.reconcile(d).select("delivery", "passed")


@query("expected_messages", """
WITH w AS (SELECT event_type AS topic, user_id % 10 AS partition, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1, 2)
SELECT topic, sum(high - low)::BIGINT AS expected, 0::BIGINT AS invalid, 0::BIGINT AS repeated_partitions FROM w GROUP BY 1""")
def expected_messages(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 10).alias("partition")).agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return D.expected_messages(w)



@query("log_chain", """
WITH o AS (SELECT l_orderkey % 10 AS o, count(*) AS k FROM lineitem GROUP BY l_orderkey),
p AS (SELECT 'modified' AS problems, count(*) AS entries FROM o WHERE o = 1 AND k >= 2 UNION ALL SELECT 'sequence,chain,state', count(*) FROM o WHERE o = 2 AND k >= 2
  UNION ALL SELECT 'sequence', sum(k - 2)::BIGINT FROM o WHERE o = 2 AND k > 2 UNION ALL SELECT 'malformed', count(*) FROM o WHERE o = 3 UNION ALL SELECT 'chain,state', count(*) FROM o WHERE o = 3 AND k >= 2
  UNION ALL SELECT 'transition', count(*) FROM o WHERE o = 4)
SELECT * FROM p WHERE entries > 0""")
def log_chain(spark, sf_dir):
    """A sealed log an order, an entry a line: some with a changed word, a lost first entry, a broken line, or a first state that none may start from."""
    order, k = F.col("l_orderkey"), F.col("l_orderkey") % 10

    def entry(seq, part, before, state_before):
        state = F.when((k == 4) & (seq == 1), "archived").when(seq % 2 == 1, "declared").otherwise("failed")
        members = {
            "actor": F.lit("builder"), "at_utc": F.lit("2024-01-01T00:00:00Z"), "evidence": F.struct(F.array(part).alias("parts"), F.lit("\u00e9").alias("word")), "from": state_before,
            "prev_entry_sha256": before, "reason": F.concat(F.lit("part "), part.cast("string")), "seq": seq, "to": state,
        }
        return state, F.to_json(F.struct(*(v.alias(n) for n, v in sorted(members.items()))), {"ignoreNullFields": "false"})

    def step(acc, x):
        state, body = entry(F.size(acc["lines"]) + 1, x["l_partkey"], acc["seal"], acc["state"])

        def sealed(b):
            line = F.replace(b["body"], F.lit('"evidence":'), F.concat(F.lit('"entry_sha256":"'), b["seal"], F.lit('","evidence":')))
            return F.struct(b["seal"].alias("seal"), b["state"].alias("state"), F.concat(acc["lines"], F.array(line)).alias("lines"))

        # lambdas over lists of one bind a value, so that the body and its digest are made once for each entry
        seal = lambda b: F.struct(F.sha2(F.replace(b["body"], F.lit("\u00e9"), F.lit("\\u00e9")), 256).alias("seal"), b["state"].alias("state"), b["body"].alias("body"))
        return F.transform(F.transform(F.array(F.struct(state.alias("state"), body.alias("body"))), seal), sealed)[0]

    none = F.lit(None).cast("string")
    start = F.struct(none.alias("seal"), none.alias("state"), F.array().cast("array<string>").alias("lines"))
    logs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    whole = logs.select(order.alias("log"), F.aggregate("x", start, step)["lines"].alias("lines"))
    k = F.col("log") % 10
    kept = F.when(k == 2, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))).otherwise(F.col("lines"))
    lines = whole.withColumn("lines", kept).select("log", F.posexplode("lines").alias("at", "line"))
    broken = F.when((k == 1) & (F.col("at") == 1), F.replace("line", F.lit('"reason":"part'), F.lit('"reason":"Part'))).when((k == 3) & (F.col("at") == 0), "{").otherwise(F.col("line"))
    edges = spark.createDataFrame([(None, "declared"), ("declared", "failed"), ("failed", "declared"), ("archived", "failed")], "from_state string, to_state string")
    return broken_entries(lines.select("log", (F.col("at") + 1).alias("number"), broken.alias("line")), edges).groupBy("problems").agg(F.count("*").alias("entries"))


def scratch(spark):
    from skyledger.streaming.incremental import scratch_dir

    return f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"


@query("stream_ingest", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def stream_ingest(spark, sf_dir):
    """The orders through the file stream, twice: the second run finds nothing new."""
    from skyledger.streaming.incremental import file_stream, ingest_available

    at, schema = scratch(spark), table(spark, sf_dir, "orders").schema
    for _ in range(2):
        ingest_available(file_stream(spark, f"{sf_dir}/orders.parquet", schema), f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys"))


@query("stream_unique", "SELECT count(DISTINCT user_id || ':' || event_type) AS rows FROM events")
def stream_unique(spark, sf_dir):
    """Users' event types, each once within a bound that spans the data."""
    from skyledger.streaming.incremental import file_stream, ingest_available, unique_in_bound

    at, schema = scratch(spark), table(spark, sf_dir, "events").schema
    stream = file_stream(spark, f"{sf_dir}/events.parquet", schema).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    ingest_available(unique_in_bound(stream, "key", "at", "60 days"), f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("rows"))


@query("stream_nightly_bands", "SELECT ts::DATE AS night, event_type AS band, count(*) AS alerts FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events) GROUP BY 1, 2")
def stream_nightly_bands(spark, sf_dir):
    """Finished days of the stream; the last day is still open at its end."""
    from skyledger.streaming.incremental import file_stream, ingest_available, nightly_band_counts

    at, schema = scratch(spark), table(spark, sf_dir, "events").schema
    stream = file_stream(spark, f"{sf_dir}/events.parquet", schema).select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("band"))
    ingest_available(nightly_band_counts(stream, "at", "band", "0 seconds"), f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_file_status", """
WITH o AS (SELECT o_orderkey % 8 AS part FROM orders),
r AS (SELECT * FROM (VALUES ('first', 'completed', 0, 3), ('first', 'failed', 4, 6), ('second', 'skipped_completed', 0, 3), ('second', 'failed', 4, 6), ('second', 'completed', 7, 7)) r(run, status, low, high))
SELECT run, status, any_value(high - low + 1)::BIGINT AS files, count(*) FILTER (status = 'completed') + CASE WHEN status <> 'completed' THEN NULL ELSE 0 END AS rows FROM r JOIN o ON part BETWEEN low AND high GROUP BY run, status
UNION ALL SELECT 'table', 'orders', 5, count(*) FROM o WHERE part IN (0, 1, 2, 3, 7)""")
def stream_file_status(spark, sf_dir):
    """Two runs over files of orders of which some are broken, each in its way; one more has come before the second. Files fail alone."""
    from skyledger.streaming.incremental import file_status, ingest_run

    at, orders = scratch(spark), table(spark, sf_dir, "orders")
    part = lambda *k: orders.where((F.col("o_orderkey") % 8).isin(*k)).coalesce(1)
    for k in range(4):
        part(k).write.parquet(f"{at}/in/good{k}")
    part(4).drop("o_custkey").write.parquet(f"{at}/in/short")
    part(5).select(F.to_json(F.struct("*"))).write.text(f"{at}/in/text")
    part(6).withColumn("o_totalprice", F.col("o_orderdate").cast("string")).write.parquet(f"{at}/in/other")
    for run in ("first", "second"):
        ingest_run(spark, f"{at}/in", f"{at}/out", orders.schema, lambda df: {"orders": df}, run).awaitTermination()
        if run == "first":
            part(7).write.parquet(f"{at}/in/late")
    told = file_status(spark, f"{at}/out").groupBy("run", "status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))
    kept = spark.read.option("recursiveFileLookup", True).parquet(f"{at}/out/orders").agg(F.lit("table").alias("run"), F.lit("orders").alias("status"), F.countDistinct("_raw_file").alias("files"), F.count("*").alias("rows"))
    return told.unionByName(kept)


@query("night_partitions", over_packets("SELECT CASE WHEN night >= DATE '2024-01-03' AND night < DATE '2024-01-06' THEN night::VARCHAR ELSE 'out_of_window' END AS night_key, count(*) AS rows, count(DISTINCT source_id) AS sources FROM sources GROUP BY 1"))
def night_partitions(spark, sf_dir):
    """Packets written by night and read back."""
    at = scratch(spark)
    write_nights({"alerts": alerts(table(spark, sf_dir, "events")).drop("lc_features")}, at, "midpointMjdTai", "2024-01-03", "2024-01-06")
    back = spark.read.parquet(f"{at}/alerts").groupBy(F.col("night_key").cast("string").alias("night_key"), "diaSourceId").agg(F.count("*").alias("n"))
    return back.groupBy("night_key").agg(F.sum("n").alias("rows"), F.count("diaSourceId").alias("sources"))


@query("loaded_files", "SELECT kind, k::INT AS _raw_file_index, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders, (VALUES (0, 'csv'), (1, 'json'), (2, 'parquet')) f(k, kind) WHERE o_orderkey % 3 = k GROUP BY 1, 2")
def loaded_files(spark, sf_dir):
    """Orders in files of three formats, loaded as one table with the number of each row's file."""
    at, orders = scratch(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    part = lambda k: orders.where(F.col("o_orderkey") % 3 == k).coalesce(1)
    part(0).write.option("header", True).csv(f"{at}/0")
    part(1).write.json(f"{at}/1")
    part(2).write.parquet(f"{at}/2")
    rows = D.load_files(spark, at)
    kind = F.element_at(F.array(*map(F.lit, ["csv", "json", "parquet"])), F.col("_raw_file_index") + 1)
    return rows.groupBy(kind.alias("kind"), "_raw_file_index").agg(F.count("*").alias("rows"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))


@query("forced_columns", over_packets("SELECT source_id AS \"diaSourceId\", raw_object_id AS \"diaObjectId\", round(flux * 2, 6) AS \"prvForcedFlux\", band AS fp_band FROM sources"))
def forced_columns(spark, sf_dir):
    """What of a wide packet is like forced photometry, by name."""
    rows = alerts(table(spark, sf_dir, "events"))
    wide = rows.withColumns({"prvForcedFlux": F.round(F.col("psfFlux") * 2, 6), "fp_band": F.col("band")})
    return table_family(wide)["forced_photometry"]
