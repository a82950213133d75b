"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import durable

#: Rows of one bucket in the two-level running sums, about.
BUCKET_ROWS = 20_000


def words_of(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a source.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    words by weight; a target stops at ``most`` times its source's size and the excess is shared
    again. That is a water level: with sources in order of size over weight, those before the
    first one that the level (of what they leave to it and all after it) doesn't lift over its stop, stop.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    filling = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    words = F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = words / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("stop"), final * F.col("weight")), F.col("stop"))
    return filled.select("source", "source_size", target.alias("target"))


def running_sums(rows: DataFrame) -> DataFrame:
    """Add ``so_far``, the running sum of ``size`` by ``queue`` in the order (bucket, turn).

    Sums of buckets give each bucket its start (a small table), and a window inside the bucket the
    rest, so that no task holds more than a bucket, however many rows a queue has.
    """
    over = W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("queue", "bucket").agg(F.sum("size").alias("_sum"))
    starts = sums.select("queue", "bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inside = W.partitionBy("queue", "bucket").orderBy("turn", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_in", F.sum("size").over(inside)).join(starts, ["queue", "bucket"])
    return summed.withColumn("so_far", F.col("_in") + F.col("_start")).drop("_in", "_start")


def mix(docs: DataFrame, *keep: str, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The kept columns (doc_id, if none are named) and ``size, source_size, target, taken, copies`` of every row.

    A source's documents are shuffled by md5 of seed, id and text, and pass ``most`` times. A copy's
    virtual finish time is its source's words so far over the source's target, which is its weight
    after the stops. All copies are put in the order of finish time and taken whole up to
    the budget, ``share`` times all words. In a source finish times rise with the shuffle, so what is taken
    is told by one last turn for each source and pass, and whole texts are never shuffled. Reruns agree.
    Rows of equal id, text and source share a turn and are taken alike. Null text: size 0, takes nothing. Null
    source: a source of its own, last. A table without words has targets of 0.
    """
    keep = keep or ("doc_id",)
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    measured = docs.select(F.struct(*keep).alias("kept"), words_of(F.col("text")).alias("size"), turn.alias("turn"), queue.alias("queue"), F.col("source").alias("source"))
    rows = durable(measured.drop("kept"))
    sources = durable(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most))
    facts = rows.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    buckets = max(1, min(4096, -(-facts.n // BUCKET_ROWS)))
    budget = share * (facts.words or 0)
    place = F.floor(F.conv(F.substring("turn", 1, 6), 16, 10).cast("long") * buckets / 16777216).cast("int")
    few = sources.count() <= 10_000  # else Spark's own choice, which splits skewed joins
    targets = sources.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("queue"), "source_size", "target")
    timed = running_sums(rows.withColumn("bucket", place)).join(F.broadcast(targets) if few else targets, "queue")

    finish = [F.when(F.col("target") > 0, (F.col("so_far") + k * F.col("source_size")) / F.col("target")) for k in range(most)]
    copies = timed.select("queue", "source", "turn", "size", F.posexplode(F.array(*finish)).alias("round", "finish")).where("size > 0 and finish is not null")
    slots = 16 * buckets
    line = durable(copies.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(4.0)) * slots).cast("long")))
    # the slot of finish times in which the budget runs out, and the words before it
    filled = line.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(W.orderBy("slot")) - F.col("words"))
    last = filled.where(F.col("before") <= budget).orderBy(F.desc("slot")).first()
    if last is not None:  # in that slot alone the order of single copies matters
        order = W.orderBy("finish", F.col("source").asc_nulls_last(), "turn", "round", "size").rowsBetween(W.unboundedPreceding, 0)
        ends = line.where(F.col("slot") == last.slot).withColumn("queued", F.lit(last.before) + F.sum("size").over(order))
        line = line.where(F.col("slot") < last.slot).unionByName(ends.where(F.col("queued") <= budget).drop("queued"))
    turns = [F.max(F.when(F.col("round") == k, F.col("turn"))).alias(f"turn{k}") for k in range(most)]
    until = durable(targets.join(line.groupBy("queue").agg(*turns), "queue", "left"))
    taken = F.lit(0)
    for k in range(most):
        taken = taken + F.coalesce(F.col("turn") <= F.col(f"turn{k}"), F.lit(False)).cast("int")
    counted = measured.join(F.broadcast(until) if few else until, "queue").withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))
    return counted.select("kept.*", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS turn
  FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM ranked
  WINDOW b AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, max(CASE WHEN level * weight <= stop THEN level END) OVER () AS final FROM filled),
targets AS (SELECT source, source_size, coalesce(least(stop, final * weight), stop) AS target FROM leveled),
timed AS (
  SELECT s.*, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.size ROWS UNBOUNDED PRECEDING) AS so_far
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, turn, size, k, (so_far + k * source_size) / target AS finish
  FROM timed, (VALUES (0), (1)) r(k) WHERE size > 0 AND target > 0),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, turn, k, size ROWS UNBOUNDED PRECEDING) AS queued FROM copies),
won AS (
  SELECT doc_id, turn, count(*) AS n FROM queued WHERE queued <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY doc_id, turn)
SELECT t.doc_id, t.size, t.source_size::BIGINT AS source_size, t.target, (t.size * coalesce(w.n, 0))::BIGINT AS taken
FROM timed t LEFT JOIN won w ON t.doc_id IS NOT DISTINCT FROM w.doc_id AND t.turn = w.turn
"""
