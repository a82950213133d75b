"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents of equal texts are one node and stay together; links are equal long lines. The few nodes that are large beside a
shard are placed first, and only one that fits no shard is cut. Linked nodes start in the order of their first link, cut into
shards of equal bytes; then rounds of label propagation move nodes to the shard in which most of
their neighbours are, as far as quotas allow, until hardly any moves. Nodes without links fill the shards up to equal sizes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import durable, tidy

#: Rows that one task numbers or sums at once, about.
BUCKET_ROWS = 20_000
#: Shorter lines are no links.
LINE_CHARS = 60
#: Nodes of more than this part of a shard are placed one by one: at most 1 / LARGE of them a shard.
LARGE = 1 / 20
#: Propagation ends after so many rounds, or when a round moves less than this part of the linked bytes.
ROUNDS, SETTLED = 8, 0.005


def choose(index: Column, values: list) -> Column:
    """``values[index]``, for a short list of numbers."""
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def placed(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the exclusive running sum of ``value`` over the buckets in the order of the columns ``order``
    and, inside a bucket, of rid. One row a bucket is summed in one place, and no rows else."""
    sums = rows.groupBy(*order).agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    inside = F.sum(value).over(W.partitionBy(*order).orderBy("rid").rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("_in", inside).join(starts, order).withColumn(name, F.col("_in") + F.col("_start")).drop("_in", "_start")


def water(loads: np.ndarray, amount: float) -> np.ndarray:
    """What each shard takes of ``amount`` so that the emptiest are filled to one level."""
    low = np.sort(loads)
    for k in range(len(low), 0, -1):
        level = (amount + low[:k].sum()) / k
        if level >= low[k - 1]:
            break
    return np.maximum(0.0, level - loads)


def cut(position: Column, shares: np.ndarray) -> Column:
    """The shard into whose interval a position falls; the intervals have the lengths ``shares``."""
    ends, filled = np.cumsum(shares), np.flatnonzero(shares > 0)
    out = F.lit(int(filled[-1]) if len(filled) else 0)
    for k in filled[::-1][1:]:
        out = F.when(position < float(ends[k]), F.lit(int(k))).otherwise(out)
    return out


def first_shards(linked: DataFrame, n: int, shares: np.ndarray) -> DataFrame:
    """``rid, size, shard``: linked nodes in the order of their first link, cut by bytes into ``shares``. A link with very
    many nodes is dealt over several buckets, in which its nodes stay neighbours."""
    buckets = max(1, -(-n // BUCKET_ROWS))
    hot = durable(linked.groupBy("first").agg(F.count("*").alias("n")).where(f"n > {BUCKET_ROWS}").select("first", F.ceil(F.col("n") / BUCKET_ROWS).alias("pieces")))
    marked = linked.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "first", "left")
    marked = marked.select(
        "rid", "size", F.floor(F.pmod(F.xxhash64("first"), F.lit(1 << 20)) * buckets / (1 << 20)).alias("k0"),
        F.when(F.col("pieces").isNull(), 0).otherwise(F.col("first")).alias("k1"),
        F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("pieces"))).alias("k2"), "first",
    )
    inside = F.sum("size").over(W.partitionBy("k0", "k1", "k2").orderBy("first", "rid").rowsBetween(W.unboundedPreceding, 0))
    sums = marked.groupBy("k0", "k1", "k2").agg(F.sum("size").alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(W.orderBy("k0", "k1", "k2").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    summed = marked.withColumn("_in", inside).join(starts, ["k0", "k1", "k2"])
    middle = F.col("_start") + F.col("_in") - F.col("size") / 2
    return durable(summed.select("rid", "size", cut(middle, shares).alias("shard")))


def place_large(large: list, loads: np.ndarray, share: float) -> list[tuple[int, int, float]]:
    """``(rid, shard, until)`` of nodes that are large beside a shard, the largest first, each into the emptiest shard; loads
    grow. A node beyond the room there is cut: rows whose place in 0..1 lies below ``until`` (and not below an earlier one) go to the shard."""
    found = []
    for r in sorted(large, key=lambda r: (-r.size, r.rid)):
        k = int(np.argmin(loads))
        if loads[k] + r.size <= share * (1 + LARGE):
            loads[k] += r.size
            found.append((r.rid, k, 1.0))
            continue
        parts, left = np.zeros(len(loads)), float(r.size)
        for k in np.argsort(loads, kind="stable"):  # as few shards as have the room
            parts[k] = min(left, max(0.0, share - loads[k]))
            left -= parts[k]
        parts += water(loads + parts, left)
        loads += parts
        filled, ends = np.flatnonzero(parts > 0), np.cumsum(parts) / parts.sum()
        found += [(r.rid, int(k), 1.0 if k == filled[-1] else float(ends[k])) for k in filled]
    return found


def allowed_moves(flows: list, loads: np.ndarray, capacity: float) -> list[tuple[int, int, int, int]]:
    """``(shard, to, level, part)``: documents that would go from ``shard`` to ``to`` may, if their level is above
    this one, or equals it and their part is below ``part``.

    flows: ``shard, to, level, part, bytes``. Opposite moves pay for each other; beyond those a shard takes what
    it has room for. Higher gains go first.
    """
    want = np.zeros((len(loads), len(loads)))
    for r in flows:
        want[r.shard, r.to] += r.bytes
    quota = np.minimum(want, want.T)
    room = np.maximum(0.0, capacity - loads)
    rest = want - quota
    for t in range(len(loads)):
        asked = rest[:, t].sum()
        if asked > 0:
            quota[:, t] += rest[:, t] * min(1.0, room[t] / asked)
    found = []
    for s, t in zip(*np.nonzero(quota), strict=True):
        left, edge = quota[s, t], None
        for r in sorted((r for r in flows if r.shard == s and r.to == t), key=lambda r: (-r.level, r.part)):
            if r.bytes > left:
                edge = r.level, r.part
                break
            left -= r.bytes
        found.append((int(s), int(t), *(edge or (-1, 0))))
    return found


def propagate(state: DataFrame, links: DataFrame, shards: int, capacity: float, fixed: np.ndarray | None = None, rounds: int = ROUNDS, parts: int = 64) -> DataFrame:
    """Rounds of label propagation over ``rid, size, shard`` and ``rid, link, weight``. fixed: what shards hold besides.

    A link's nodes are counted by shard (merged before the shuffle, eight numbers a link), and
    those counts go back to the nodes by an equi-join, which Spark splits where a link is hot.
    """
    spark = state.sparkSession
    here = [F.sum(F.when(F.col("shard") == k, 1).otherwise(0)).alias(f"c{k}") for k in range(shards)]
    for turn in range(rounds):
        counts = links.join(state.select("rid", "shard"), "rid").groupBy("link").agg(F.count("*").alias("members"), *here)
        share = [F.sum(F.col("weight") * F.col(f"c{k}") / F.col("members")).alias(f"v{k}") for k in range(shards)]
        votes = links.join(counts, "link").groupBy("rid").agg(F.sum(F.col("weight") / F.col("members")).alias("self"), *share)
        vote = F.array(*(F.col(f"v{k}") for k in range(shards)))
        others = F.array(*(F.when(F.col("shard") == k, F.lit(-1.0)).otherwise(F.col(f"v{k}")) for k in range(shards)))
        seen = state.join(votes, "rid").withColumn("to", (F.array_position(others, F.array_max(others)) - 1).cast("int"))
        gain = F.array_max(others) - F.element_at(vote, F.col("shard") + 1) + F.col("self")
        part = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(parts)).cast("int")
        seen = durable(seen.select("rid", "size", "shard", "to", F.least(F.ceil(gain * 16), F.lit(64)).cast("int").alias("level"), part.alias("part")))
        loads = np.zeros(shards) if fixed is None else fixed.copy()
        for r in seen.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            loads[r.shard] += r.bytes
        # at most shards x shards x 65 x parts rows
        flows = seen.where("level > 0").groupBy("shard", "to", "level", "part").agg(F.sum("size").alias("bytes")).collect()
        edges = allowed_moves(flows, loads, capacity)
        if not edges:
            break
        bounds = spark.createDataFrame(edges, "shard int, to int, edge int, before int")
        may = (F.col("level") > 0) & ((F.col("level") > F.col("edge")) | ((F.col("level") == F.col("edge")) & (F.col("part") < F.col("before"))))
        moved = seen.join(F.broadcast(bounds), ["shard", "to"], "left")  # shards x shards rows
        goes = F.coalesce(may, F.lit(False))
        moved = durable(moved.select("rid", "size", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), goes.alias("moved")))
        state, done = moved.drop("moved"), moved.agg(F.sum(F.when(F.col("moved"), F.col("size"))).alias("moved"), F.sum("size").alias("all")).first()
        if (done.moved or 0) < SETTLED * done["all"]:
            break
    return state


def fill(alone: DataFrame, n: int, loads: np.ndarray, total: float) -> list[DataFrame]:
    """Shards for nodes without links, ``rid, shard``: large ones first and small ones last, each tier cut
    into intervals that bring the shards to one level."""
    buckets, average, out = max(1, -(-n // BUCKET_ROWS)), total / len(loads), []
    tiers = [(average / 20, np.inf), (average / 400, average / 20), (average / 8000, average / 400), (-1.0, average / 8000)]
    for low, high in tiers:
        tier = alone.where((F.col("size") > low) & (F.col("size") <= float(high)))
        amount = tier.agg(F.sum("size")).first()[0]
        if not amount:
            continue
        dealt = placed(tier.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets))), ["bucket"], "size", "at")
        done = durable(dealt.select("rid", "size", cut(F.col("at") + F.col("size") / 2, water(loads, float(amount))).alias("shard")))
        for r in done.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            loads[r.shard] += r.bytes
        out.append(done.select("rid", "shard"))
    return out


def assigned(rows: DataFrame, dealt: DataFrame, buckets: int) -> DataFrame:
    """The rows with the shard of their node. Rows of a node that is cut are spread evenly over its parts, in
    buckets, so that no task ranks them all."""
    ways = dealt.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("until", "shard"))).alias("ways"))  # shards entries at most
    joined = rows.join(ways, "whole").withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    own = W.partitionBy("whole", "bucket")
    ranked = joined.where("size(ways) > 1").withColumn("place", (F.row_number().over(own.orderBy("rid")) - 0.5) / F.count("*").over(own))
    parts = ranked.withColumn("shard", F.filter("ways", lambda w: F.col("place") < w["until"])[0]["shard"]).drop("place")
    return joined.where("size(ways) = 1").withColumn("shard", F.col("ways")[0]["shard"]).unionByName(parts).drop("ways")


@tidy
def node_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``whole, shard, until`` of every node: equal texts. until: 1, or, of a node that is cut, the end of the shard's part of it.

    rows: ``rid, size, whole, lines``.
    """
    nodes = durable(rows.groupBy(F.col("whole").alias("rid")).agg(F.sum("size").alias("size"), F.first("lines").alias("lines")))
    facts = nodes.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    share, loads = float(facts.bytes or 0) / shards, np.zeros(shards)
    placed_first = place_large(nodes.where(F.col("size") > share * LARGE).select("rid", "size").collect(), loads, share)  # shards / LARGE nodes at most
    large = rows.sparkSession.createDataFrame(placed_first, "whole long, shard int, until double")
    nodes = nodes.where(F.col("size") <= share * LARGE)
    every = nodes.select("rid", "size", F.explode("lines").alias("link"))
    shared = every.groupBy("link").agg(F.count("*").alias("members")).where("members > 1").select("link")
    links = durable(every.join(shared, "link", "left_semi"))
    linked = links.groupBy("rid").agg(F.first("size").alias("size"), F.max("link").alias("first"))
    sums, parts = linked.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first(), []
    if sums.n:
        state = first_shards(linked, sums.n, water(loads, float(sums.bytes)))
        state = propagate(state, links.select("rid", "link", F.lit(1.0).alias("weight")), shards, share, loads)
        for r in state.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
            loads[r.shard] += r.bytes
        parts.append(state.select("rid", "shard"))
    alone = durable(nodes.select("rid", "size").join(links.select("rid"), "rid", "left_anti"))
    parts += fill(alone, facts.n - (sums.n or 0), loads, share * shards)
    return reduce(DataFrame.unionByName, [large, *(p.select(F.col("rid").alias("whole"), "shard", F.lit(1.0).alias("until")) for p in parts)])


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``.

    Size is the text's UTF-8 bytes and 1; a null text counts as empty, with crc32 0. Equal texts are one node, and nodes are linked by
    equal lines of ``LINE_CHARS`` or more. Equal texts stay in one shard, if they fit one; a group larger than a shard is cut. Slots number a
    shard's rows from 0 without gaps. Repeated rows get a place each. grown_shard is null: this law makes no
    promise about one more shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(x) >= LINE_CHARS), lambda x: F.xxhash64(x))
    rows = durable(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit("whole")).alias("whole"), F.array_distinct(lines).alias("lines"),
        )
    )
    n = rows.count()
    dealt = node_shards(rows, shards)
    buckets = max(1, -(-n // BUCKET_ROWS))
    joined = assigned(rows.drop("lines"), dealt, buckets).select("rid", "doc_id", "size", "text_crc32", "shard", "bucket")
    joined = durable(joined)
    counts = joined.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    starts = counts.withColumn("start", F.sum("rows").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).drop("rows")
    numbered = joined.withColumn("_in", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("rid")) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_in")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
