"""Ranked lexical search by classes of equal bags: documents that look alike to every item are scored once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import durable, release, runs, schema_with, trim, with_text
from skyledger.llm.packing import runs_at

#: Terms of items that one pass over the documents takes; more items are taken in several passes.
BLOCK_TERMS = 2_000_000
#: Classes that are scored at once, at most; scores that may stand in memory at once.
SCORED, CELLS = 2048, 4_000_000
#: Fixed value: what ends a term. Terms are ASCII letters and digits and all that is not ASCII.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: White space for what ends a term, small letters for capitals; everything else as it is.
PLAIN = bytes(32 if b in BETWEEN else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of classes that may be broadcast.
FEW_BYTES = 16 << 20
#: Sums of at most this are exact in doubles.
EXACT = 1 << 53


def terms(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times``: the terms of each item, over its different texts. Null texts have none."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", "text").distinct().select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def blocks(told: DataFrame) -> list[Column]:
    """Conditions on ``item_id`` that cut the items into blocks of about ``BLOCK_TERMS`` terms."""
    n = max(1, -(-told.count() // BLOCK_TERMS))
    return [F.pmod(F.xxhash64("item_id"), F.lit(n)) == k for k in range(n)]


def bags(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``doc_id, n, bag`` of each document with terms: how many it has, and which of ``words`` how often (numbers of words in order, then counts, as
    little-endian 32-bit)."""
    held = docs.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))  # bounded by BLOCK_TERMS
    schema = schema_with(docs, ("doc_id",), "n long, bag binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = {w: k for k, w in enumerate(held.value.to_pylist())}
        for rows, texts in runs(batches):
            of, sizes, found = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                own = terms(text)
                if own:
                    at = np.fromiter((k for k in map(known.get, own) if k is not None), np.int64)
                    which, times = np.unique(at, return_counts=True)
                    of.append(i)
                    sizes.append(len(own))
                    found.append(np.concatenate([which, times]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=schema.names)
        trim()

    return with_text(docs, "doc_id").mapInArrow(count, schema)


def opened(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and how often each occurs."""
    both = np.frombuffer(bag, "<u4").astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def holders(found: DataFrame, words: int) -> np.ndarray:
    """In how many documents each word occurs; every task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(words, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                seen[opened(bag)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["word", "docs"])

    rows = found.select("bag").mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(words, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["docs"].to_numpy(np.int64)
    return out


def classes(found: DataFrame) -> DataFrame:
    """``h, m, bag, first``: the classes of equal bag and m, met by a hash and told by the bag itself, with their least doc_id."""
    return found.where(F.length("bag") > 0).groupBy(F.xxhash64("bag", "m").alias("h"), "m", "bag").agg(F.min("doc_id").alias("first"))


class Best:
    """For each item the ``most`` best classes so far: highest score, then least first id (nulls last)."""

    def __init__(self, items: int, most: int):
        self.items, self.most = items, most
        self.item, self.score, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.kept: list = []
        self.least = np.ones(items, np.int64)  # scores of 0 don't count

    def add(self, scores: np.ndarray, first: np.ndarray, payload: list) -> None:
        """scores: a row a class, a column an item."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        self.item, self.score, self.first = np.append(self.item, item), np.append(self.score, scores[row, item]), np.append(self.first, first[row])
        self.kept += [payload[k] for k in row.tolist()]
        order = np.lexsort((self.first, -self.score, self.item))
        ends = np.cumsum(np.bincount(self.item, minlength=self.items))
        place = np.arange(len(order)) - np.append(0, ends[:-1])[self.item[order]]
        order = order[place < self.most]
        self.item, self.score, self.first = self.item[order], self.score[order], self.first[order]
        self.kept = [self.kept[k] for k in order.tolist()]
        full = np.flatnonzero(np.bincount(self.item, minlength=self.items) == self.most)
        last = np.searchsorted(self.item, full, side="right") - 1
        self.least[full] = self.score[last]


def scored(found: DataFrame, postings: tuple, items: int, most: int) -> DataFrame:
    """``item, score, first, h, m, bag``: of each task the ``most`` best classes of each item, each class scored once.

    postings: where each word's items start, the items, and the word's weight times its number of times there.
    """
    held = found.sparkSession.sparkContext.broadcast(postings)  # bounded by BLOCK_TERMS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, item, worth = held.value
        best = Best(items, most)
        step = max(1, min(SCORED, CELLS // max(1, items)))
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                m = batch.column(1).to_pylist()
                sheet = np.zeros((len(batch), items), np.int64)
                for k, bag in enumerate(batch.column(2).to_pylist()):
                    word, tf = opened(bag)
                    gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[k])
                    n = starts[word + 1] - starts[word]
                    spots, _ = runs_at(starts[word], n)
                    gains = np.repeat(gain, n)
                    if worth.size and float(gain.max()) * float(worth.sum()) < EXACT:
                        sheet[k] = np.bincount(item[spots], weights=gains * worth[spots], minlength=items)
                    else:
                        np.add.at(sheet[k], item[spots], gains * worth[spots])
                first = batch.column(3).fill_null(np.iinfo(np.int64).max).to_numpy()
                best.add(sheet, first, list(zip(batch.column(0).to_pylist(), m, batch.column(2).to_pylist(), strict=True)))
        for lo in range(0, len(best.kept), SCORED):
            part = slice(lo, lo + SCORED)
            rest = [pa.array(c, t) for c, t in zip(zip(*best.kept[part], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(best.item[part]), pa.array(best.score[part]), pa.array(best.first[part]), *rest], names=["item", "score", "first", "h", "m", "bag"])
        trim()

    return found.select("h", "m", "bag", "first").mapInArrow(score, "item long, score long, first long, h long, m long, bag binary")


def first_of(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their ``rank``; Spark cuts groups to that many before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def search_block(docs: DataFrame, told: DataFrame, most: int) -> DataFrame:
    """The ranking of one block of items."""
    spark = docs.sparkSession
    listed = told.toPandas()  # bounded by BLOCK_TERMS
    ids, item = np.unique(listed["item_id"].to_numpy(), return_inverse=True) if len(listed) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = sorted({t.encode() for t in listed["term"]})
    place = {w: k for k, w in enumerate(words)}
    word = np.fromiter((place[t.encode()] for t in listed["term"]), np.int64, len(listed))
    found = durable(bags(docs, words))
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = holders(found, len(words))
    weight = np.fromiter((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()), np.int64, len(words))
    order = np.argsort(word, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))
    worth = (weight[word] * listed["times"].to_numpy(np.int64) if len(listed) else np.zeros(0, np.int64))[order]
    m = F.lit(100 - 25) + F.expr(f"(25L * n * {n_docs}L) div {max(1, n_terms)}L")
    found = found.withColumn("m", m.cast("long"))
    best = scored(classes(found), (starts, item[order].astype(np.int64), worth), len(ids), most)
    best = durable(first_of(best, ["item"], [F.desc("score"), F.asc("first"), "h", "bag"], most).drop("rank", "first"))
    # a class whose first document is not among an item's best can't have a document there; at most `most` classes an item are left
    key = ["h", "m", "bag"]
    wanted = durable(best.select(*key).distinct())
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("bag") + 24), F.lit(0)).alias("bytes")).first()
    wanted = F.broadcast(wanted) if size.bytes <= FEW_BYTES else wanted.hint("merge")  # copies of one class then stay where they are until they are cut
    members = first_of(found.withColumn("h", F.xxhash64("bag", "m")).join(wanted, key).select(*key, "doc_id"), key, [F.asc_nulls_last("doc_id")], most).drop("rank")
    expanded = best.join(members, key).select("item", "doc_id", "score")
    named = spark.createDataFrame(list(enumerate(ids.tolist())), T.StructType([T.StructField("item", T.LongType()), told.schema["item_id"]]))
    ranked = first_of(expanded, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], most)
    return ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``most`` documents of highest score above 0, equal scores by ascending doc_id.

    Null texts have no terms and documents without terms count nowhere. Rows of documents are ranked each, also where they are equal; a null
    doc_id comes last among equal scores. Items without terms have no rows; rows of one item_id are one item with the terms of its different
    texts, and a null item_id is left out. Other columns are not looked at.
    """
    told = durable(item_terms(items.where("item_id is not null")))
    out = None
    for block in blocks(told):
        found = search_block(docs, told.where(block), most)
        out = found if out is None else out.unionByName(found)
    return out


#: The same ranking in SQL.
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY 1, 2),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
p AS (SELECT item_id, f.doc_id, f.r, sum(i.times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score FROM f JOIN w USING (term) JOIN i USING (term), s GROUP BY 1, 2, 3)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0) WHERE rank <= 20"""
