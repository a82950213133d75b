"""Maximal periodic runs of words, found in tiles by period octave and stitched by document and period.

A run of smallest period q that is at least 4 * q long repeats its first q words three times in a row, so that a place c
of it on the grid of its octave (periods P to 2 * P - 1, grid step P) starts four words that stand again q words on. Around each such
place lies a tile; Z-functions at the place, forwards and backwards, tell for every period of the octave how far the
words agree inside the tile. Neighbouring tiles overlap by more than what they leave undecided, so that the fragments of a run touch,
whichever tasks solved them, and Spark stitches them by document and period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import durable, release, runs, schema_with, trim, with_text

#: A run is at least SHORTEST words long and FOLD periods.
SHORTEST, FOLD = 6, 4
#: Words that must stand again for a place to be looked at: any run of FOLD periods and SHORTEST words has them at a place of its octave's grid.
SEED = 4
#: Words that one row of tiles spans at most, beside its margins; longer documents are solved in several tasks.
SPAN = 1 << 15
#: Runs that may be broadcast (about 100 bytes each).
FEW = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def order_after(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """``a, p`` of a document whose words from a on are made to repeat with period p; None for most documents.

    Which ones, and how, follows from crc32 of the id's decimal text. A null id has none and changes nothing.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def in_order(doc_id: int | None, n: int) -> np.ndarray:
    """The original number of each word after that change."""
    at, change = np.arange(n), order_after(doc_id, n)
    if change:
        a, p = change
        at[a:] = a + (at[a:] - a) % p
    return at


def word_codes(texts: pa.Array) -> list[np.ndarray]:
    """Numbers that tell the words of each text apart; equal words of a text have equal numbers."""
    lists = pa.compute.ascii_split_whitespace(texts.view(pa.string()))
    ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy())
    words = lists.flatten().dictionary_encode()
    which = words.indices.to_numpy()
    blank = pa.compute.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    cut = np.split(which, ends[:-1])
    return [c[c != blank] for c in cut] if blank >= 0 else cut


def seeds(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` words from each place on, at the places that have as many."""
    if len(codes) < SEED:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - SEED + 1, np.uint64)
    for k in range(SEED):
        h = (h ^ codes[k : k + len(h)].astype(np.uint64)) * ODD
        h ^= h >> np.uint64(31)
    return h


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``octave, start, places, codes``: rows of neighbouring tiles of a document that can hold a run.

    octave: P. start: the number of the first word of ``codes``. places: grid places inside ``codes`` to be solved. A place is left out only if no four
    words from it stand again P to 2 * P - 1 words on.
    """
    h, n = seeds(codes), len(codes)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    again = np.zeros(len(h), bool)
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    again[order[same]] = again[order[same + 1]] = True
    if not len(same):
        return
    group = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
    of = np.empty(len(h), np.int64)
    of[order] = group
    keys = group * n + order  # rising: places stand in order inside a group
    octave = 1
    while FOLD * octave <= max(n, SHORTEST):
        grid = np.arange(0, len(h), octave)
        grid = grid[again[grid]]
        near = np.searchsorted(keys, of[grid] * n + grid + octave)
        found = keys[np.minimum(near, len(keys) - 1)]
        grid = grid[(near < len(keys)) & (found < of[grid] * n + np.minimum(grid + 2 * octave, n))]
        if len(grid):
            for places in np.split(grid, np.flatnonzero((np.diff(grid) > 4 * octave) | (np.diff(grid // max(SPAN, octave)) > 0)) + 1):
                start = max(0, places[0] - octave)
                yield octave, start, places - start, codes[start : places[-1] + 3 * octave + SEED]
        octave *= 2


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on are those at the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(octave: int, places: list[int], codes: list[int]) -> list[tuple[int, int, int]]:
    """``period, low, high`` of each stretch low <= i < high with codes[i] == codes[i + period] that the tiles around ``places`` show."""
    done, open_ = [], {}
    for c in places:
        right = codes[c : c + 3 * octave + SEED]
        ahead = z_function(right)
        back = codes[max(0, c - octave) : c][::-1]
        behind = None
        for q in range(octave, min(2 * octave, len(right))):
            if ahead[q] < SEED:
                continue
            if behind is None:  # words before the place, read backwards from it and from each word after it
                behind = z_function([*back, -1, *right[: 2 * octave][::-1], *back])
            low, high = c - behind[len(back) + 1 + min(2 * octave, len(right)) - q], c + ahead[q]
            if q in open_ and low <= open_[q][1]:
                open_[q][1] = max(high, open_[q][1])
            else:
                if q in open_:
                    done.append((q, *open_[q]))
                open_[q] = [low, high]
    return done + [(q, low, high) for q, (low, high) in open_.items()]


def exploded(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, octave, start, places, codes``: the tiles of all documents. copy: a hash of the text."""
    schema = schema_with(docs, ("doc_id", "copy"), "octave int, start long, places array<int>, codes array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for rows, texts in runs(batches):
            of, out, held = [], [], 0
            ids = rows.column(0).to_pylist()

            def batch():
                columns = [rows.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)]
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

            for k, codes in enumerate(word_codes(texts)):
                for tile in tiles(codes[in_order(ids[k], len(codes))]):
                    of.append(k)
                    out.append((*tile[:2], tile[2].astype(np.int32), tile[3].astype(np.int32)))
                    held += len(tile[3])
                    if held > 4 * SPAN:
                        yield batch()
                        of, out, held = [], [], 0
            if out:
                yield batch()
        trim()

    return with_text(docs, "doc_id", "copy").mapInArrow(cut, schema)


def solved(rows: DataFrame) -> DataFrame:
    """``doc_id, copy, period, low, high``: the fragments that each row of tiles shows, by itself."""
    schema = schema_with(rows, ("doc_id", "copy"), "period long, low long, high long")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                octave, start, places, codes = (batch.column(i)[k].as_py() for i in range(2, 6))
                found = [(q, start + a, start + b) for q, a, b in fragments(octave, places, codes)]
                if found:
                    keep = [batch.column(i).take(pa.array([k] * len(found))) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=schema.names)
        trim()

    return rows.mapInArrow(solve, schema)


def stitched(found: DataFrame) -> DataFrame:
    """``doc_id, copy, start, length, period`` of every run: touching fragments of a document and period are one stretch, long stretches are runs, and
    of stretches of the same words the one of smallest period counts."""
    key = ["doc_id", "copy", "period"]
    order = W.partitionBy(*key).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = found.withColumn("new", (F.col("low") > F.coalesce(reach, F.lit(-1))).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = parts.groupBy(*key, "part").agg(F.min("low").alias("start"), (F.max("high") - F.min("low") + F.col("period")).alias("length"))
    long = whole.where(F.col("length") >= F.greatest(F.lit(SHORTEST), FOLD * F.col("period")))
    return long.groupBy("doc_id", "copy", "start", "length").agg(F.min("period").alias("period"))


def digest(doc_id: int | None, text: bytes, found: list[tuple[int, int, int]]) -> tuple:
    """``n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of one document, found: its runs ``start, period, length``."""
    words = text.split()
    change = order_after(doc_id, len(words))
    if change:
        words = [words[k] for k in in_order(doc_id, len(words)).tolist()]
    top, best = None, hashlib.sha256()
    kept = np.ones(len(words), bool)
    for start, period, length in sorted(found):
        best.update(b"%d,%d,%d\n" % (start, length, period))
        kept[start + period : start + length] = False
        if top is None or length * top[2] > top[1] * period:
            top = start, length, period
    if found:
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    milli = None if top is None else 1000 * top[1] // top[2]
    return len(found), *(top or (None, None, None)), milli, best.hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def text_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text, copy``; copy tells texts of one id apart."""
    return docs.select("doc_id", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("copy"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, start, length, period`` of all maximal runs of all documents (numbers of words), each once for rows that are equal in id and text."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiles are small beside their work, so that their bytes must not tell the number of tasks
    rows = exploded(text_key(docs)).repartition(tasks, F.xxhash64("doc_id", "copy", "octave", "start"))
    return durable(stitched(solved(rows)))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the number of its runs, the one of greatest exponent, and digests of all runs and of the text without repetitions.

    Words are what ASCII white space parts. Null and empty texts have no words and no runs. A null doc_id is kept, and its words stay in
    their order. Equal rows get equal results; other columns are not looked at. A table without rows gives none.
    """
    named, found = text_key(docs), periodic_runs(docs)
    lists = found.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "period", "length")).alias("_runs"))
    lists = F.broadcast(lists) if found.count() <= FEW else lists.hint("merge")
    same = named["doc_id"].eqNullSafe(F.col("_id")) & (named["copy"] == F.col("_copy"))
    joined = named.join(lists.toDF("_id", "_copy", "_runs"), same, "left")
    schema = schema_with(docs, ("doc_id",), "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for rows, texts in runs(batches):
            lists = rows.column(1).to_pylist()
            found = [[(r["start"], r["period"], r["length"]) for r in x or ()] for x in lists]
            out = [digest(i, t.as_py(), f) for i, t, f in zip(rows.column(0).to_pylist(), texts, found, strict=True)]
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *made], names=schema.names)
        trim()

    return with_text(joined, "doc_id", "_runs").mapInArrow(measure, schema)
