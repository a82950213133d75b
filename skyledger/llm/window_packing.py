"""Packing by non-negative least squares: shallow combinations of lengths fill windows, and what is left is packed greedily."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import durable, runs, schema_with, trim, with_text
from skyledger.llm.packing import GROUP_PIECES, RUN_BYTES, OpenBins, WordIds

#: Steps in which a window's lengths are counted, and pieces of a combination at most.
STEPS, DEPTH = 64, 4
#: A window is made of up to DEPTH smaller ones, so that short documents fill it too: each level's windows are pieces of the next.
LEVELS = 3
#: A sequence that lacks more than this share of its capacity is poured out, and its tokens fill others.
MOST_PADDING = 1 / 512
#: Texts whose ids may be broadcast (about 100 bytes each).
FEW = 500_000


def measured(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, copy, start, length, ids_crc32, doc_tokens``: each document's ids and then ``end_id``, by windows of ``capacity`` and what is left of it.

    copy: a hash of the text, by which it is found again if what is left has to be cut.
    """
    schema = schema_with(docs, ("doc_id", "copy"), "start long, length long, ids_crc32 long, doc_tokens long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds.of(tokenizer_path), np.array([end_id], "<u4")
        for rows, ids, edges in encoded(batches, coder):
            of, out = [], []
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                own = np.append(ids[a:b], end).astype("<u4")
                for at in range(0, len(own), capacity):
                    part = own[at : at + capacity]
                    of.append(k)
                    out.append((at, len(part), zlib.crc32(part), len(own)))
            keep = [rows.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=schema.names)
        trim()

    return with_text(docs, "doc_id", "copy").mapInArrow(cut, schema)


def encoded(batches: Iterator[pa.RecordBatch], coder: WordIds) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int]]]:
    """Runs of rows with the ids of their texts in one array, and where each text's ids start and end."""
    for rows, texts in runs(batches, most=RUN_BYTES):
        if len(texts) == 1 and len(texts[0].as_py()) > RUN_BYTES:
            ids = coder.encode_long(texts[0].as_py())
            edges = [0, len(ids)]
        else:
            ids, edges = coder.encode(texts)
            edges = edges.tolist()
        yield rows, ids.astype("<u4"), edges


@functools.cache
def combinations(steps: int = STEPS, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All falling tuples of up to ``depth`` lengths that fill ``steps``, and a matrix of how often each (a column) has each length (a row)."""
    out, todo = [], [((), steps)]
    while todo:
        parts, room = todo.pop()
        if not room:
            out.append(parts)
        elif len(parts) < depth:
            most = min(room, parts[-1] if parts else steps)
            least = -(-room // (depth - len(parts)))
            todo += [((*parts, k), room - k) for k in range(least, most + 1)]
    out.sort(reverse=True)
    matrix = np.zeros((steps, len(out)))
    for k, parts in enumerate(out):
        for p in parts:
            matrix[p - 1, k] += 1
    return out, matrix


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 4 * STEPS) -> np.ndarray:
    """The x of least \\|ax - b\\| with no negative entry, by active sets; any x on the way has none either, so that the bound on rounds costs fit alone."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        used[best] = True
        while used.any():
            s = np.zeros_like(x)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (s <= 0)
            if not low.any():
                x = s
                break
            x += np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)) * (s - x)
            used &= x > 1e-12
            x[~used] = 0
    return x


class Stock:
    """Pieces by length; takes away the longest that fits, in nearly constant time."""

    def __init__(self, lengths: list[int], most: int):
        self.items: list[list[int]] = [[] for _ in range(most + 1)]
        for i, n in enumerate(lengths):
            if n <= most:
                self.items[n].append(i)
        self.below = [n if self.items[n] or not n else n - 1 for n in range(most + 1)]

    def longest(self, most: int) -> int:
        """The greatest length up to ``most`` that is in stock, or 0."""
        n, below = most, self.below
        while below[n] != n:
            n = below[n]
        while below[most] != n:
            below[most], most = n, below[most]
        return n

    def take(self, n: int) -> int:
        item = self.items[n].pop()
        if not self.items[n]:
            self.below[n] = n - 1
        return item


def fill(lengths: list[int], window: int) -> tuple[list[list[int]], list[int]]:
    """Windows filled by combinations of pieces (numbers in ``lengths``, at most a step of room each), and the pieces left.

    The histogram of lengths, in steps of the window, is met by repeat counts of combinations in the least-squares sense, weighted by
    tokens; counts are rounded, and each repeat takes real pieces: the longest of each step, and at last the longest that fits.
    """
    step, stock = window // STEPS, Stock(lengths, window)
    parts, matrix = combinations()
    here = np.array([n for n in lengths if n <= window], np.int64)
    weight = np.arange(1, STEPS + 1.0)
    repeats = np.rint(least_squares(matrix * weight[:, None], np.bincount(-(-here // step) - 1, minlength=STEPS) * weight)).astype(int)
    full, taken = [], np.zeros(len(lengths), bool)
    for k in np.flatnonzero(repeats).tolist():
        for _ in range(repeats[k]):
            room, own = window, []
            for p in parts[k][:-1]:
                n = stock.longest(min(room, p * step))
                if n <= (p - 1) * step:
                    break
                own.append(stock.take(n))
                room -= n
            n = stock.longest(room)
            if len(own) < len(parts[k]) - 1 or not n or room - n > step:
                for i in own:
                    stock.items[lengths[i]].append(i)
                    stock.below[lengths[i]] = lengths[i]
                break
            own.append(stock.take(n))
            taken[own] = True
            full.append(own)
    return full, np.flatnonzero(~taken).tolist()


def poured(tails: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences ``piece, from, length`` without padding: pieces ``number, length`` one after the other, cut at the capacity, and at last at powers of two."""
    total = sum(n for _, n in tails)
    sizes = [capacity] * (total // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if total % capacity >> k & 1]
    out, rest = [], iter(tails)
    piece, at, n = -1, 0, 0
    for size in sizes:
        own = []
        while size:
            if at == n:
                (piece, n), at = next(rest), 0
            part = min(size, n - at)
            own.append((piece, at, part))
            at, size = at + part, size - part
        out.append(own)
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences ``piece, from, length`` of pieces no longer than ``capacity``, a power of two of at least STEPS * DEPTH ** (LEVELS - 1)."""
    held = [[i] for i in range(len(lengths))]
    sizes = list(lengths)
    for level in reversed(range(LEVELS)):
        full, left = fill(sizes, capacity // DEPTH**level)
        held = [[i for k in own for i in held[k]] for own in full] + [held[k] for k in left]
        sizes = [sum(sizes[k] for k in own) for own in full] + [sizes[k] for k in left]
    tree, bins = OpenBins(capacity), []
    for k in sorted(range(len(held)), key=lambda k: -sizes[k]):  # full windows come first and leave their room to the rest
        room, b = tree.take(sizes[k]) or (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b] += held[k]
        if room > sizes[k]:
            tree.put(room - sizes[k], b)
    total = [sum(lengths[i] for i in own) for own in bins]
    good = [capacity - n <= capacity * MOST_PADDING or not n & (n - 1) for n in total]
    out = [[(i, 0, lengths[i]) for i in own] for own, ok in zip(bins, good, strict=True) if ok]
    return out + poured([(i, lengths[i]) for own, ok in zip(bins, good, strict=True) if not ok for i in own], capacity)


def pack_group(rows: pa.Table, capacity: int, names: list[str]) -> pa.Table:
    """The pieces of one group with their sequences; ``ids_crc32`` is null where a piece was cut."""
    lengths, starts, crcs = (rows.column(c).to_pylist() for c in ("length", "start", "ids_crc32"))
    order = np.lexsort([rows.column(c).to_numpy() for c in ("doc_tokens", "ids_crc32", "length")]).tolist()
    prefix = rows.column("pack_group")[0].as_py() << 32
    out = []
    for s, own in enumerate(pack_lengths([lengths[k] for k in order], capacity)):
        offset = 0
        for i, at, n in own:
            k = order[i]
            out.append((k, starts[k] + at, n, crcs[k] if n == lengths[k] else None, prefix + s, offset))
            offset += n
    of, start, length, crc, sequence, offsets = zip(*out, strict=True)
    keep = rows.select(["doc_id", "copy", "doc_tokens"]).take(pa.array(of))
    made = [pa.array(c, pa.int64()) for c in (start, length, crc, sequence, offsets)]
    return pa.Table.from_arrays([*keep.columns, *made], names=names)


def pieces_crc(docs: DataFrame, cut: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``copy, start, length, crc`` of pieces ``copy, start, length``: the texts that were cut are encoded once more, each once."""
    wanted = durable(cut.groupBy("copy").agg(F.collect_set(F.struct("start", "length")).alias("wanted")))
    wanted = F.broadcast(wanted) if cut.count() <= FEW else wanted.hint("merge")
    texts = docs.select("copy", "text").join(wanted, "copy").groupBy("copy").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    schema = "copy string, start long, length long, crc long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds.of(tokenizer_path), np.array([end_id], "<u4")
        for rows, ids, edges in encoded(batches, coder):
            out = []
            for copy, asked, a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), edges, edges[1:], strict=False):
                own = np.append(ids[a:b], end).astype("<u4")
                out += [(copy, w["start"], w["length"], zlib.crc32(own[w["start"] : w["start"] + w["length"]])) for w in asked]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["copy", "start", "length", "crc"])
        trim()

    return with_text(texts, "copy", "wanted").mapInArrow(measure, schema)


def pack_windows(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: every id of every document in just one piece of a sequence.

    Windows of ``capacity`` ids of a long document are sequences of their own. What is left of documents is dealt by hash into groups of about ``group_pieces``; each
    group is packed by itself, whole documents where they fill sequences up to a few tokens, and else cut. A null or empty text is the end id alone. Equal rows are packed each, a null doc_id is
    kept, other columns are not looked at, and a table without rows gives none.
    """
    named = docs.select("doc_id", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("copy"))
    parts = durable(measured(named, tokenizer_path, capacity, end_id))
    full = parts.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    tails = parts.where(F.col("length") < capacity)
    groups = max(1, -(-tails.count() // group_pieces))
    group = F.pmod(F.xxhash64("doc_id", "copy", F.monotonically_increasing_id()), F.lit(groups))
    schema = schema_with(named, ("doc_id", "copy"), "doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    dealt = tails.withColumn("pack_group", group).groupBy("pack_group")
    placed = durable(dealt.applyInArrow(lambda rows: pack_group(rows, capacity, schema.names), schema))
    cut = placed.where("ids_crc32 is null")
    crcs = durable(pieces_crc(named, cut.select("copy", "start", "length"), tokenizer_path, end_id))
    crcs = F.broadcast(crcs) if crcs.count() <= FEW else crcs.hint("merge")
    mended = cut.join(crcs, ["copy", "start", "length"]).withColumn("ids_crc32", F.col("crc"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*names).unionByName(placed.where("ids_crc32 is not null").select(*names)).unionByName(mended.select(*names))
