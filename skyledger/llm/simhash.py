"""SimHash near-duplicates: fingerprints of whole texts, linked exactly with vantage-point trees.

A pair within k bits has, among k // 2 + 1 disjoint parts of the 64 bits, one in which it differs by
one bit at most. So there is one vantage-point tree for each part, over the Hamming distance of that
part: a node sends a fingerprint left if it lies within the node's radius of its vantage point.
Each fingerprint lives in one leaf (a shard) of each tree; as a query it also goes to the leaves that the
triangle bound cannot rule out, and only to those after its own, since a pair needs to meet once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import durable, release, schema_with, slices, tidy, trim, with_text
from skyledger.llm.components import components

#: Fingerprints that a leaf should hold, and how many of a leaf one task compares at most.
LEAF_ROWS, TILE_ROWS = 512, 16_384
#: Fingerprints that are brought to the driver to choose vantage points and radii.
TREE_SAMPLE = 50_000


def fingerprint(words: list[bytes], width: int, distinct: bool = False) -> int:
    """A bit is 1 if it is set in over half of the XXH64 (seed 42) of the shingles; no words: 0."""
    if not words:
        return 0
    if distinct:
        words = sorted(set(words))
    joined, counts, total = b" ".join(words), np.zeros(64, np.int64), 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    width = min(width, len(words))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True))
    h = xxhash.xxh64_intdigest
    for at in range(0, len(spans), 65_536):
        part = np.array([h(joined[a:b], 42) for a, b in spans[at : at + 65_536]], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, distinct: bool = False, *keep: str) -> DataFrame:
    """The kept columns and ``fp long``. Texts equal within a slice are hashed once."""
    keep = keep or ("doc_id",)
    schema = schema_with(docs, keep, "fp long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows, texts in slices(batches):
            of = {t: fingerprint(t.lower().split(), width, distinct) for t in set(texts)}  # bytes: A-Z and ASCII white space alone
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([of[t] for t in texts], pa.int64())], names=[*rows.schema.names[:-1], "fp"])
        trim()

    return with_text(docs, *keep).mapInArrow(measure, schema)


class VantageTree:
    """A vantage-point tree over the bits of ``mask``: flat arrays, children of node i are 2i+1, 2i+2.

    It is built from a sample; whatever the sample, routing by the triangle bound loses no pair.
    """

    def __init__(self, sample: np.ndarray, mask: int, reach: int, depth: int, rng: np.random.Generator):
        self.mask, self.reach, self.depth = np.uint64(mask), reach, depth
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.radius = np.full(2**depth - 1, 64, np.int64)  # a node that could not be split sends all left
        todo = [(0, np.unique(sample & self.mask))] if depth else []
        while todo:
            i, part = todo.pop()
            if len(part) < 2:
                continue
            best = None
            for v in rng.choice(part, min(6, len(part)), replace=False):
                inside = np.cumsum(np.bincount(np.bitwise_count(part ^ v), minlength=66))
                for m in range(64):
                    if 0 < inside[m] < len(part):
                        left = inside[m] * inside[min(65, m + reach)]
                        right = (len(part) - inside[m]) * (len(part) - (inside[m - reach] if m >= reach else 0))
                        if best is None or left + right < best[0]:
                            best = left + right, v, m
            if best is None:
                continue
            self.vantage[i], self.radius[i] = best[1], best[2]
            near = np.bitwise_count(part ^ best[1]) <= best[2]
            if 2 * i + 2 < len(self.vantage):
                todo += [(2 * i + 1, part[near]), (2 * i + 2, part[~near])]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home leaf of each fingerprint; then (row, leaf) of the later leaves that it must query."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[row] ^ self.vantage[node]) & self.mask).astype(np.int64)
            m = self.radius[node]
            left, right = d - self.reach <= m, d + self.reach > m
            is_left = d <= m
            row, home, node = (
                np.concatenate([row[left], row[right]]),
                np.concatenate([(home & is_left)[left], (home & ~is_left)[right]]),
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
            )
        own = np.empty(len(fps), np.int64)
        own[row[home]] = node[home]
        later = node > own[row]
        return own, row[later], node[later]


def forest(sample: np.ndarray, bits: int, rows: int, leaf_rows: int = LEAF_ROWS, seed: int = 5) -> list[VantageTree]:
    """One tree for each of ``bits // 2 + 1`` parts of the 64 bits, deep enough for leaves of ``leaf_rows``."""
    parts = bits // 2 + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    depth = max(0, min(16, int(np.ceil(np.log2(max(1, rows / leaf_rows))))))
    rng = np.random.default_rng(seed)
    return [VantageTree(sample, ((1 << b) - 1) ^ ((1 << a) - 1), bits // parts, depth, rng) for a, b in zip(edges, edges[1:], strict=False)]


def merge_links(fps: np.ndarray, rows: np.ndarray, columns: np.ndarray, bits: int, label: np.ndarray, edges: list) -> None:
    """Compare rows with columns (indices into fps) and join linked ones: adds an edge for each merge of
    two labels, so that edges span the linked sets and are never more than the fingerprints."""
    across = fps[columns]
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        near = np.bitwise_count(fps[part][:, None] ^ across[None, :]) <= bits
        for i in np.flatnonzero(near.sum(1) > 0):
            own = part[i]
            found = np.unique(label[columns[near[i]]])
            found = found[found != label[own]]
            if len(found):
                edges += [(fps[own], fps[x]) for x in found]
                label[np.isin(label, found)] = label[own]


def link_tile(rows: pa.Table, bits: int) -> pa.Table:
    """Spanning edges of one tile. Roles: 0 meets 0 and 1; 2 meets 3."""
    fps, role = rows["fp"].to_numpy().view(np.uint64), rows["role"].to_numpy()
    label, edges = np.arange(len(fps)), []
    at = [np.flatnonzero(role == r) for r in range(4)]
    for one, other in ((0, 0), (1, 0), (2, 3)):
        if len(at[one]) and len(at[other]):
            merge_links(fps, at[one], at[other], bits, label, edges)
    found = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


@tidy
def links(fps: DataFrame, bits: int, leaf_rows: int = LEAF_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``a, b`` that span, exactly, the sets linked at ``bits`` or fewer differing bits.

    fps: distinct ``fp``. Leaves with more than ``tile_rows`` homes or queries are cut into tiles, each
    compared by a task of its own, so that a clump of near copies fills no task.
    """
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy().view(np.uint64)
    trees = forest(sample, bits, n, leaf_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for start in range(0, len(own), 20_000):
                part = own[start : start + 20_000]
                for k, tree in enumerate(trees):
                    home, row, leaf = tree.route(part)
                    fp = np.concatenate([part, part[row]]).view(np.int64)
                    query = np.concatenate([np.zeros(len(part), bool), np.ones(len(row), bool)])
                    where = np.concatenate([home, leaf]) * 64 + k
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(fp), pa.array(query)], names=["leaf", "fp", "query"])

    routed = durable(fps.select("fp").mapInArrow(route, "leaf long, fp long, query boolean"))
    sizes = routed.groupBy("leaf").agg(F.count(F.when(~F.col("query"), 1)).alias("homes"), F.count(F.when(F.col("query"), 1)).alias("queries"))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / tile_rows)).cast("int")
    hot = durable(sizes.where(f"homes > {tile_rows} or queries > {tile_rows}").select("leaf", pieces("homes").alias("hs"), pieces("queries").alias("qs")))
    usual = routed.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "leaf", "left")
    block = F.pmod(F.xxhash64("fp"), F.when(F.col("query"), F.col("qs")).otherwise(F.col("hs"))).cast("int")
    pair = lambda tile, role: F.struct(tile.alias("tile"), role.cast("int").alias("role"))
    key = lambda kind, x, y: F.concat_ws("-", F.lit(kind), x, y)
    whole = F.array(pair(F.lit("all"), F.when(F.col("query"), 1).otherwise(0)))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    home = F.concat(
        F.transform(upto("hs"), lambda j: pair(key("h", F.least(j, block), F.greatest(j, block)), F.when(j == block, 0).when(j > block, 2).otherwise(3))),
        F.transform(upto("qs"), lambda c: pair(key("q", c, block), F.lit(2))),
    )
    query = F.transform(upto("hs"), lambda i: pair(key("q", block, i), F.lit(3)))
    tiles = F.when(F.col("hs").isNull(), whole).when(F.col("query"), query).otherwise(home)
    dealt = usual.select("leaf", "fp", F.explode(tiles).alias("t")).select("leaf", "fp", "t.tile", "t.role")
    return dealt.groupBy("leaf", "tile").applyInArrow(lambda rows: link_tile(rows, bits), "a long, b long").distinct()


def simhash_components(rows: DataFrame, bits: int = 4) -> DataFrame:
    """Add ``root``, a component's least fingerprint, and ``component_id`` to ``doc_id, fp, ...``: the least doc_id
    that links reach, itself included.

    Copies meet in their fingerprint before anything is compared. Null doc_ids join in but give no
    component its name, unless it has no other.
    """
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("fp"), bits))
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(roots, "root").select("fp", "root", "component_id"), "fp")


def simhash_near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    A null or empty text, or one of white space, has fingerprint zero and is linked like any other. Texts shorter
    than a shingle are one shingle. Repeated rows appear each, in one component. A table without rows gives none.
    """
    rows = durable(fingerprints(docs, width, False, "doc_id"))
    found = simhash_components(rows, bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
