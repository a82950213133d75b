"""Approximate maximum-inner-product search with score-aware (anisotropic) four-bit quantisation.

A row's quantisation error parallel to the row changes its high scores more than an orthogonal
error does, so both the choice of codes and the codebooks weigh it more. Every row is indexed: its
cell (nearest coarse centre) and a four-bit code for each pair of dimensions. A query scans the codes of
the cells it probes by table look-ups, and those of each chunk whose codes leave it open that they are among the best are
scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import durable

#: Rows that fit the index on the driver; rows and queries that meet in one task.
FIT_ROWS, CHUNK_ROWS, QUERY_ROWS = 12_000, 8_192, 2_048
#: Queries with which the number of cells to probe is measured.
MEASURED = 300
#: Cells grow with the rows up to this many, for which the fit rows are enough.
MOST_CELLS = FIT_ROWS // 16
#: Candidates of a chunk that are scored exactly, at least so many times the wanted number; and all whose score by tables is below the
#: wanted-th exact one by no more than so many times what their quantisation errors give if their signs are random.
RERANK, SAFE = 12, 3.0


class Index:
    """Coarse centres, codebooks (subspace x 16 x 2) and the number of cells to probe."""

    def __init__(self, rows: np.ndarray, cells: int, wanted: int, threshold: float = 0.2, recall: float = 0.98, seed: int = 3, asked: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.dim = rows.shape[1]
        pad = self.dim % 2
        self.parts = (self.dim + pad) // 2
        self.weight = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))  # of parallel error; orthogonal: 1
        self.centres = self.cluster(rows, min(cells, len(rows)), rng)
        self.probes = self.measure(rows, wanted, recall, rng, asked)
        rest, unit = self.split(rows)
        books = [self.cluster(rest[:, m], min(16, len(rest)), rng, 8) for m in range(self.parts)]
        self.books = np.stack([np.pad(b, ((0, 16 - len(b)), (0, 0)), mode="edge") for b in books])
        for _ in range(3):
            codes = self.assign(rest, unit)
            self.refit(rest, unit, codes)

    @staticmethod
    def cluster(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
        centres = x[rng.choice(len(x), k, replace=False)].astype(float)
        for _ in range(rounds):
            near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        return centres

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * x @ self.centres.T, 1)

    def measure(self, rows: np.ndarray, wanted: int, recall: float, rng, asked: np.ndarray | None) -> int:
        """Cells a query must probe so that they hold ``recall`` of true neighbours, measured on the fit rows with queries
        (``asked``; without: fit rows), which may be of another kind than the rows.
        Clustered data need few; data without structure need nearly all."""
        if len(self.centres) == 1:
            return 1
        asked = rows if asked is None or not len(asked) else asked
        asked = asked[rng.choice(len(asked), min(300, len(asked)), replace=False)]
        scores = asked @ rows.T
        scores[(asked[:, :1] == rows[:, 0]) & (np.abs(scores - (asked**2).sum(1)[:, None]) <= 1e-12 * np.abs(scores))] = -np.inf  # itself
        best = np.argpartition(-scores, min(wanted, len(rows) - 1) - 1, 1)[:, :wanted]
        order = np.argsort(-(asked @ self.centres.T), 1)
        rank = np.argsort(order, 1)
        found = np.take_along_axis(rank, self.cell(rows)[best], 1)
        return int(np.quantile(found, recall, method="higher")) + 1

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and unit vectors by subspace: rows x parts x 2."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        pad = [(0, 0), (0, self.dim % 2)]
        shape = (len(x), self.parts, 2)
        return np.pad(x - self.centres[self.cell(x)], pad).reshape(shape), np.pad(unit, pad).reshape(shape)

    def assign(self, rest: np.ndarray, unit: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on orthogonal plus weighted parallel error."""
        near = [((rest[:, m, None] - self.books[m]) ** 2).sum(2) for m in range(self.parts)]
        along = [np.einsum("nd,nkd->nk", unit[:, m], rest[:, m, None] - self.books[m]) for m in range(self.parts)]
        codes, at = np.stack([n.argmin(1) for n in near], 1), np.arange(len(rest))
        error = sum(along[m][at, codes[:, m]] for m in range(self.parts))
        for _ in range(rounds):
            for m in range(self.parts):
                others = error - along[m][at, codes[:, m]]
                codes[:, m] = (near[m] + (self.weight - 1) * (others[:, None] + along[m]) ** 2).argmin(1)
                error = others + along[m][at, codes[:, m]]
        return codes

    def refit(self, rest: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword in turn to the least loss of its rows: a 2 x 2 linear system."""
        at, extra = np.arange(len(rest)), self.weight - 1
        error = sum(np.einsum("nd,nd->n", unit[:, m], rest[:, m] - self.books[m][codes[:, m]]) for m in range(self.parts))
        for m in range(self.parts):
            u, x, c = unit[:, m], rest[:, m], codes[:, m]
            own = np.einsum("nd,nd->n", u, x - self.books[m][c])
            goal = np.einsum("nd,nd->n", u, x) + (error - own)
            for k in np.unique(c):
                s = at[c == k]
                left = len(s) * np.eye(2) + extra * u[s].T @ u[s]
                self.books[m][k] = np.linalg.solve(left, x[s].sum(0) + extra * (u[s] * goal[s, None]).sum(0))
            error = error - own + np.einsum("nd,nd->n", u, x - self.books[m][c])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and codes packed two to a byte."""
        codes = self.assign(*self.split(x)).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, self.parts % 2)))
        return self.cell(x), codes[:, ::2] << 4 | codes[:, 1::2]

    def missed(self, cell: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """rows x parts: squared lengths of what the codes of a cell's rows leave out."""
        rest = np.pad(x - self.centres[cell], [(0, 0), (0, self.dim % 2)])
        single = np.stack([codes >> 4, codes & 15], 2).reshape(len(codes), -1)
        return np.stack([((rest[:, 2 * m : 2 * m + 2] - self.books[m][single[:, m]]) ** 2).sum(1) for m in range(self.parts)], 1)

    def error(self, q: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """queries x rows: how far a score by tables is likely to be off."""
        parts = (np.pad(q, ((0, 0), (0, self.dim % 2))).reshape(len(q), self.parts, 2) ** 2).sum(2)
        return np.sqrt(parts @ missed.T)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the inner product with what a byte's two codes stand for."""
        q = np.pad(q, ((0, 0), (0, self.dim % 2))).reshape(len(q), self.parts, 2)
        one = np.einsum("qmd,mkd->qmk", q, self.books)
        one = np.pad(one, ((0, 0), (0, self.parts % 2), (0, 0)))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, 256)


def copies(ids: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each different row; where its ids start; and the ids, of copies the ``most`` least ones. ids rise.
    More copies than are wanted can't be among the nearest, and would crowd out other rows when candidates are chosen."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    sizes = np.bincount(group.ravel())
    starts = np.cumsum(sizes) - sizes
    kept = np.arange(len(ids)) - np.repeat(starts, sizes) < most
    return first, np.append(0, np.cumsum(np.minimum(sizes, most))), ids[order][kept]


def search(index: Index, cell: int, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, wanted: int) -> list[tuple]:
    """The best ``wanted`` of a chunk (in order of id) for each query: different rows are scanned by tables, and those that
    may be among the best for all that their codes tell are scored exactly. Where codes tell little (near copies, few large components) these are many."""
    first, starts, own_ids = copies(ids, rows, wanted + 1)
    codes, rows, out = codes[first], rows[first], []
    most = min(len(first), RERANK * wanted + 1)
    missed, longest = index.missed(cell, rows, codes), np.sqrt((rows**2).sum(1).max())
    for start in range(0, len(asked), 32):
        q = queries[start : start + 32]
        tables, base = index.tables(q), q @ index.centres[cell]
        scores = np.zeros((len(q), len(first)))
        for j in range(codes.shape[1]):
            scores += tables[:, j][:, codes[:, j]]
        edge = np.partition(scores, len(first) - most, 1)[:, len(first) - most]
        highest = scores + SAFE * index.error(q, missed)
        for k in range(len(q)):
            chosen = scores[k] >= edge[k]  # with all rows of one code: near copies tie there
            slack = 1e-12 * longest * np.sqrt((q[k] ** 2).sum())
            # the query's own row may be one of the first wanted + 1 different ones
            least = lambda x: np.partition(x, len(x) - wanted - 1)[len(x) - wanted - 1] - slack if len(x) > wanted else -np.inf
            chosen |= highest[k] >= least(rows[chosen] @ q[k]) - base[k]
            chosen = np.flatnonzero(chosen)
            exact = rows[chosen] @ q[k]
            chosen = chosen[exact >= least(exact)]
            exact = (rows[chosen] * q[k]).sum(1)
            found = np.concatenate([own_ids[starts[c] : starts[c + 1]] for c in chosen])
            score = np.repeat(exact, starts[chosen + 1] - starts[chosen])
            score, found = score[found != asked[start + k]], found[found != asked[start + k]]
            best = np.lexsort((found, -score))[:wanted]
            out += zip([asked[start + k]] * len(best), found[best], score[best], strict=True)
    return out


def stacked(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of doubles."""
    return np.stack(vectors.to_numpy()).astype(np.float64)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, v``: one row for each id (of several vectors the least), without those that take no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = rows.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(fine)
    floats = rows.schema[vector].dataType.elementType.simpleString() == "float"  # kept so where they came so: half the bytes, and no digit less
    v = F.col(vector) if floats else F.col(vector).cast("array<double>")
    return kept.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def nearest(rows: DataFrame, wanted: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``wanted`` rows of largest inner product.

    Null, zero and non-finite vectors, vectors of another than the commonest length and rows without an id
    take no part. Rows with one id count once. Score ties go to smaller ids. Fewer candidates than
    ``wanted``: all of them. Rows of a cell are dealt into chunks and its queries into blocks, so that copies of
    one vector never fill a task.
    """
    held = durable(usable(rows, id_column, vector))
    lengths = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return held.sparkSession.createDataFrame([], schema)
    held = held.where(F.size("v") == lengths.n)
    kind = held.schema["v"].dataType.simpleString()
    sample = stacked(held.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()["v"])
    n = lengths["count"]
    sample = np.unique(sample, axis=0)  # copies of one vector must not draw the codebooks to it
    asked = held.where(F.col("id") % every == 0)
    probing = asked.orderBy(F.xxhash64("id"), "id").limit(MEASURED).toPandas()["v"]
    index = Index(sample, max(1, min(MOST_CELLS, n // CHUNK_ROWS)), wanted, asked=stacked(probing) if len(probing) else None)

    def encode(batches):
        for b in batches:
            cell, codes = index.encode(stacked(b["v"]))
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    coded = durable(held.mapInPandas(encode, f"id long, v {kind}, cell int, codes binary"))
    sizes = {r.cell: r["count"] for r in coded.groupBy("cell").count().collect()}  # a row a cell
    chunks = {c: -(-k // CHUNK_ROWS) for c, k in sizes.items()}

    def probe(batches):
        for b in batches:
            order = np.argsort(-(stacked(b["v"]) @ index.centres.T), 1)[:, : index.probes]
            for start in range(0, len(b), 1000):
                part = order[start : start + 1000]
                i = np.repeat(np.arange(start, start + len(part)), part.shape[1])
                yield pd.DataFrame({"id": b["id"].to_numpy()[i], "v": b["v"].to_numpy()[i], "cell": part.ravel().astype(np.int32)})

    probed = durable(asked.mapInPandas(probe, f"id long, v {kind}, cell int"))
    # queries of a cell are dealt into blocks; rows of a cell meet its own blocks alone, and none where no query looks
    blocks = {r.cell: -(-r["count"] // QUERY_ROWS) for r in probed.groupBy("cell").count().collect()}  # a row a cell
    of_cell = lambda values, other: F.element_at(F.array(*(F.lit(values.get(c, other)) for c in range(len(index.centres)))), F.col("cell") + 1)
    chunk = F.pmod(F.xxhash64("id"), of_cell(chunks, 1)).cast("int")
    left = coded.withColumn("chunk", chunk).withColumn("blocks", of_cell(blocks, 0)).where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = probed.withColumn("block", F.pmod(F.xxhash64("id"), of_cell(blocks, 1)).cast("int")).withColumn("chunks", of_cell(chunks, 0)).where("chunks > 0")
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("id", "v", "cell", F.lit(None).cast("binary").alias("codes"), "chunk", "block")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        is_row = pdf["codes"].notna().to_numpy()
        r, q = pdf[is_row].sort_values("id"), pdf[~is_row].sort_values("id")
        out = []
        if len(r) and len(q):
            codes = np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(len(r), -1)
            out = search(index, int(r["cell"].iloc[0]), r["id"].to_numpy(), codes, stacked(r["v"]), q["id"].to_numpy(), stacked(q["v"]), wanted)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = left.unionByName(right).groupBy("cell", "chunk", "block").applyInPandas(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(f"rank <= {wanted}").select("query_id", "rank", "vec_id", "score")
