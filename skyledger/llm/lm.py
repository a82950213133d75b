"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation, over exact corpus counts.

A word is predicted in two steps: its unit, and the word inside the unit. Units are the end, the most frequent
words, and classes of all other words by their last bytes. The log-bilinear model gives the units' probabilities from
the two units before; inside a class, words follow their counts. All training texts are read: the
numbers of all runs of three units (a table whose size is bounded by the units, not the corpus) are what the
model is trained on, every one with its whole weight, and word counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import crc32_mod, durable, release, schema_with, slices, trim, with_text

#: Units that are words (the end among them) and classes (the last is for all other endings).
WORD_UNITS, CLASSES = 96, 32
UNITS = WORD_UNITS + CLASSES
#: Words whose counts every task holds; the rest are looked up by a join.
HEAD_WORDS = 131_072
#: A class is told by so many last bytes.
ENDING = 3
#: The end is counted as a word that no text has.
END = b""
ALPHA = 0.1


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """``word binary, n``: words are counted in the task (in bounded tables), then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for _, found in slices(batches):
            held[END] += len(found)
            for t in found:
                held.update(t.lower().split())
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def endings(counts: DataFrame, units: set[bytes]) -> DataFrame:
    """``ending, n, v``: tokens and distinct words of each ending, but for words that are units."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = Counter(), Counter()
        for b in batches:
            for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in units:
                    n[w[-ENDING:]] += k
                    v[w[-ENDING:]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([v[e] for e in n], pa.int64())], names=["ending", "n", "v"])

    return counts.mapInArrow(cut, "ending binary, n long, v long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


class Vocabulary:
    """Word counts of the most frequent words, units, and what is needed inside classes."""

    def __init__(self, counts: DataFrame):
        facts = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
        self.tokens, self.distinct = facts.n or 0, facts.v or 0
        head = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toPandas()
        words, n = [bytes(w) for w in head["word"]], head["n"].to_numpy(np.int64)
        own = [END, *[w for w in words if w != END][: WORD_UNITS - 1]]
        by_ending = endings(counts, set(own)).orderBy(F.desc("n"), "ending")
        tops = by_ending.limit(CLASSES - 1).collect()
        rest = by_ending.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        self.classes = {bytes(r.ending): WORD_UNITS + k for k, r in enumerate(tops)}
        sizes = np.zeros((CLASSES, 2))
        sizes[: len(tops)] = [(r.n, r.v) for r in tops] if tops else 0
        sizes[-1] = (rest.n or 0) - sizes[:, 0].sum(), (rest.v or 0) - sizes[:, 1].sum()
        #: log10 of a class's total, in which one more word stands for all unknown ones
        self.class_log = np.log10(sizes[:, 0] + ALPHA * (sizes[:, 1] + 1))
        self.index = {w: k for k, w in enumerate(words)}
        self.log = np.log10(n + ALPHA) if len(n) else np.zeros(0)
        units = {w: k for k, w in enumerate(own)}
        self.unit = np.array([units[w] if w in units else self.class_of(w) for w in words], np.int64)
        self.end_log = float(np.log10((facts.ends or 0) + ALPHA))

    def class_of(self, word: bytes) -> int:
        return self.classes.get(word[-ENDING:], UNITS - 1)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head (-1: not there) and unit of each word."""
        at = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        unit = self.unit[at] if len(self.unit) else np.zeros(len(at), np.int64)
        away = np.flatnonzero(at < 0)
        unit[away] = [self.class_of(words[i]) for i in away]
        return at, unit


def contexts(unit: np.ndarray) -> np.ndarray:
    """Codes of (unit two before, unit before); before the start stands UNITS."""
    before = np.concatenate([[UNITS, UNITS], unit])
    return before[:-2] * (UNITS + 1) + before[1:-1]


def runs_of_three(texts: DataFrame, vocabulary) -> DataFrame:
    """``code, n``: how often each unit follows each context, over all texts."""
    size = (UNITS + 1) ** 2 * UNITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = vocabulary.value, np.zeros(size, np.int64)
        for _, found in slices(batches):
            codes = []
            for t in found:
                unit = np.append(known.read(t.lower().split())[1], 0)
                codes.append(contexts(unit) * UNITS + unit)
            total += np.bincount(np.concatenate(codes), minlength=size)
        seen = np.flatnonzero(total)
        for start in range(0, len(seen), 500_000):
            part = seen[start : start + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["code", "n"])

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class LogBilinear:
    """score(unit | context) = (C1 r1 + C2 r2) . q + b, with vectors r of the two context units and q of the unit.

    Trained by noise-contrastive estimation with every counted run and its whole weight: a step takes the loss of all contexts
    and units at once, each true unit by its count and each noise unit by its expected number, so that nothing is drawn, and the work depends on
    the units alone.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, dim: int = 32, steps: int = 300, noise: int = 24, rate: float = 0.05, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (2, UNITS + 1, dim)).astype(np.float32)
        self.c = np.stack([np.eye(dim), np.eye(dim)]).astype(np.float32)
        self.q = rng.normal(0, 0.1, (UNITS, dim)).astype(np.float32)
        base = np.bincount(code % UNITS, n, UNITS) + 1.0 if len(code) else np.ones(UNITS)
        base = base / base.sum()
        self.b = np.log(base).astype(np.float32)
        if not len(code):
            return
        context, unit = np.divmod(code, UNITS)
        seen, row = np.unique(context, return_inverse=True)  # contexts that occur
        real = np.zeros((len(seen), UNITS), np.float32)
        np.add.at(real, (row, unit), n / n.sum())
        fake = noise * real.sum(1, keepdims=True) * base.astype(np.float32)
        two, one = np.divmod(seen, UNITS + 1)
        shift, names = np.log(noise * base).astype(np.float32), ["r", "c", "q", "b"]
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for step in range(1, steps + 1):
            grads = self.gradient(two, one, real, fake, shift)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in names:  # Adam
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                getattr(self, k)[...] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def gradient(self, two: np.ndarray, one: np.ndarray, real: np.ndarray, fake: np.ndarray, shift: np.ndarray, rows: int = 4096) -> dict:
        """Of the loss -sum(real log p + fake log(1 - p)), where p = sigmoid(score - shift) says that a unit is no noise."""
        out = {k: np.zeros_like(getattr(self, k)) for k in ("r", "c", "q", "b")}
        sums = np.zeros_like(self.r)
        for at in range(0, len(one), rows):  # blocks of contexts bound the memory
            o, t = one[at : at + rows], two[at : at + rows]
            r1, r2 = self.r[0][o], self.r[1][t]
            h = r1 @ self.c[0] + r2 @ self.c[1]
            p = 1 / (1 + np.exp(-np.clip(h @ self.q.T + self.b - shift, -30, 30)))
            d = p * (real[at : at + rows] + fake[at : at + rows]) - real[at : at + rows]
            dh = d @ self.q
            out["q"] += d.T @ h
            out["b"] += d.sum(0)
            out["c"] += np.stack([r1.T @ dh, r2.T @ dh])
            for k, index in ((0, o), (1, t)):
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.diff(index[order], prepend=-1))
                sums[k][index[order][starts]] += np.add.reduceat(dh[order], starts)
        out["r"] = np.stack([sums[k] @ self.c[k].T for k in (0, 1)])
        return out

    def table(self) -> np.ndarray:
        """Normalised log10 probabilities, contexts x units, by one batched matrix product."""
        one, two = self.r[0] @ self.c[0], self.r[1] @ self.c[1]
        h = (two[:, None, :] + one[None, :, :]).reshape(-1, one.shape[1])
        s = h @ self.q.T + self.b
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        return (s / np.log(10)).astype(np.float32)


def score_texts(texts: DataFrame, vocabulary, model, *keep: str) -> DataFrame:
    """For each row: tokens, those in the head, the sum of their base logs, the sum of the model's unit logs,
    and words that are not in the head with their counts."""
    schema = schema_with(texts, keep, "n_tokens long, n_head long, head_log double, unit_log double, away array<struct<word:binary,n:long>>")
    away_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = vocabulary.value, model.value.table()
        for rows, found in slices(batches):
            out = []
            for t in found:
                words = t.lower().split()
                at, unit = known.read(words)
                unit = np.append(unit, 0)
                logs = float(table[contexts(unit), unit].sum(dtype=np.float64))
                logs -= float(known.class_log[unit[unit >= WORD_UNITS] - WORD_UNITS].sum())
                inside = at >= 0
                word_logs = known.log[at[inside]] if len(known.log) else np.zeros(0)
                classed = float(word_logs[unit[:-1][inside] >= WORD_UNITS].sum())
                away = Counter(words[i] for i in np.flatnonzero(~inside))
                out.append((len(words) + 1, int(inside.sum()), float(word_logs.sum()) + known.end_log, logs + classed, [{"word": w, "n": k} for w, k in away.items()]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), away_type]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], "n_tokens", "n_head", "head_log", "unit_log", "away"])
        trim()

    return texts.mapInArrow(score, schema)


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null or empty text is the end alone. The model learns from rows whose crc32(doc_id) modulo 10 is not 0; a null
    doc_id counts as the empty text there. Repeated rows are learnt from and scored each. Without rows
    to learn from, all words are unknown and units keep equal probabilities.
    """
    context = docs.sparkSession.sparkContext
    marked = docs.withColumn("held_out", crc32_mod(F.col("doc_id"), 10) == 0)
    learning = with_text(marked.where(~F.col("held_out")))
    counts = durable(word_counts(learning))
    known = Vocabulary(counts)
    vocabulary = context.broadcast(known)  # at most HEAD_WORDS words
    runs = runs_of_three(learning, vocabulary).toPandas()  # at most (UNITS + 1) ** 2 * UNITS rows
    runs = runs.sort_values("code")
    model = context.broadcast(LogBilinear(runs["code"].to_numpy(np.int64), runs["n"].to_numpy(np.float64)))
    scored = score_texts(with_text(marked, "doc_id", "held_out"), vocabulary, model, "doc_id", "held_out")
    scored = durable(scored.withColumn("rid", F.monotonically_increasing_id()))
    away = scored.select("rid", F.explode("away").alias("w")).select("rid", "w.word", F.col("w.n").alias("times"))
    # words outside the head are rare, so this join has no hot key
    looked = away.join(counts, "word", "left").groupBy("rid").agg(
        F.sum("times").alias("n_away"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).alias("away_log"),
    )
    whole = np.log10(known.tokens + ALPHA * (known.distinct + 1))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = scored.drop("away").join(looked, "rid", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + value("found") + (1 if known.tokens else 0)).cast("long").alias("n_known"),
        F.lit(int(known.tokens)).cast("long").alias("train_tokens"),
        (F.col("head_log") + value("away_log") - F.col("n_tokens") * float(whole)).alias("base_score"),
        (F.col("unit_log") + value("away_log")).alias("score"),
    )
