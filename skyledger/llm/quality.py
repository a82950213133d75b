"""Quality rules: rule statistics of whole texts, and an isolation forest over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import durable, release, schema_with, slices, with_text

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further statistics that only the forest sees.
MORE = ["n_upper", "n_marks", "n_pipes", "n_digits", "n_lines", "n_distinct"]


def repeated_words(words: list, window: int = 3) -> tuple[int, int]:
    """Words that lie in a window found twice or more, and the number of distinct words."""
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(ids) < window + 1:
        return 0, len(index)
    codes, n = ids[: len(ids) - window + 1].copy(), len(index)
    for k in range(1, window):
        codes = codes * n + ids[k : len(ids) - window + 1 + k]
        if k + 1 < window and n**3 > 2**62:  # keep codes small in texts of millions of distinct words
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(codes, kind="stable")
    same = np.diff(codes[order]) == 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum()), len(index)


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()  # on bytes: space, \t, \n, \v, \f, \r alone
    chars = text.decode("utf-8", "replace")
    blanks = sum(chars.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats, distinct = repeated_words(words)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words),
        len(chars) - blanks,
        sum(chars.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeats,
        upper,
        chars.count("!") + chars.count("?"),
        chars.count("|"),
        len(text) - len(text.translate(None, b"0123456789")),
        len(lines),
        distinct,
    )


def rule_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics of each row's whole text; a null text has none of anything."""
    names = [*BASE, *MORE]
    schema = schema_with(docs, keep, ", ".join(f"{n} long" for n in names))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows, texts in slices(batches):
            columns = zip(*map(statistics, texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*rows.schema.names[:-1], *names]
            )

    return with_text(docs, *keep).mapInArrow(measure, schema)


def rates(s: pd.DataFrame) -> np.ndarray:
    """The forest's view of the statistics: rates that do not follow a text's length, but for the last."""
    words = np.maximum(s["n_words"].to_numpy(float), 1)
    chars = np.maximum(s["word_chars"].to_numpy(float), 1)
    lines = np.maximum(s["n_lines"].to_numpy(float), 1)
    by = {"n_symbols": chars, "n_dup_lines": lines, "n_repeat_words": words, "n_upper": chars, "n_marks": words, "n_pipes": words, "n_digits": chars}
    columns = [s[n].to_numpy(float) / d for n, d in by.items()]
    spread = s["n_distinct"].to_numpy(float) / words**0.85
    return np.stack([*columns, s["word_chars"].to_numpy(float) / words, spread, np.log1p(words)], 1)


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``feature, threshold, path`` of one tree (see ``IsolationForest``)."""
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, path = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, rows, 0, low, high)]
    while todo:
        i, part, level, low, high = todo.pop()
        wide = np.flatnonzero(high > low)
        if level == depth or len(part) <= 1 or not len(wide):
            path[i] = level + expected_path(len(part))
            continue
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        left = part[:, f] <= cut
        feature[i], threshold[i] = f, cut
        inner, outer = high.copy(), low.copy()
        inner[f] = outer[f] = cut
        todo += [(2 * i + 1, part[left], level + 1, low, inner), (2 * i + 2, part[~left], level + 1, outer, high)]
    return feature, threshold, path


class IsolationForest:
    """Random splits over small samples of usual rows; rows with short paths are easy to isolate.

    Splits are drawn over a box that holds all rows seen, usual or not, and halves of it further down: where
    usual rows all have one value (no symbols, say) a split beside it still sends unusual rows into an
    empty leaf near the root. A tree is flat arrays in level order: feature (-1 in a leaf), threshold, and path (depth
    plus the expected rest in a leaf); the children of node i are 2i+1 and 2i+2.
    """

    def __init__(self, usual: np.ndarray, seen: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.low, self.high = np.quantile(seen, 0.002, axis=0), np.quantile(seen, 0.998, axis=0)
        usual = np.clip(usual, self.low, self.high)
        self.sample = min(sample, len(usual))
        self.depth = max(1, math.ceil(math.log2(max(2, self.sample))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.threshold, self.path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            chosen = usual[rng.choice(len(usual), self.sample, replace=False)]
            self.feature[t], self.threshold[t], self.path[t] = grow(chosen, self.low, self.high, self.depth, rng)

    @classmethod
    def of(cls, trees: pd.DataFrame, low: np.ndarray, high: np.ndarray, depth: int) -> IsolationForest:
        """A forest of trees that were grown elsewhere: ``size, feature, threshold, path``."""
        self = cls.__new__(cls)
        self.low, self.high, self.depth, self.sample = low, high, depth, round(trees["size"].mean())
        self.feature = np.stack(trees["feature"].to_numpy()).astype(np.int16)
        self.threshold, self.path = np.stack(trees["threshold"].to_numpy()), np.stack(trees["path"].to_numpy())
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, below 0.5 for usual rows."""
        rows = np.clip(rows, self.low, self.high)
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, path in zip(self.feature, self.threshold, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = rows[at, np.maximum(f, 0)] > threshold[node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(expected_path(self.sample), 1e-9))


def best_cut(score: np.ndarray, good: np.ndarray, keep_share: float, times: np.ndarray | None = None) -> float:
    """The threshold, among those that keep ``keep_share`` of the good rows, with the best mean of both classes' accuracy; of equal ones the least.
    times: how many rows have a score."""
    times = np.ones(len(score), np.int64) if times is None else times
    cuts, at = np.unique(score, return_inverse=True)
    kept, missed = (np.cumsum(np.bincount(at[which], times[which], len(cuts))) for which in (good, ~good))
    value = kept / kept[-1] - missed / max(1, missed[-1])
    enough = kept > math.ceil(keep_share * (kept[-1] - 1) - 1e-9)
    return float(cuts[enough][np.argmax(value[enough])])


def edges(rows: DataFrame, low: float = 0.002, high: float = 0.998) -> tuple[np.ndarray, np.ndarray]:
    """Two quantiles of each rate over all rows, to three digits: rates are counted by so many digits, a short list at any size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part, power = np.frexp(rates(b))
            x = np.ldexp(np.round(part * 1024) / 1024, power)
            for k in range(x.shape[1]):
                value, n = np.unique(x[:, k], return_counts=True)
                yield pd.DataFrame({"k": np.full(len(value), k), "value": value, "n": n})

    counted = rows.mapInPandas(count, "k int, value double, n long").groupBy("k", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "value"])
    of = [g for _, g in counted.groupby("k")]
    at = lambda g, q: g["value"].to_numpy()[np.searchsorted(np.cumsum(g["n"].to_numpy()), q * (g["n"].sum() - 1), "right")]
    return np.array([at(g, low) for g in of]), np.array([at(g, high) for g in of])


def grow_forest(usual: DataFrame, count: int, low: np.ndarray, high: np.ndarray, trees: int = 200, least: int = 256, seed: int = 7) -> IsolationForest:
    """A forest in which each of the ``count`` usual rows is in one tree; in several, if there are too few for ``least`` rows a tree.

    usual: ``order`` (a hash) and the statistics. A task grows a tree from its rows, of which it has a share of one in ``trees`` or ``least``; splits end at
    the depth of ``least`` rows, so that the forest does not grow with the rows.
    """
    depth = max(1, math.ceil(math.log2(max(2, min(least, count)))))
    several = min(trees, math.ceil(trees * least / count))
    dealt = usual.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(several - 1)))).withColumn("tree", F.pmod(F.pmod("order", F.lit(trees)) + F.col("tree"), F.lit(trees)).cast("int"))

    def plant(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", *BASE, *MORE])
        rows = np.clip(rates(part), low, high)
        return pd.DataFrame([(key[0], len(part), *grow(rows, low, high, depth, np.random.default_rng((seed, key[0]))))], columns=["tree", "size", "feature", "threshold", "path"])

    grown = dealt.groupBy("tree").applyInPandas(plant, "tree int, size long, feature array<short>, threshold array<double>, path array<double>")
    return IsolationForest.of(grown.toPandas().sort_values("tree"), low, high, depth)


#: Thresholds are multiples of one part in so many.
GRID = 100_000


def fit_forest(docs: DataFrame, labels: DataFrame, keep_share: float = 0.998):
    """Forest and threshold from all labelled rows; rows of one id count once.

    The forest learns from good ones that pass the base rules, and the threshold from others: one half of the rows, by a hash, is kept from the
    forest, unless there are too few for both. The threshold separates its rows best (by the mean of both
    classes' accuracy) among those that keep at least ``keep_share`` of the good ones. Without good
    rows there is no forest: None, and no threshold. The driver sees counts and trees, whose number does not follow the rows.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rule_statistics(docs, "doc_id").where(~base_failed()).join(labels, "doc_id")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *BASE, *MORE)).alias("r"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    known = durable(once.select(F.xxhash64("doc_id").alias("order"), half.alias("learns"), (F.col("r.quality") == 1).alias("good"), *(f"r.{n}" for n in [*BASE, *MORE])))
    n = known.agg(F.count_if("good").alias("good"), F.count_if(F.col("good") & F.col("learns")).alias("learns")).first()
    if n.good < 8:
        return None, math.inf
    both = min(n.learns, n.good - n.learns) >= 256
    learns, judges = (known.where("learns"), known.where("not learns")) if both else (known, known)
    low, high = edges(learns)
    forest = grow_forest(learns.where("good"), n.learns if both else n.good, low, high)
    place = F.ceil(anomaly_score(forest)(F.struct(*BASE, *MORE)) * GRID)
    scores = judges.groupBy(place.alias("place"), "good").count().toPandas()  # GRID bounds it
    return forest, best_cut(scores["place"].to_numpy(float) / GRID, scores["good"].to_numpy(bool), keep_share, scores["count"].to_numpy())


def base_failed():
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def anomaly_score(forest: IsolationForest | None):
    """The forest's score as a function of a struct of the statistics."""

    @F.pandas_udf("double")
    def anomaly(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(rates(columns)) if forest else np.zeros(len(columns)))

    return anomaly


def judge(stats: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    """Add ``base_failed, anomaly, kept``."""
    scored = stats.withColumn("anomaly", anomaly_score(forest)(F.struct(*BASE, *MORE)))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Statistics and verdict of every row, with the kept columns.

    A null or empty text has no words and fails the base rule. Every row is judged by itself, so
    repeated rows get equal verdicts. Without usable labels the base rules decide alone.
    """
    forest, threshold = fit_forest(docs, labels)
    return judge(rule_statistics(docs, *(keep or ("doc_id",))), forest, threshold)
