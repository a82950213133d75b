"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import crc32_mod, durable, release, schema_with, slices, with_text

FEATURES = [
    "seed_hits", "seed_density", "word_hits", "word_density", "word_weight", "stem_hits", "stem_density", "stem_weight",
    "distinct_hits", "second_person", "near_second_person", "upper_share", "shouted_share", "mark_share", "punctuation_share", "obfuscated_share", "log_words",
]
#: Plain English insults that need no labels.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool jerk".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
#: The lexicon keeps at most so many words and stems; a stem is a word's first letters.
LEXICON_WORDS, STEM = 4096, 5
#: Documents of each kind that trees and calibration need to learn apart.
FEW = 50
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~\"'«»“”¡¿…"


def normal(word: str) -> tuple[str, bool]:
    """A lower-case word without punctuation at its edges, with digits and signs inside read as the
    letters they stand for; and whether there were such signs beside letters."""
    core = word.strip(EDGE)
    if core.isalpha():
        return core.lower(), False
    plain = re.sub(r"[.\-_*]", "", core.translate(LEET)).lower()
    hidden = plain.isalpha() and any(c.isalpha() for c in core) and bool(re.search(r"\w[0-9@$!*._-]+\w", core))
    return (plain if hidden else core.lower()), hidden


def word_support(docs: DataFrame) -> DataFrame:
    """``term, toxic, clean``: in how many labelled documents of each kind a word or a stem (marked by
    a leading ``^``) occurs. docs: ``toxic, text``. Counts are merged in the task and then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for toxic, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                words = {normal(w)[0] for w in set(text.decode("utf-8", "replace").split())}
                found[toxic == 1].update(words)
                found[toxic == 1].update({"^" + w[:STEM] for w in words if len(w) >= STEM})
            terms = list(found[True].keys() | found[False].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([found[k][t] for t in terms], pa.int64()) for k in (True, False))],
                names=["term", "toxic", "clean"],
            )

    return docs.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame) -> dict[str, float]:
    """Terms whose odds of standing in toxic documents are high, with the log of the odds ratio.

    Support comes from all labelled training rows; the lexicon's size is bounded.
    """
    size = docs.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("c")).first()
    if not size.t or not size.c:
        return {}
    least = 2 if size.t < 200 else 5
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(size.t) + 1.0)) - F.log((F.col("clean") + 0.5) / (F.lit(size.c) + 1.0))
    best = word_support(docs).where(F.col("toxic") >= least).withColumn("weight", odds).where("weight > 2")
    top = best.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(LEXICON_WORDS)
    return {r.term: float(r.weight) for r in top.select("term", "weight").collect()}


class WordMarks:
    """What the lexicons say about a word as it is written: None for a word that counts for nothing,
    else (seed, word weight, stem weight, second person, masked, shouted). Kept for one task, in a bounded cache."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.most, self.seen = lexicon, most, {}

    def of(self, raw: str) -> tuple | None:
        w, masked = normal(raw)
        stem = self.lexicon.get("^" + w[:STEM], 0.0) if len(w) >= STEM else 0.0
        marks = (w in SEEDS, self.lexicon.get(w, 0.0), stem, w in SECOND, masked, len(raw) > 2 and raw.isupper(), w)
        return marks if any(marks[:-1]) else None

    def all(self, words: list[str]) -> list[tuple | None]:
        if len(self.seen) > self.most:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = self.of(w)
        return list(map(self.seen.__getitem__, words))


def features(text: bytes, marks: WordMarks) -> tuple[float, ...]:
    chars = text.decode("utf-8", "replace")
    words = chars.split()
    n = max(1, len(words))
    seeds = hits = stems = shouted = hidden = second = near = 0
    weight = stem_weight = 0.0
    distinct, last_you, last_hit = set(), -99, -99
    for i, found in enumerate(marks.all(words)):
        if found is None:
            continue
        seed, x, s, you, masked, loud, w = found
        hidden += masked
        shouted += loud
        if you:
            second += 1
            last_you = i
        if seed or x or s:
            seeds += seed
            hits += x > 0
            stems += s > 0
            weight += x
            stem_weight += s
            distinct.add(w)
            last_hit = i
        near += (last_you == i or last_hit == i) and abs(last_you - last_hit) <= 4
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    exclaimed = chars.count("!") + chars.count("?")
    points = len(text) - len(text.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    m = max(1, len(chars))
    return (
        float(seeds), seeds / n, float(hits), hits / n, weight, float(stems), stems / n, stem_weight,
        float(len(distinct)), second / n, near / n, upper / m, shouted / n, exclaimed / n, points / m, hidden / n, math.log1p(len(words)),
    )


def with_features(docs: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The kept columns and ``FEATURES``, from whole texts."""
    schema = schema_with(docs, keep, ", ".join(f"{n} double" for n in FEATURES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        marks = WordMarks(lexicon)
        for rows, texts in slices(batches):
            columns = zip(*(features(t, marks) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], *(pa.array(c, pa.float64()) for c in columns)], names=[*rows.schema.names[:-1], *FEATURES]
            )

    return with_text(docs, *keep).mapInArrow(measure, schema)


def vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(df).drop(*FEATURES)


class ToxicityModel:
    """Lexicon, trees and calibration. Labels of documents whose crc32(doc_id) is 0 modulo 5 are never
    looked at; 1 and 2 give the lexicon, 3 the trees and 4 the calibration, so that each sees documents
    from which those before it did not learn. With fewer than ``FEW`` documents of a kind in 3 or 4, both learn from both."""

    def __init__(self, docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, fit_rows: int = 150_000):
        """fit_rows: at most so many labelled documents (those of least hash: an even, repeatable choice)
        are learnt from. The bound is what makes the broadcast of their labels safe at any size."""
        known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        known = known.withColumn("part", crc32_mod(F.col("doc_id"), 5)).where("part > 0")
        known = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
        rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
        learning = with_text(rows.where("part <= 2"), "toxic")
        self.lexicon = learn_lexicon(learning)
        fit = durable(with_features(rows.where("part >= 3"), self.lexicon, "toxic", "part"))
        counts = {(r.toxic, r.part): r["count"] for r in fit.groupBy("toxic", "part").count().collect()}
        self.share = sum(n for (toxic, _), n in counts.items() if toxic == 1) / max(1, sum(counts.values()))
        self.trees = self.calibration = None
        if 0 < self.share < 1:
            apart = all(counts.get((toxic, part), 0) >= FEW for toxic in (0, 1) for part in (3, 4))
            data = vectors(fit).withColumn("label", F.col("toxic").cast("double")).select("vector", "label", "part")
            learner = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=7)
            learnt = (data.where("part = 3") if apart else data).select("vector", "label").repartition(6).cache()
            self.trees = learner.fit(learnt)
            learnt.unpersist()
            raised = self.trees.transform(data.where("part = 4") if apart else data).select(vector_to_array("probability")[1].alias("raw"), "label")
            # equal raw scores are one row with a weight, so that they don't meet in one task
            merged = raised.groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
            self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="level").fit(merged)

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and ``score, predicted``. The calibrated level leads; the trees' own order
        parts rows of one level."""
        measured = with_features(docs, self.lexicon, *keep)
        if self.trees is None:
            scored = measured.withColumn("score", F.lit(float(self.share)))
        else:
            raw = self.trees.transform(vectors(measured)).withColumn("raw", vector_to_array("probability")[1])
            scored = self.calibration.transform(raw).withColumn("score", 0.99 * F.col("level") + 0.01 * F.col("raw"))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*keep, "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Features come from the text alone. A null or empty text has zero features and gets the score
    that those have. Equal texts score alike; repeated rows are scored each; a null doc_id counts as
    the empty text in the fold. Without labels of both kinds the score is the share of toxic labels.
    """
    model = ToxicityModel(docs, labels)
    scored = model.score(docs.withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 0), "doc_id", "held_out")
    return scored.select("doc_id", "held_out", "score", "predicted")
