"""A corpus pipeline: quality rules, toxicity, near-duplicates, mixing and packing, in that order.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the
last return the columns of documents. ``run`` writes every stage to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import durable, table
from skyledger.llm.mixing import mix
from skyledger.llm.near_dedup import keep_one
from skyledger.llm.packing import pack_documents
from skyledger.llm.quality import quality_rules
from skyledger.llm.queries import tokenizer
from skyledger.llm.toxicity import ToxicityModel


def rows(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row beside it, so that columns of any name pass through."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(rows(docs), table(spark, sf_dir, "labels"), "_row").where("kept").select("_row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = ToxicityModel(docs, table(spark, sf_dir, "labels"))
    return model.score(rows(docs), "_row").where("predicted = 0").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    mixed = mix(rows(docs), "_row")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mixture),
    ("best_fit_packing", packing),
]
#: The stages learn models, so SQL cannot express the rows; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
