"""Token counts of whole texts with a public tokenizer file.

Arrow functions return lengths only. A byte-level BPE first cuts a text by a pattern in which no
piece runs from a visible character into following white space, so a text may be cut there:
``[white space][visible run]`` units give the same tokens alone as in place. Long texts are
therefore never handed over whole, and each distinct unit is encoded once for as long as a
bounded cache holds it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import CACHES, slices, with_text

#: Unicode White_Space, as the tokenizer's patterns see it (Python's own class has four more).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Units that a worker's cache may hold, and the longest unit kept.
CACHE_UNITS, CACHE_CHARS = 250_000, 64


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LengthCache:
    """Lengths of units; kept by the Python worker from task to task."""

    def __init__(self, path: str):
        self.tokenizer, self.lengths = load(path), {}

    @classmethod
    def of(cls, path: str) -> LengthCache:
        if ("lengths", path) not in CACHES:
            CACHES["lengths", path] = cls(path)
        return CACHES["lengths", path]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.lengths) > CACHE_UNITS:  # the units met first are the frequent ones
            self.lengths = dict(islice(self.lengths.items(), CACHE_UNITS // 2))
        units = [UNIT.findall(t) for t in texts]
        missing = list(set().union(*units).difference(self.lengths)) if units else []
        encoded = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        fresh = {u: len(e) for u, e in zip(missing, encoded, strict=True)}
        self.lengths.update((u, n) for u, n in fresh.items() if len(u) <= CACHE_CHARS)
        rare = {u: n for u, n in fresh.items() if len(u) > CACHE_CHARS}
        get = self.lengths.__getitem__
        return [sum(map(get, u)) if not rare else sum(rare[x] if x in rare else get(x) for x in u) for u in units]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null doc_id stays
    null; other columns are not read. No shuffle: tasks are file splits of equal bytes, and inside
    them batches are cut by bytes.
    """
    schema = "doc_id long, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = LengthCache.of(tokenizer_path)
        for rows, texts in slices(batches):
            n = cache.counts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
