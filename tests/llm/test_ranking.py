"""Ranked lexical search against SQL on the given tables, and against a plain scoring of all rows."""

import math
import re

import duckdb
import pytest

from skyledger.llm import ranking as R
from skyledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, m long, bag string, h string", "item_id long, text string, term string"


def split(text):
    lower = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, most=20):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        for i, words in held:
            m = 75 + (25 * len(words) * n) // total
            s = 0
            for t in split(text):
                tf, df = words.count(t), sum(t in w for _, w in held)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return out


def test_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(c.execute(R.SEARCH_SQL).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op12_lexical_search"](spark, SF).collect())
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("step", [2048, 3])
def test_equals_brute_force(spark, monkeypatch, step):
    """Groups of copies larger than a ranking, ties, nulls, repeated rows, other alphabets, and items in several passes."""
    monkeypatch.setattr(R, "SCORED", step)
    if step == 3:
        monkeypatch.setattr(R, "BLOCK_TERMS", 5)
        monkeypatch.setattr(R, "FEW_BYTES", 0)
    docs = [(k, "the Cat sat") for k in range(100, 40, -1)] + [(k, f"the dog {'ran ' * (k % 4)}far. É{k % 3} naïve_cat") for k in range(30)]
    docs += [(None, "the cat sat"), (None, None), (200, None), (201, ""), (202, "... --"), (7, docs[7][1]), (203, "zebra\x00zebra " * 500), (204, "the the the the cat")]
    items = [(1, "The cat"), (2, "naïve É1 dog"), (3, "zebra zebra the"), (4, None), (5, "nowhere"), (6, ""), (8, "ran ran far")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS)
    it = spark.createDataFrame([(i, t, "z") for i, t in [*items, items[0]]], ITEMS)
    got = sorted((tuple(r) for r in R.lexical_search(df, it).collect()), key=lambda r: r[:2])
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "cat", 1, "x", "y")], DOCS), spark.createDataFrame([(1, "cat", "z")], ITEMS)
    assert R.lexical_search(docs, items).collect() == [] and R.lexical_search(docs, some[1]).collect() == [] and R.lexical_search(some[0], items).collect() == []
