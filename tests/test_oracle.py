"""Every registered query with an oracle gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from skyledger.plans import ORACLE, QUERIES
from skyledger.plans.delivery_queries import AT

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or (not isinstance(x, str) and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(x)[:10] if hasattr(x, "isoformat") else str(x)
    return sorted((tuple(cell(x) for x in row) for row in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert list(got.columns)
        return
    want = duck.execute(ORACLE[name].replace(AT, SF)).df()
    assert sorted(got.columns) == sorted(want.columns)
    kinds = lambda df: {c: df[c].dtype.kind for c in df.columns if df[c].dtype.kind in "ifb" and not df[c].isna().any()}
    if len(got):
        assert {c: k for c, k in kinds(got).items() if c in kinds(want)} == {c: k for c, k in kinds(want).items() if c in kinds(got)}
    assert canonical(got) == canonical(want)
