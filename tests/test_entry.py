"""The driver's entry points."""

import __spark_entry__ as entry


def test_names_and_oracles_agree():
    names = set(entry.queries())
    assert len(names) > 120 and set(entry.oracle_sql()) <= names


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["acquisition_id", "source_rows"] and df.count() == 2


def test_nothing_else_needs_the_corpus_operators():
    import re
    from pathlib import Path

    import skyledger

    root = Path(skyledger.__file__).parent
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert not re.search(r"skyledger\.llm|corpus_pipeline", path.read_text()), path
