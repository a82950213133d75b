"""One visit to each file, and what follows from it; ingestion in which a broken file fails alone."""

import hashlib
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyledger.operators.catalog import admission_errors
from skyledger.sources import audit as A
from skyledger.sources import delivery as D
from skyledger.streaming.incremental import file_status, ingest_run


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("delivery") / "it's one"
    (root / "night=1").mkdir(parents=True)
    pq.write_table(pa.table({"id": [1, 2, None], "band": ["g", None, None], "meta": [{"a": 1}, None, {"a": 2}]}), root / "night=1" / "a.parquet", row_group_size=2)
    pq.write_table(pa.table({"id": ["x"], "flux": [1.5]}), root / "b.parquet")
    pq.write_table(pa.table({"id": pa.array([], pa.int64()), "band": pa.array([], pa.string())}), root / "empty.parquet")
    (root / "broken.parquet").write_bytes(b"PAR1 nothing PAR1")
    (root / "none.parquet").write_bytes(b"")
    (root / "list.json").write_text('[{"b": 1, "a": [1]}, {"c": 2}]')
    (root / "dict.json").write_text('{"z": {"y": 1},\n "a": 2}')
    (root / "number.json").write_text("42")
    (root / "bad.json").write_text("{")
    (root / "no.json").write_text("[]")
    (root / "lines.jsonl").write_text('{"q": 1, "p": 2}\n\n{"r": 1}\n')
    return root


def test_each_file_is_opened_once(folder):
    opens = []

    def counted(path):
        opens.append(path)
        return pa.OSFile(path)

    for p in sorted(folder.rglob("*.parquet")):
        got = A.visit_file(str(p), True, counted, block=7)
        assert got["readable"] == (p.stem not in ("broken", "none")) and (got["error"] is None) == got["readable"]
        if got["readable"]:
            assert got["sha256"] == hashlib.sha256(p.read_bytes()).hexdigest() and got["rows"] == pq.read_metadata(p).num_rows
    assert len(opens) == len(set(opens)) == 5


def test_audits_of_one_visit(spark, folder):
    files = D.discover(spark, str(folder), "*.parquet").unionByName(D.empty_files(spark, str(folder), "*.parquet"))
    visits = A.visit(files).persist()
    facts = A.delivery_facts(visits).first()
    assert (facts.files, facts.readable, facts.unreadable, facts.rows, facts.schema_groups, facts.tiny) == (5, 3, 2, 4, 3, 4)
    union = {r.column: (r.types, r.files, r.missing_files, r.nested, r.conflict, r.nulls) for r in A.column_union(visits).collect()}
    assert union == {
        "id": ("int64 | string", 3, 0, False, True, 1), "band": ("string", 2, 1, False, False, 2), "flux": ("double", 1, 2, False, False, 0),
        "meta": ("struct<a: int64>", 1, 2, True, False, None),
    }
    assert sorted((r.column, r.type, r.files) for r in A.type_conflicts(visits).collect()) == [("id", "int64", 2), ("id", "string", 1)]
    other = visits.withColumn("sha256", F.when(F.col("path").endswith("b.parquet"), "changed").otherwise(F.col("sha256")))
    assert A.delivery_facts(other).first().root != facts.root and A.delivery_facts(visits.limit(0)).first().files == 0
    visits.unpersist()


def test_json_shapes(spark, folder):
    got = {Path(r.path).name: (r.shape, r.rows, r["columns"]) for r in A.json_shapes(spark, str(folder)).collect()}
    assert got == {
        "list.json": ("list", 2, "a,b"), "dict.json": ("dict", 1, "a,z"), "number.json": ("bigint", 1, None), "bad.json": ("invalid", 0, None), "no.json": ("list", 0, None),
        "lines.jsonl": ("jsonl", 2, "p,q"),
    }


def test_pinned_files_only(spark, tmp_path):
    good = {"diaSourceId": [1], "diaObjectId": [5], "midpointMjdTai": [60000.0], "pred": [{"is_sso": False}]}
    for k, table in enumerate([good, good | {"diaSourceId": [2]}, good | {"diaObjectId": ["5"]}]):
        (tmp_path / f"night={k}").mkdir()
        pq.write_table(pa.table(table), tmp_path / f"night={k}" / f"f{k}.parquet")
    visits = A.visit(D.discover(spark, str(tmp_path), "*.parquet")).persist()
    visits.count()
    pq.write_table(pa.table(good | {"diaSourceId": [3]}), tmp_path / "later.parquet")
    scan, report = A.pinned(spark, visits, admission_errors, lambda df: df.select("diaSourceId", "_file"))
    assert sorted((r.diaSourceId, r._file) for r in scan.collect()) == [(1, "f0.parquet"), (2, "f1.parquet")]
    assert sorted((r.files, r.admitted, r.errors) for r in report.collect()) == [(1, False, "diaObjectId: string"), (2, True, "")]
    assert A.pinned(spark, visits, lambda s: ["no"], lambda df: df)[0] is None
    visits.unpersist()


def states(spark, out, run):
    return {Path(r.path).name: (r.status, r.rows, r.errors, r.warnings) for r in file_status(spark, out).where(F.col("run") == run).collect()}


def test_broken_files_fail_alone(spark, tmp_path):
    """A text, a lost column, a damaged page behind a good footer: one row each, and no row of theirs in the table."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    rows = lambda k, n: pa.table({"id": list(range(k, k + n)), "name": [f"name {i} " * 20 for i in range(k, k + n)]})
    pq.write_table(rows(0, 10), root / "good.parquet")
    pq.write_table(rows(10, 5).append_column("more", pa.array([1] * 5)), root / "wide.parquet")
    pq.write_table(rows(20, 5).drop_columns("name"), root / "narrow.parquet")
    pq.write_table(rows(30, 5).drop_columns("id"), root / "lost.parquet")
    (root / "text.parquet").write_text("id,name")
    pq.write_table(rows(40, 2000), root / "page.parquet", compression="snappy")
    whole = bytearray((root / "page.parquet").read_bytes())
    whole[40:4000] = bytes(3960)
    (root / "page.parquet").write_bytes(whole)
    schema = spark.createDataFrame([], "id long, name string").schema
    tables = lambda df: {"named": df.where("name is not null"), "all": df}
    run = lambda name: ingest_run(spark, str(root), out, schema, tables, name, required=["id"], files_per_batch=3).awaitTermination()
    run("one")
    got = states(spark, out, "one")
    assert got["good.parquet"] == ("completed", 10, [], []) and got["wide.parquet"] == ("completed", 5, [], ["columns are not kept: more"])
    assert got["narrow.parquet"] == ("completed", 5, [], ["optional columns are null: name"]) and got["lost.parquet"][2] == ["missing columns: id"]
    assert {k for k, v in got.items() if v[0] == "failed"} == {"lost.parquet", "text.parquet", "page.parquet"}
    assert all(v[1] is None and v[2] for v in got.values() if v[0] == "failed") and "of 2000 rows" in got["page.parquet"][2][0]
    read = lambda name: sorted(r.id for r in spark.read.schema("id long, name string").option("recursiveFileLookup", True).parquet(f"{out}/{name}").collect())
    assert read("all") == [*range(15), *range(20, 25)] and read("named") == list(range(15))
    run("one")  # a run that is over has nothing to do
    assert states(spark, out, "one") == got and read("all") == [*range(15), *range(20, 25)]
    pq.write_table(rows(40, 3), root / "page.parquet")
    run("two")
    got = states(spark, out, "two")
    assert {k: v[0] for k, v in got.items()} == {
        "good.parquet": "skipped_completed", "wide.parquet": "skipped_completed", "narrow.parquet": "skipped_completed", "lost.parquet": "failed", "text.parquet": "failed",
        "page.parquet": "completed",
    }
    assert read("all") == [*range(15), *range(20, 25), 40, 41, 42]
    assert json.dumps(sorted(p.name for p in (tmp_path / "out" / "_staging").iterdir())) == "[]"


def test_parts_cut_in_files_by_many_tasks(spark, tmp_path):
    """Each part in as few files as its rows need, and more than one task writes it."""
    from pyspark.sql import functions as F

    from skyledger.plans.delivery_queries import cut_in_files

    rows = spark.range(2345).select("id", (F.col("id") % 2).alias("part"))
    dealt = cut_in_files(rows, "part", "id", 10, files=3)
    dealt.write.option("maxRecordsPerFile", 10).partitionBy("part").parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").select("id").distinct().count() == 2345
    assert sorted(len(list((tmp_path / "out" / f"part={k}").glob("*.parquet"))) for k in range(2)) == [118, 118]
