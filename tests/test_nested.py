"""Nested values, documents of unknown shape, sealed logs, and tables written with a report, each against a plain walk."""

import base64
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import nested as N
from skyledger.operators import catalog as C
from skyledger.operators import documents as J
from skyledger.operators import sinks as S
from skyledger.sources.chain import MEMBERS, broken_entries, canonical
from skyledger.sources.delivery import discover

INNER = T.StructType([T.StructField("z", T.DoubleType()), T.StructField("b", T.BinaryType()), T.StructField("f", T.ArrayType(T.FloatType()))])
DEEP = T.ArrayType(T.MapType(T.IntegerType(), INNER))
NAN = float("nan")
ROWS = [
    ([{2: (NAN, b"ok", [1.5, NAN]), 1: (0.5, b"\xff\xfe", [])}, None, {}],), ([{7: None, 8: (float("-inf"), None, None)}],), (None,), ([],), ([{3: (1.0, b"", [None, float("inf")])}],),
]


def walk(x):
    """The same by hand: what JSON holds."""
    if isinstance(x, dict):
        return {str(k): walk(x[k]) for k in sorted(x)}
    if isinstance(x, tuple):
        return {n: walk(v) for n, v in sorted(zip("zbf", x, strict=True))}
    if isinstance(x, list):
        return [walk(v) for v in x]
    if isinstance(x, bytes):
        try:
            return x.decode()
        except UnicodeDecodeError:
            return base64.b64encode(x).decode()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def test_deep_values_equal_a_plain_walk(spark):
    df = spark.createDataFrame(ROWS, T.StructType([T.StructField("deep", DEEP)]))
    got = [r.j for r in df.select(N.stable_json(F.col("deep"), DEEP).alias("j")).collect()]
    want = [None if x is None else json.dumps(walk(x), separators=(",", ":")) for (x,) in ROWS]
    assert got == want
    counts = {(r.path, r.what): r["values"] for r in N.rewrite_counts(df).collect()}
    assert counts == {("deep[]{}.z", "nonfinite"): 2, ("deep[]{}.b", "bytes"): 3, ("deep[]{}.f[]", "nonfinite"): 2}
    assert N.safe_columns(df).columns == ["deep"] and N.rewrite_counts(df.limit(0)).where("values > 0").isEmpty() and N.rewrite_counts(spark.range(3)).isEmpty()


def test_scalars_as_stable_json(spark):
    df = spark.createDataFrame([("a\"b", 1, NAN, True), (None, None, 2.5, None)], "s string, n long, d double, o boolean")
    got = df.select(*(N.stable_json(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)).collect()
    assert [tuple(r) for r in got] == [('"a\\"b"', "1", None, "true"), (None, None, "2.5", None)]


def fields(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "doc string")
    return sorted((tuple(r) for r in J.schema_fields(df, "doc").drop("attributes").collect()), key=str)


def test_schema_documents_of_all_shapes(spark):
    assert fields(spark, {"fam": {"ra": {"type": "double", "doc": "right"}, "note": "text"}}) == [("note", "fam", None, "text"), ("ra", "fam", "double", "right")]
    assert fields(spark, {"ra": {"unit": "deg"}, "dec": "down", "n": 5, "none": None}) == [("dec", None, None, "down"), ("n", None, None, "5"), ("none", None, None, None), ("ra", None, None, None)]
    assert fields(spark, [{"name": "a", "type": "int"}, {"column": "b", "description": "bee"}, {"x": 1}, "c", 7]) == [("7", None, None, None), ("a", None, "int", None), ("b", None, None, "bee"), ("c", None, None, None), (None, None, None, None)]
    assert fields(spark, "{broken", "5", "[]", "{}") == []


def payload(spark, *docs):
    df = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs] + [(None,)], "t string")
    return [json.loads(r.j) for r in J.payload_values(df.coalesce(1), "t").select(F.to_json("row").alias("j")).collect()]


def test_payload_shapes(spark):
    a, b = {"x": 1}, {"x": 2}
    for shape in ([[a], [b]], [a, b], [{"data": [a]}, {"data": [b]}], {"data": {"rows": [a, b]}}, {"x": [1, 2]}, [{"data": {"items": [a, b]}}, {"data": None}]):
        assert payload(spark, shape) == [a, b], shape
    assert payload(spark, {"data": None, "items": [a]}) == payload(spark, a) == [a] and payload(spark, None, "no json", []) == [] and payload(spark, 5) == [{"value": 5}]
    assert payload(spark, {"a": [1, 2, 3], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": None}, {"a": 3, "b": None}]  # nothing is dropped
    assert payload(spark, {"a": [], "b": []}) == [] and payload(spark, {"data": [[1], [2]]}) == [[1], [2]] and payload(spark, {}) == [{}]
    rows = J.payload_rows(spark.createDataFrame([('{"a":[1,2,3],"b":["x"]}',)], "t string"), "t", "a long, b string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, None), (3, None)]


def log(states, evidence=None):
    out, before, state = [], None, None
    for k, to in enumerate(states):
        body = {"seq": k + 1, "at_utc": "t", "from": state, "to": to, "actor": "é", "reason": "", "evidence": evidence or {"b": [1, {"z": None, "a": "ü"}], "a": 1.5}, "prev_entry_sha256": before}
        before, state = hashlib.sha256(canonical(body).encode()).hexdigest(), to
        out.append(json.dumps(body | {"entry_sha256": before}, ensure_ascii=k % 2 == 0))
    return out


def problems(spark, lines):
    edges = spark.createDataFrame([(None, "new"), ("new", "busy"), ("busy", "done")], "from_state string, to_state string")
    df = spark.createDataFrame([("l", k + 1, x) for k, x in enumerate(lines)], "log string, number long, line string")
    return {r.number: r.problems for r in broken_entries(df, edges).collect()}


def test_a_changed_byte_anywhere_is_reported(spark):
    lines = log(["new", "busy", "done"])
    assert problems(spark, lines) == {} and sorted(json.loads(lines[0])) == sorted([*MEMBERS, "entry_sha256"])
    for name in MEMBERS:
        for k in range(3):
            entry = json.loads(lines[k])
            old = entry[name]
            entry[name] = old + 1 if isinstance(old, int) else {"b": [1, {"z": None, "a": "u"}], "a": 1.5} if isinstance(old, dict) else f"{old}x"
            assert "modified" in problems(spark, [*lines[:k], json.dumps(entry), *lines[k + 1 :]])[k + 1], name


def test_lost_swapped_and_false_entries(spark):
    lines = log(["new", "busy", "done"])
    assert problems(spark, lines[1:]) == {1: "sequence,chain,state", 2: "sequence"} and problems(spark, [lines[0], lines[2]]) == {2: "sequence,chain,state"}
    assert problems(spark, [lines[0], "{", lines[2]]) == {2: "malformed", 3: "chain,state"} and problems(spark, [lines[0], None]) == {2: "malformed"}
    assert problems(spark, log(["new", "done"])) == {2: "transition"} and problems(spark, log(["busy"])) == {1: "transition"}
    assert problems(spark, [json.dumps(json.loads(lines[0]) | {"to": 5})]) == {1: "malformed"}


def test_writer_reports_and_goes_on(spark, tmp_path):
    deep = spark.createDataFrame(ROWS, T.StructType([T.StructField("deep", DEEP)])).withColumns({"id": F.lit(1), "raw": F.encode(F.lit("x"), "UTF-8")})
    bad = spark.range(5).withColumn("n", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no such row")).cast("long")))
    report, detail = S.write_tables(spark, {"deep": deep, "bad": bad, "none": deep.limit(0), "twice": spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a"), "flat": spark.range(4)}, str(tmp_path))
    told = {r.table: (r.status, r.rows, r.columns, r.converted) for r in report.collect()}
    assert told == {"deep": ("written", 5, 3, ["deep", "raw"]), "bad": ("failed", None, 2, []), "none": ("empty", 0, 3, ["deep", "raw"]), "twice": ("failed", None, 2, []), "flat": ("written", 4, 1, [])}
    assert "no such row" in report.where("table = 'bad'").first().error
    counts = {(r.path, r.what): r["values"] for r in detail.where("table = 'deep'").collect()}
    assert counts == {("deep", "nested"): 4, ("raw", "bytes"): 5, ("deep[]{}.z", "nonfinite"): 2, ("deep[]{}.b", "bytes"): 3, ("deep[]{}.f[]", "nonfinite"): 2}
    back = spark.read.parquet(f"{tmp_path}/deep")
    assert back.schema["deep"].dataType == T.StringType() and {r.deep for r in back.collect()} == {None if x is None else json.dumps(walk(x), separators=(",", ":")) for (x,) in ROWS}
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"deep", "flat", "_report", "_report_detail"}


@pytest.fixture
def cohort(spark, tmp_path):
    rows = [(k, "a1" if k < 6 else "a2", 60310.5 + k, "DIA" if k % 3 else "SSO", k % 2 if k % 3 else None) for k in range(10)]
    df = spark.createDataFrame(rows, "source_id long, acquisition_id string, mjd_tai double, population string, object_id long")
    df = df.withColumns({f"{c}_json": F.lit("{}") for c in C.SNAPSHOTS})
    df.write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "sealed"), (lambda: discover(spark, str(tmp_path / "in"))), spark.read.parquet(str(tmp_path / "in")), tmp_path / "in"


def test_catalog_is_sealed_and_opened(spark, cohort):
    at, files, df, place = cohort
    receipts = df.groupBy("acquisition_id").agg(F.count("*").alias("readable_rows"))
    C.seal_catalog(spark, at, "v1", files(), df, receipts, C.evidence(df))
    assert "sso_sources" in C.open_sealed(spark, at, "v1", files(), df)
    with pytest.raises(C.Refused, match="contract v1"):
        C.open_sealed(spark, at, "v2", files(), df)
    with pytest.raises(C.Refused, match="objects .*: .* instead of"):
        C.open_sealed(spark, at, "v1", files(), df.where("source_id <> 1"))
    wrong = C.disagreements(C.evidence(df.where("source_id <> 1")), C.evidence(df))
    assert {(r.kind, r.key, r.observed, r.expected) for r in wrong.where("kind <> 'objects'").collect()} == {("rows", "all", 5, 6), ("day", "2024-01-02", None, 1), ("population", "DIA", 3, 4)}
    spark.range(1).coalesce(1).write.parquet(str(place / "more"))
    with pytest.raises(C.Refused, match="inputs have changed"):
        C.open_sealed(spark, at, "v1", files(), df)


def test_catalog_that_is_contradicted_is_not_sealed(spark, cohort):
    at, files, df, _ = cohort
    receipts = df.groupBy("acquisition_id").agg(F.count("*").alias("readable_rows"))
    cases = {
        "receipts": (df, receipts.withColumn("readable_rows", F.col("readable_rows") + 1), None), "repeated": (df.unionByName(df.limit(1)), df.unionByName(df.limit(1)).groupBy("acquisition_id").agg(F.count("*").alias("readable_rows")), None),
        "accepted": (df, receipts, C.evidence(df.withColumn("population", F.lit("DIA")))),
    }
    for name, (rows, told, accepted) in cases.items():
        with pytest.raises(C.Refused, match=name):
            C.seal_catalog(spark, f"{at}/{name}", "v1", files(), rows, told, accepted)
        with pytest.raises(C.Refused, match="not passed"):
            C.open_sealed(spark, f"{at}/{name}", "v1", files(), rows)
