"""Characterisation of a delivery: nested coverage, composition, days, and a sample of repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.scalars import AMBIGUOUS, DIA, SSO, population
from skyledger.functions.timescale import is_finite


def schema_paths(schema: T.StructType) -> list[tuple[str, str, str, str]]:
    """``path, type, kind, unit`` of every field; units say what coverage counts: rows, entries or elements."""
    out: list[tuple[str, str, str, str]] = []

    def walk(prefix: str, kind: T.DataType, unit: str) -> None:
        name = "struct" if isinstance(kind, T.StructType) else "map" if isinstance(kind, T.MapType) else "list" if isinstance(kind, T.ArrayType) else "leaf"
        out.append((prefix, kind.simpleString(), name, unit))
        if name == "struct":
            for f in kind.fields:
                walk(f"{prefix}.{f.name}", f.dataType, unit)
        elif name == "map":
            walk(f"{prefix}.value", kind.valueType, "entries")
        elif name == "list":
            walk(f"{prefix}.element", kind.elementType, "elements")

    for f in schema.fields:
        walk(f.name, f.dataType, "rows")
    return out


def schema_inventory(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(schema_paths(df.schema), "path string, type string, kind string, unit string")


def covered(path: str, x: Column, kind: T.DataType) -> Column:
    bad = F.count_if(x.isNotNull() & ~is_finite(x)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
    return F.struct(F.lit(path).alias("path"), F.count("*").alias("observed"), F.count_if(x.isNull()).alias("nulls"), bad.alias("nonfinite"))


def leaves(prefix: str, column: Column, kind: T.DataType) -> list[tuple[str, Column, T.DataType]]:
    """Struct members at any depth, a null parent making null members; maps and lists stay whole."""
    if not isinstance(kind, T.StructType):
        return [(prefix, column, kind)]
    inner = (leaves(f"{prefix}.{f.name}" if prefix else f.name, column[f.name] if prefix else F.col(f.name), f.dataType) for f in kind.fields)
    return [x for part in inner for x in part]


def coverage(df: DataFrame) -> DataFrame:
    """``path, observed, nulls, nonfinite``: one pass for all rows' leaves, and one explode for each map or list, whose
    members are counted by entries or elements."""
    flat = leaves("", F.lit(None), df.schema)
    parts = [df.agg(F.array(*(covered(p, x, k) for p, x, k in flat)).alias("c"))]
    for p, x, k in flat:
        if isinstance(k, T.MapType):
            entries = df.select(F.explode(F.map_values(x)).alias("v"))
            inner = k.valueType
        elif isinstance(k, T.ArrayType):
            entries, inner = df.select(F.explode(x).alias("v")), k.elementType
        else:
            continue
        below = [(f"{p}.{n}" if n else p + ".[]", c, t) for n, c, t in member_leaves(inner)]
        parts.append(entries.agg(F.array(*(covered(n, c, t) for n, c, t in below)).alias("c")))
    return reduce(DataFrame.unionByName, parts).select(F.explode("c").alias("c")).select("c.*")


def member_leaves(kind: T.DataType) -> list[tuple[str, Column, T.DataType]]:
    if not isinstance(kind, T.StructType):
        return [("", F.col("v"), kind)]
    return [(f.name, F.col("v")[f.name], f.dataType) for f in kind.fields]


def composition(packets: DataFrame, is_sso: str = "pred.is_sso", object_id: str = "diaObjectId") -> DataFrame:
    """Rows, share and flags of each population."""
    flag, obj = F.col(is_sso), F.col(object_id)
    counts = packets.groupBy(population(flag, obj).alias("population")).agg(
        F.count("*").alias("rows"), F.count_if(flag).alias("flagged_sso"), F.count_if(flag.isNull()).alias("null_flag"), F.count_if(flag & (obj > 0)).alias("flag_disagrees")
    )
    names = packets.sparkSession.createDataFrame([(DIA,), (SSO,), (AMBIGUOUS,)], "population string")
    full = names.join(counts, "population", "left").fillna(0)
    share = F.col("rows") / F.sum("rows").over(W.partitionBy())  # three rows
    return full.withColumn("fraction", F.round(F.coalesce(share, F.lit(0.0)), 9))


def repeat_sample(packets: DataFrame, objects: int = 12, id_column: str = "diaObjectId", source: str = "diaSourceId", time: str = "midpointMjdTai", features: str = "lc_features") -> DataFrame:
    """The first and last two snapshots of objects spread evenly over the order of (rows, id), and whether their
    features changed. The ordered list of repeated objects is ranked in two steps (pieces of the ids of one row count, then
    inside a piece of about ``PIECE_ROWS``), so that no task orders all objects, nor all of one row count."""
    usable = packets.where(F.col(id_column) > 0)
    sizes = usable.groupBy(F.col(id_column).alias("object_id")).agg(F.count("*").alias("n")).where("n > 1")
    pieces = max(1, -(-sizes.count() // PIECE_ROWS))
    # borders follow the ids where they crowd; a merged sketch of them is enough, since any borders give the same order
    told = sizes.agg(F.count("*").alias("total"), F.percentile_approx("object_id", [k / pieces for k in range(1, pieces)] or [0.5], 10_000).alias("borders")).first()
    borders = sorted(set(told.borders or [])) if pieces > 1 else []
    held = F.array(*(F.lit(b).cast("long") for b in borders)) if borders else F.array().cast("array<long>")
    sizes = sizes.withColumn("piece", F.size(F.filter(held, lambda b: b < F.col("object_id"))).cast("long"))
    bins = sizes.groupBy("n", "piece").agg(F.count("*").alias("c"))
    starts = bins.withColumn("before", F.sum("c").over(W.orderBy("n", "piece")) - F.col("c")).withColumn("total", F.lit(told.total)).drop("c")
    ranked = sizes.withColumn("inside", F.row_number().over(W.partitionBy("n", "piece").orderBy("object_id"))).join(starts, ["n", "piece"])
    place = F.col("before") + F.col("inside") - 1
    slot = F.when(F.col("total") <= objects, place).otherwise(F.floor(place * (objects - 1) / (F.col("total") - 1)))
    wanted = F.when(F.col("total") <= objects, place).otherwise(F.ceil(slot * (F.col("total") - 1) / F.lit(objects - 1)))
    chosen = ranked.where((place == wanted) | (place == F.col("total") - 1)).select("object_id", "n").orderBy("n", "object_id").limit(objects)
    rows = usable.join(F.broadcast(chosen), usable[id_column] == chosen["object_id"])  # at most `objects` rows
    up, down = W.partitionBy("object_id").orderBy(time, source), W.partitionBy("object_id").orderBy(F.desc(time), F.desc(source))
    digest = F.sha2(F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(features)))), F.lit("null")), 256)
    ends = rows.select("object_id", "n", source, time, digest.alias("feature_hash")).withColumn("from_start", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down))
    kept = ends.where("from_start <= 2 or from_end <= 2")
    changed = F.size(F.collect_set("feature_hash").over(W.partitionBy("object_id"))) > 1  # four rows an object
    return kept.select("object_id", "n", F.col(source).alias("source_id"), "from_start", "feature_hash", changed.alias("changed"))


#: Objects that one task ranks, about.
PIECE_ROWS = 20_000
#: Families of analyses, what a delivery supports at best, and the fields that are the evidence.
CAPABILITIES = [
    ("source-level photometric analysis", "PARTIALLY_SUPPORTED", ["psfFlux", "psfFluxErr", "scienceFlux", "scienceFluxErr", "band", "snr", "reliability"]),
    ("object-level population analysis", "PARTIALLY_SUPPORTED", ["diaObjectId", "xm", "pred"]),
    ("repeated-detection/time-domain analysis", "SUPPORTED", ["diaObjectId", "diaSourceId", "midpointMjdTai", "band"]),
    ("lightcurve reconstruction", "PARTIALLY_SUPPORTED", ["diaObjectId", "diaSourceId", "midpointMjdTai", "psfFlux", "psfFluxErr", "band"]),
    ("variability-feature analysis", "PARTIALLY_SUPPORTED", ["lc_features"]),
    ("broker classification/prediction analysis", "PARTIALLY_SUPPORTED", ["clf", "pred"]),
    ("DIA/static-object selection", "PARTIALLY_SUPPORTED", ["pred.is_sso", "diaObjectId"]),
    ("Solar System Object analysis", "PARTIALLY_SUPPORTED", ["pred.is_sso", "ra", "dec", "midpointMjdTai"]),
    ("basic sky-position filtering", "SUPPORTED", ["ra", "dec"]),
    ("temporal filtering", "SUPPORTED", ["midpointMjdTai"]),
    ("future crossmatch/enrichment workflows", "PARTIALLY_SUPPORTED", ["ra", "dec", "diaObjectId", "xm"]),
    ("project cadence and band summaries", "SUPPORTED", ["diaObjectId", "midpointMjdTai", "band"]),
    ("project upper-limit evolution", "NOT_SUPPORTED", []),
    ("project candidate ranking", "PARTIALLY_SUPPORTED", ["clf", "pred", "lc_features", "reliability"]),
]
#: Families that repeated source ids spoil.
NEED_UNIQUE_SOURCES = ["repeated-detection/time-domain analysis", "project cadence and band summaries"]


def capability_matrix(df: DataFrame, source: str = "diaSourceId", capabilities: list[tuple[str, str, list[str]]] = CAPABILITIES) -> DataFrame:
    """``analysis, status, evidence, claim_status`` of each family.

    A field is evidence if it is there and holds a value in some row. Without all of them a family is supported in part, without any not
    at all. Repeated source ids leave what needs unique ones supported in part.
    """
    fields = sorted({p for _, _, paths in capabilities for p in paths})
    there = {p for p, *_ in schema_paths(df.schema)}
    filled = {p: F.count(F.col(p)) > 0 if p in there else F.lit(False) for p in fields}
    held = df.agg(F.struct(*(x.alias(p.replace(".", "_")) for p, x in filled.items())).alias("held"))
    has = lambda p: F.col(f"held.{p.replace('.', '_')}")
    repeated = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("repeated"))
    rows = []
    for family, status, evidence in capabilities:
        best = F.lit(status)
        if evidence:
            every, some = reduce(lambda a, b: a & b, map(has, evidence)), reduce(lambda a, b: a | b, map(has, evidence))
            best = F.when(every, status).when(some, "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")
        if family in NEED_UNIQUE_SOURCES:
            best = F.when(F.col("repeated"), "PARTIALLY_SUPPORTED").otherwise(best)
        claim = F.when(best == "NOT_SUPPORTED", "VERIFIED").otherwise("STRONGLY SUPPORTED")
        rows.append(F.struct(F.lit(family).alias("analysis"), best.alias("status"), F.lit(",".join(evidence)).alias("evidence"), claim.alias("claim_status")))
    return held.crossJoin(repeated).select(F.explode(F.array(*rows)).alias("r")).select("r.*")  # one row each


#: What a delivery must hold and of which types, what it may, and what needs a review.
REQUIRED = {
    "diaSourceId": ["bigint"], "diaObjectId": ["bigint"], "midpointMjdTai": ["double"], "pred.is_sso": ["boolean"], "ra": ["double"], "dec": ["double"],
    "band": ["string"], "psfFlux": ["float", "double"], "psfFluxErr": ["float", "double"],
}
OPTIONAL_NUMERIC = ["reliability", "scienceFlux", "scienceFluxErr", "snr", "templateFlux", "templateFluxErr"]
SNAPSHOTS = ["pred", "clf", "lc_features", "xm", "misc"]
REVIEW = ["diaForcedSources", "diaObject", "mpc_orbits", "prvDiaForcedSources", "prvDiaSources", "ssObject", "ssObjectId", "ssSource"]


def schema_admission(df: DataFrame) -> DataFrame:
    """``path, role, type, status`` of every field that the contract names and of additions, in one table.

    Required fields must have an allowed type, optional numbers may be missing but not of another kind, snapshots must be structs (features a
    map of structs by text), identities and histories that the contract doesn't know need a review, and all else is an addition.
    """
    found = {p: (kind, unit) for p, kind, _, unit in schema_paths(df.schema)}
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = [(p, "required", found.get(p, ("ABSENT",))[0], "admitted" if found.get(p, ("ABSENT",))[0] in kinds else "rejected") for p, kinds in REQUIRED.items()]
    for p in OPTIONAL_NUMERIC:
        kind = found.get(p, ("ABSENT",))[0]
        rows.append((p, "optional", kind, "absent" if p not in found else "admitted" if kind in ("float", "double") else "rejected"))
    for p in SNAPSHOTS:
        kind = types.get(p)
        shaped = isinstance(kind, T.StructType) if p != "lc_features" else isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StructType)
        rows.append((p, "snapshot", kind.simpleString() if kind else "ABSENT", "absent" if kind is None else "admitted" if shaped else "rejected"))
    rows += [(p, "review", found[p][0], "rejected") for p in REVIEW if p in found]
    known = {*REQUIRED, *OPTIONAL_NUMERIC, *SNAPSHOTS, *REVIEW}
    rows += [(p, "addition", kind, "admitted") for p, (kind, _) in found.items() if p.split(".")[0] not in known]
    return df.sparkSession.createDataFrame(rows, "path string, role string, type string, status string")


def admission_status(admission: DataFrame) -> DataFrame:
    """``status, errors``: one rejected field makes a delivery incompatible."""
    bad = F.count_if(F.col("status") == "rejected")
    return admission.agg(F.when(bad > 0, "INCOMPATIBLE").otherwise("COMPATIBLE_WITH_LIMITATIONS").alias("status"), bad.alias("errors"))
