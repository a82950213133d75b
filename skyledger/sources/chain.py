"""Sealed logs: every entry carries a digest of itself and of the one before, and both are computed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The members of an entry that its digest covers.
MEMBERS = ["seq", "at_utc", "from", "to", "actor", "reason", "evidence", "prev_entry_sha256"]
ENTRY = "seq long, from_state string, to_state string, prev string, sealed string, again string"


def canonical(value) -> str:
    """JSON with keys in order at every depth, compact, ASCII alone."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def read_entry(line: str | None) -> tuple:
    """``seq, from, to, previous digest, digest, digest computed again`` of a line; all null if it is no entry."""
    try:
        x = json.loads(line)
        body = {
            "seq": int(x["seq"]), "at_utc": str(x["at_utc"]), "from": x["from"] or None, "to": x["to"], "actor": str(x["actor"]), "reason": str(x["reason"]),
            "evidence": dict(x.get("evidence") or {}), "prev_entry_sha256": x.get("prev_entry_sha256"),
        }
        if not isinstance(x["to"], str) or not isinstance(body["from"], (str, type(None))) or not isinstance(body["prev_entry_sha256"], (str, type(None))):
            raise TypeError(line)
        return body["seq"], body["from"], body["to"], body["prev_entry_sha256"], str(x["entry_sha256"]), hashlib.sha256(canonical(body).encode()).hexdigest()
    except (KeyError, TypeError, ValueError, RecursionError):
        return (None,) * 6


def read_entries(lines: DataFrame) -> DataFrame:
    """``log, number`` and the entry (see ``ENTRY``) of each line; ``number`` is its place in the log, from 1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5]
        for batch in batches:
            found = [read_entry(x) for x in batch.column(2).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 6
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["log", "number", *(x.split()[0] for x in ENTRY.split(", "))])

    return lines.select(F.col("log").cast("string").alias("log"), F.col("number").cast("long").alias("number"), "line").mapInArrow(read, f"log string, number long, {ENTRY}")


def broken_entries(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """``log, number, problems`` of the entries of sealed logs that do not hold, of ``log, number, line``.

    malformed: no entry. sequence: its number is not its place. chain: it does not name the digest of the entry before (the first: none).
    modified: its digest is not that of its contents. state: it does not start from the state that the entry before led to (the first: from none). transition: a step that is
    not in ``edges`` (``from_state, to_state``; a null from_state allows first states). Lines are parsed in batches and compared with their neighbours by one shuffle.
    """
    order = W.partitionBy("log").orderBy("number")
    entries = read_entries(lines)
    seen = entries.withColumns({"sealed_before": F.lag("sealed").over(order), "state_before": F.lag("to_state").over(order)})
    steps = F.broadcast(edges.select(F.col("from_state").alias("_from"), F.col("to_state").alias("_to"), F.lit(True).alias("_legal")).distinct())  # states of a lifecycle: a short list
    told = seen.join(steps, F.col("from_state").eqNullSafe(F.col("_from")) & (F.col("to_state") == F.col("_to")), "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    problems = F.when(F.col("seq").isNull(), F.array(F.lit("malformed"))).otherwise(F.array_compact(F.array(
        F.when(differs("seq", "number"), "sequence"), F.when(differs("prev", "sealed_before"), "chain"), F.when(differs("sealed", "again"), "modified"),
        F.when(differs("from_state", "state_before"), "state"), F.when(F.col("_legal").isNull(), "transition"),
    )))
    return told.select("log", "number", F.array_join(problems, ",").alias("problems")).where("problems <> ''")
