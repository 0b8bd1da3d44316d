"""Sinks: resumable model artifacts, record files, reports. What is written becomes visible by one rename."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fit import State
from .records import DATASET, strict_json, to_json_lines


def write_text(path: str, text: str) -> None:
    """Write beside the target, flush to disk, rename; nothing is left behind on failure."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    finally:
        Path(tmp).unlink(missing_ok=True)


def write_json(path: str, document: dict) -> None:
    write_text(path, json.dumps(document, indent=2, allow_nan=False) + "\n")


def save_state(spark: SparkSession, path: str, state: State, objective: float) -> None:
    """An artifact: a Parquet table of coordinates under a new name, and a pointer that commits it."""
    table = f"coordinates-{state.completed}-{uuid.uuid4().hex[:8]}"
    os.makedirs(path, exist_ok=True)
    rows = pd.DataFrame({"coord": np.arange(len(state.weights)), "initial": state.initial, "weight": state.weights})
    spark.createDataFrame(rows).write.parquet(f"{path}/{table}")
    write_json(f"{path}/artifact.json", {"schema": "fit-artifact/v1", "topology": state.topology, "problem": state.problem, "oracle": state.oracle, "options": state.options, "completed": state.completed, "objective": objective, "coordinates": table})


def load_state(spark: SparkSession, path: str) -> tuple[State, float]:
    """The state that the pointer names; its table must be whole and its numbers positive and finite."""
    d = strict_json(Path(f"{path}/artifact.json").read_text())
    keys = {"schema", "topology", "problem", "oracle", "options", "completed", "objective", "coordinates"}
    if set(d) != keys or d["schema"] != "fit-artifact/v1":
        raise ValueError("not an artifact of this version")
    rows = spark.read.parquet(f"{path}/{d['coordinates']}").toPandas().sort_values("coord")
    initial, weights = rows.initial.to_numpy(), rows.weight.to_numpy()
    if rows.coord.tolist() != list(range(len(rows))) or not len(rows):
        raise ValueError("coordinates aren't dense")
    if not (np.isfinite(initial) & np.isfinite(weights) & (initial > 0) & (weights > 0)).all():
        raise ValueError("weights must be positive and finite")
    return State(d["topology"], d["problem"], d["oracle"], d["options"], initial, weights, d["completed"]), d["objective"]


def write_records(rows: DataFrame, path: str, kind=DATASET, order: str = "sample_id") -> None:
    """JSON lines in order: range-partitioned files whose names are in order, so that no task writes all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, order).sortWithinPartitions(order)
    to_json_lines(dealt, kind).write.mode("errorifexists").text(path)


def join_shards(paths: Iterable[str], target: str) -> None:
    """Committed shards, byte by byte, in their order."""
    tmp = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "wb") as out:
            for p in paths:
                with open(p, "rb") as f:
                    shutil.copyfileobj(f, out)
        os.replace(tmp, target)
    finally:
        Path(tmp).unlink(missing_ok=True)


def export_dataset(rows: DataFrame, reasons: DataFrame, path: str, dataset_id: str, network_id: str, expected: dict[str, int] | None = None) -> dict:
    """Records, manifest and an audit that adds up, made in a staging folder and renamed; an existing target is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    counts = {r["reason"]: r["n"] for r in reasons.collect()}  # a row for each reason
    staged = f"{path}.{uuid.uuid4().hex}.staging"
    try:
        os.makedirs(staged)
        write_records(rows, f"{staged}/records")
        written = rows.count()
        if written != counts.get("accepted", 0):
            raise ValueError(f"{written} records, {counts.get('accepted', 0)} accepted")
        for reason, n in (expected or {}).items():
            if counts.get(reason, 0) != n:
                raise ValueError(f"{reason}: {counts.get(reason, 0)}, expected {n}")
        audit = {"available": sum(counts.values()), "reasons": counts}
        write_json(f"{staged}/manifest.json", {"schema": "dataset-manifest/v1", "dataset_id": dataset_id, "network_id": network_id, "records_schema": "dataset-record/v1", "records_file": "records"})
        write_json(f"{staged}/audit.json", audit)
        os.rename(staged, path)
        return audit
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def markdown(rows: DataFrame, digits: int = 2) -> str:
    """A summary table of a few rows; null is a dash."""
    shown = rows.select(*(F.coalesce(F.format_number(c, digits) if t in ("double", "float") else F.col(c).cast("string"), F.lit("—")).alias(c) for c, t in rows.dtypes))
    body = ["| " + " | ".join(r) + " |" for r in shown.toLocalIterator()]
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *body]) + "\n"
