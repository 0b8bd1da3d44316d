"""Strict records: JSON lines, manifests, receipts, configurations, pickled trips, legacy records, time reports."""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import re
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAX_ID, FitOptions

DATASET, PREDICTION = ("sample_id", "original_edge_ids", 2), ("sample_id", "predicted_edge_ids", 1)


def json_faults(lines: DataFrame, kind: tuple[str, str, int], line: str = "value") -> DataFrame:
    """``lines`` with sample_id, edges and fault: the first rule of a strict record that the line breaks, or null.

    Rules in order: not blank, an object with exactly the two keys and no key twice, an id that is a string, neither
    blank nor with control characters, edges that are whole numbers in range, and enough of them. Repeats are found apart.
    """
    name, edges, least = kind
    text = F.col(line)
    keys = F.array_sort(F.json_object_keys(line))
    wanted = F.array(*(F.lit(k) for k in sorted((name, edges))))
    raw_id = F.get_json_object(line, f"$.{name}")
    value = F.try_parse_json(line)
    kind_of = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    ids = F.try_variant_get(value, f"$.{edges}", "array<variant>")
    whole = F.forall(ids, lambda v: F.coalesce((F.schema_of_variant(v) == "BIGINT") & F.try_variant_get(v, "$", "bigint").between(0, MAX_ID), F.lit(False)))
    fault = (
        F.when(F.trim(text) == "", "blank_line")
        .when(keys.isNull(), "not_an_object")
        .when(keys != wanted, "wrong_keys")
        .when(value.isNull(), "not_an_object")
        .when(F.coalesce(kind_of(f"$.{name}"), F.lit("VOID")) != "STRING", "id_not_a_string")
        .when(F.trim(raw_id) == "", "blank_id")
        .when(raw_id.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control_character")
        .when(~F.coalesce(whole, F.lit(False)), "bad_edge")
        .when(F.size(ids) < least, "too_few_edges")
    )
    good = F.transform(ids, lambda v: F.try_variant_get(v, "$", "bigint"))
    return lines.withColumn("fault", fault).withColumns({"sample_id": F.when(F.col("fault").isNull(), raw_id), "edges": F.when(F.col("fault").isNull(), good)})


def read_jsonl(spark: SparkSession, path: str, kind: tuple[str, str, int]) -> DataFrame:
    """(sample_id, edges) of a strict file; any fault, a repeated id or no record at all is an error."""
    rows = json_faults(spark.read.text(path), kind)
    bad = rows.where("fault is not null").select("fault", "value").first()
    if bad:
        raise ValueError(f"{bad['fault']}: {bad['value'][:200]}")
    twice = rows.groupBy("sample_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"duplicate id {twice['sample_id']}")
    if rows.isEmpty():
        raise ValueError("no records")
    return rows.select("sample_id", "edges")


def to_json_lines(rows: DataFrame, kind: tuple[str, str, int]) -> DataFrame:
    """One compact object a line."""
    return rows.select(F.to_json(F.struct(F.col("sample_id").alias(kind[0]), F.col("edges").alias(kind[1]))).alias("value"))


def convert_legacy(rows: DataFrame) -> DataFrame:
    """(sample_id, edges) of older records; fields other than the known ones are an error."""
    known = {"manifest_id", "edges", "end_time", "original_trip_id", "source_index", "start_time"}
    if unknown := set(rows.columns) - known:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return rows.select(F.col("manifest_id").alias("sample_id"), "edges")


def sample_name(index: Column) -> Column:
    """Ids of exported test records."""
    return F.format_string("test:%09d", index)


class _Plain(pickle.Unpickler):
    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def load_pickle(data: bytes) -> list[tuple]:
    """(trip_id, edges, start, end) of a pickled list of (id, [edge], (start, end)); no classes are loaded."""
    out = []
    for i, row in enumerate(_Plain(io.BytesIO(data)).load()):
        if not isinstance(row, tuple) or len(row) != 3 or not isinstance(row[2], tuple) or len(row[2]) != 2:
            raise ValueError(f"trip {i}: not a triple with a pair of times")
        times = row[2]
        if any(isinstance(t, bool) or not isinstance(t, int) or not 0 <= t < 2**64 for t in times):
            raise ValueError(f"trip {i}: bad times")
        edges = [e if isinstance(e, int) and not isinstance(e, bool) and 0 <= e <= MAX_ID else -1 for e in row[1]]
        out.append((str(row[0]), edges, *times))
    return out


def pickle_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    """Convert a file once; edges that aren't ids become -1, which validation rejects as out of bounds."""
    spark.createDataFrame(load_pickle(Path(source).read_bytes()), "trip_id string, edges array<long>, start_ts long, end_ts long").write.parquet(target)


def no_twice(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ValueError("a key twice")
    return dict(pairs)


def strict_json(text: str) -> dict:
    return json.loads(text, object_pairs_hook=no_twice)


def exact(document: dict, keys: set[str], what: str) -> dict:
    if set(document) != keys:
        raise ValueError(f"{what}: keys {sorted(document)}")
    return document


def safe_relative(path: str) -> str:
    """A relative path without parts that lead up or out."""
    p = PurePosixPath(path)
    if not path.strip() or p.is_absolute() or ".." in p.parts or "\\" in path or path.startswith("~"):
        raise ValueError(f"unsafe path {path!r}")
    return path


def manifest(text: str, schema: str = "dataset-manifest/v1", records: str = "dataset-record/v1") -> dict:
    """A dataset's manifest; ``schema`` and ``records`` are the versions that it must name."""
    d = exact(strict_json(text), {"schema", "dataset_id", "network_id", "records_schema", "records_file"}, "manifest")
    if d["schema"] != schema or d["records_schema"] != records:
        raise ValueError("another version")
    if not all(isinstance(v, str) and v.strip() for v in d.values()):
        raise ValueError("blank fields")
    safe_relative(d["records_file"])
    return d


def receipt(text: str) -> dict:
    d = exact(strict_json(text), {"schema", "method", "dataset_id", "dataset_manifest_sha256", "prediction_records_schema", "configuration", "source_revision", "environment"}, "receipt")
    exact(d["method"], {"name", "version"}, "method")
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", d["dataset_manifest_sha256"]):
        raise ValueError("no SHA-256")
    if not d["environment"] or not all(k.strip() and str(v).strip() for k, v in d["environment"].items()):
        raise ValueError("blank environment")
    return d


def receipt_text(method: str, version: str, dataset_id: str, manifest_sha256: str, configuration: dict, revision: str, environment: dict, schema: str = "run-receipt/v1", records: str = "prediction-record/v1") -> str:
    """A run's receipt as text that ``receipt`` accepts."""
    d = {"schema": schema, "method": {"name": method, "version": version}, "dataset_id": dataset_id, "dataset_manifest_sha256": manifest_sha256, "prediction_records_schema": records, "configuration": configuration, "source_revision": revision, "environment": environment}
    text = json.dumps(d, indent=2, allow_nan=False) + "\n"
    receipt(text)
    return text


def config(text: str) -> tuple[dict, FitOptions, dict]:
    """(dataset paths, options, runtime) of a training configuration."""
    d = exact(strict_json(text), {"schema_version", "dataset", "fit", "runtime"}, "configuration")
    if d["schema_version"] != 1:
        raise ValueError("another version")
    paths = exact(d["dataset"], {"nodes", "edges", "trajectories"}, "dataset")
    if not all(isinstance(p, str) and p.strip() for p in paths.values()):
        raise ValueError("blank path")
    f = exact(d["fit"], {"eta0", "lambda", "lower_factor", "upper_factor", "updates"}, "fit")
    options = FitOptions(f["eta0"], f["lambda"], f["lower_factor"], f["upper_factor"], f["updates"])
    r = exact(d["runtime"], {"threads", "checkpoint_every"}, "runtime")
    if r["threads"] < 1 or not 1 <= r["checkpoint_every"] <= options.updates:
        raise ValueError("bad runtime")
    return paths, options, r


def split_role(dataset_id: str) -> str:
    """The one split that the id's tokens name."""
    tokens = set(re.split(r"[^a-z0-9]+", dataset_id.lower()))
    roles = {r for r, names in {"train": {"train", "training"}, "validation": {"validation", "val", "valid"}, "test": {"test", "testing"}}.items() if tokens & names}
    if len(roles) != 1:
        raise ValueError(f"{dataset_id!r} names {len(roles)} splits")
    return roles.pop()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def artifact_files(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    """(role, path, bytes, sha256) of an artifact's files, given as path by role; files are hashed where they are read."""
    parts = [file_hashes(spark, path).select(F.lit(role).alias("role"), "path", "bytes", "sha256") for role, path in sorted(roles.items())]
    if not parts:
        raise ValueError("an artifact without files")
    return reduce(DataFrame.unionByName, parts)


def expanded(text: str, variables: dict[str, str]) -> str:
    """``text`` with each ``${NAME}`` replaced, also in what is put in; unknown names and circles are errors."""
    for _ in range(10):
        before, text = text, re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: variables[m.group(1)], text)
        if text == before:
            return text
    raise ValueError("variables go in a circle")


def lacking_fields(document: dict, wanted: dict) -> list[str]:
    """The dotted keys of ``wanted`` whose values a document lacks or has otherwise."""
    def at(key):
        value = document
        for part in key.split("."):
            if not isinstance(value, dict) or part not in value:
                return False, None
            value = value[part]
        return True, value

    return [k for k, v in wanted.items() if at(k) != (True, v)]


def canonical_sha256(document) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def elapsed_seconds(text: Column) -> Column:
    """Seconds of ``h:mm:ss`` or ``m:ss``."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda total, part: total * 60 + part.cast("double"))


def time_report(reports: DataFrame, text: str) -> DataFrame:
    """``reports`` with user, system and elapsed seconds, the peak of memory in KiB and the exit code of GNU time's text."""
    grab = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return reports.withColumns({
        "user_s": grab(r"User time \(seconds\): ([0-9.]+)").cast("double"), "system_s": grab(r"System time \(seconds\): ([0-9.]+)").cast("double"),
        "elapsed_s": elapsed_seconds(grab(r"Elapsed \(wall clock\) time[^\n]*?: ([0-9:.]+)\s")), "peak_kib": grab(r"Maximum resident set size \(kbytes\): (\d+)").cast("long"), "exit": grab(r"Exit status: (\d+)").cast("int"),
    })
