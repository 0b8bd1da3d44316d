"""Resumable prediction as a stream over files of trips: each micro-batch is committed once, a restart goes on."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predict import predict
from ..sources.records import canonical_sha256
from ..sources.sinks import write_json


def bind(checkpoint: str, binding: dict) -> None:
    """Remember what a run is made of; a later run with anything else is an error."""
    path = f"{checkpoint}/binding.json"
    want = canonical_sha256(binding)
    if os.path.exists(path):
        with open(path) as f:
            if json.load(f)["sha256"] != want:
                raise ValueError("the run was begun with another configuration")
        return
    os.makedirs(checkpoint, exist_ok=True)
    write_json(path, {"sha256": want, "binding": binding})


def predict_stream(spark: SparkSession, source: str, target: str, checkpoint: str, arcs: DataFrame, metric: DataFrame, binding: dict, files: int = 8):
    """Predict all trips (sample_id, edges) under ``source`` that aren't done yet, ``files`` files to a batch.

    A batch writes to a folder of its own number, so one that is run again replaces its own rows alone.
    """
    bind(checkpoint, binding)
    trips = spark.readStream.schema("sample_id string, edges array<long>").option("maxFilesPerTrigger", files).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        predict(batch, arcs, metric).select("sample_id", "edges").write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = trips.writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).drop("batch")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a ``gap``; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
