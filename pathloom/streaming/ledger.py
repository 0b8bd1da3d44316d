"""A ledger of shards: predictions that are planned, committed and verified by hash, and made again where they fail.

A run lies in one folder of any file system that Hadoop knows:

    binding.json            what the run is made of, and its hash
    inputs/                 the rows by shard, in order
    plan/                   a row for each shard: its ends, its size, and hashes of its rows and ids
    parts/attempt=A/        a file for each shard that attempt A made
    commits/attempt=A/      what attempt A made: shard, file, hash and size

Each becomes visible by one rename. An attempt first writes its parts, then reads them back, checks them against the plan
and hashes them, then commits: a run that is stopped between the two has no commit, and its parts are of no account. A
shard is valid while the file of its last commit is there and has the committed hash; only others are made again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import file_system, kept
from ..schema import MAX_ID
from ..sources.records import canonical_sha256

COMMIT = "shard long, file string, sha256 string, rows long, attempt long"
LINE = "sample_id string, predicted_edge_ids array<long>"


def line_of(sample_id: Column, edges: Column) -> Column:
    """The only spelling of a prediction."""
    return F.to_json(F.struct(sample_id.alias("sample_id"), edges.alias("predicted_edge_ids")))


def assigned(rows: DataFrame, size: int, order: str) -> DataFrame:
    """``rows`` with the shard of each: runs of ``size`` rows in order; equal keys aren't allowed.

    Rows are dealt by range and written, so that places don't change; a row's place is its place in its range plus the
    sizes of the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row for each range
    w = Window.partitionBy("_p").orderBy(order)
    twice = F.when(F.lag(order).over(w) == F.col(order), F.raise_error(F.concat(F.lit("duplicate key "), F.col(order).cast("string"))).cast("long"))
    place = F.row_number().over(w) - 1 + F.coalesce(twice, F.lit(0))
    return dealt.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("shard", F.expr(f"(_i + _b) div {size}")).drop("_p", "_i", "_b")


class Ledger:
    """A run under ``root`` that is bound to ``binding``; a run begun with another binding is an error."""

    def __init__(self, spark: SparkSession, root: str, binding: dict):
        self.spark, self.root = spark, root.rstrip("/")
        sha = canonical_sha256(binding)
        found = self._read("binding.json")
        if found is None:
            self._commit_text("binding.json", json.dumps({"sha256": sha, "binding": binding}, sort_keys=True))
        elif json.loads(found)["sha256"] != sha:
            raise ValueError("the run was begun with another configuration")

    # Files

    def _at(self, name: str):
        return file_system(self.spark, f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def _read(self, name: str) -> str | None:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0] if self._exists(name) else None

    def _rename(self, source: str, target: str) -> None:
        """Make ``target`` visible; what another run made visible before stays, and is an error."""
        fs, a = self._at(source)
        _, b = self._at(target)
        fs.mkdirs(b.getParent())
        if fs.exists(b) or not fs.rename(a, b):
            raise FileExistsError(f"{self.root}/{target}")

    def _commit_text(self, name: str, text: str) -> None:
        tmp = f"_tmp-{uuid.uuid4().hex}"
        fs, path = self._at(tmp)
        out = fs.create(path, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self._rename(tmp, name)

    def _commit_table(self, df: DataFrame, name: str) -> DataFrame:
        tmp = f"_tmp-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{tmp}")
        self._rename(tmp, name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    # Steps

    def plan(self, rows: DataFrame, size: int, order: str) -> DataFrame:
        """(shard, first, last, n, input_sha256, ids_sha256) of ``rows`` (``order``, sample_id, edges, ...), made once.

        The hashes are of a shard's rows and ids in order, a line each; a shard's ``size`` bounds what a task gathers. A
        plan that is there already must have the same input, or it is an error.
        """
        own = kept(assigned(rows.select(F.col(order).alias("_k"), "sample_id", "edges"), size, "_k"))
        lines = F.array_sort(F.collect_list(F.struct("_k", "sample_id", F.to_json(F.struct("sample_id", "edges")).alias("line"))))
        found = own.groupBy("shard").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("n"), lines.alias("_l"))
        sha = lambda field: F.sha2(F.array_join(F.transform("_l", lambda x: x[field]), "\n"), 256)
        found = kept(found.select("shard", "first", "last", "n", sha("line").alias("input_sha256"), sha("sample_id").alias("ids_sha256")))
        if not self._exists("plan"):
            self._commit_table(own, "inputs")
            return self._commit_table(found, "plan")
        old = self.spark.read.parquet(f"{self.root}/plan")
        if not old.exceptAll(found).isEmpty() or not found.exceptAll(old).isEmpty():
            raise ValueError("the run was planned for other rows")
        return old

    def commits(self) -> DataFrame:
        """The last commit of every shard that has any."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], COMMIT)
        every = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")
        last = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("attempt")))
        return every.withColumn("_r", last).where("_r = 1").drop("_r")

    def _files(self, pattern: str) -> DataFrame:
        """(file, sha256, ids_sha256, rows, faults) of part files, read and hashed where they lie; file is the path from the root."""
        if not self._exists("parts"):
            return self.spark.createDataFrame([], "file string, sha256 string, ids_sha256 string, rows long, faults long")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{self.root}/{pattern}")
        lines = F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")
        read = F.transform(lines, lambda x: F.from_json(x, LINE))
        own = files.select(F.regexp_extract("path", "(parts/.*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), lines.alias("_l"), read.alias("_r"))
        edges = lambda r: r["predicted_edge_ids"]
        legal = lambda r: F.coalesce((F.size(edges(r)) > 0) & F.forall(edges(r), lambda e: e.between(0, MAX_ID)), F.lit(False))
        bad = F.zip_with("_l", "_r", lambda x, r: ~F.coalesce((line_of(r["sample_id"], edges(r)) == x) & legal(r), F.lit(False)))
        ids = F.array_join(F.transform("_r", lambda r: r["sample_id"]), "\n")
        return own.select("file", "sha256", F.sha2(ids, 256).alias("ids_sha256"), F.size("_l").cast("long").alias("rows"), F.size(F.filter(bad, lambda b: b)).cast("long").alias("faults"))

    def states(self) -> DataFrame:
        """(shard, state, attempt, sha256): ``missing`` without a commit or its file, ``damaged`` if bytes differ, else ``valid``."""
        plan = self.spark.read.parquet(f"{self.root}/plan").select("shard")
        now = self._files("parts").select("file", F.col("sha256").alias("_now"))
        own = plan.join(self.commits(), "shard", "left").join(now, "file", "left")
        state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "damaged").otherwise("valid")
        return own.select("shard", state.alias("state"), "attempt", "sha256")

    def run(self, predict: Callable[[DataFrame], DataFrame], per_commit: int = 64) -> int:
        """Make all shards that aren't valid by ``predict`` ((sample_id, edges, ...) to (sample_id, edges)); how many that were.

        ``per_commit`` shards at a time are written and committed, so a run that is stopped loses no more than these.
        A part whose ids aren't those of its input in order, or with a row that isn't a prediction, is an error.
        """
        pending = kept(self.states().where("state <> 'valid'").select("shard"))
        n = pending.count()
        # Places in order are only needed where the shards don't go together.
        batch = F.lit(0) if n <= per_commit else F.floor((F.row_number().over(Window.orderBy("shard")) - 1) / per_commit)
        pending = kept(pending.withColumn("batch", batch))
        for at in range(math.ceil(n / per_commit)):
            self._attempt(predict, pending.where(F.col("batch") == at).select("shard"))
        return n

    def _attempt(self, predict: Callable[[DataFrame], DataFrame], shards: DataFrame) -> None:
        fs, path = self._at("parts")
        numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()] if fs.exists(path) else []
        attempt = max(numbers, default=-1) + 1
        rows = self.spark.read.parquet(f"{self.root}/inputs").join(shards, "shard", "left_semi")
        made = predict(rows.select("sample_id", "edges")).select("sample_id", F.col("edges").alias("_e"))
        lines = rows.select("shard", "_k", "sample_id").join(made, "sample_id").select("shard", "_k", line_of(F.col("sample_id"), F.col("_e")).alias("value"))
        text = lines.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_k", "value"))).alias("_l"))
        text = text.select("shard", F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("value"))
        text.write.partitionBy("shard").text(f"{self.root}/parts/attempt={attempt}")
        plan = self.spark.read.parquet(f"{self.root}/plan").join(shards, "shard", "left_semi")
        found = self._files(f"parts/attempt={attempt}").withColumn("shard", F.regexp_extract("file", "shard=([0-9]+)/", 1).cast("long"))
        found = kept(plan.select("shard", F.col("ids_sha256").alias("_ids")).join(found, "shard", "left"))
        bad = found.where("ids_sha256 is null or ids_sha256 <> _ids or faults > 0").first()
        if bad:
            raise ValueError(f"shard {bad['shard']}: {'rows that are no predictions' if bad['faults'] else 'other ids than its input'}")
        self._commit_table(found.select("shard", "file", "sha256", "rows", F.lit(attempt).cast("long").alias("attempt")), f"commits/attempt={attempt}")

    def result(self) -> DataFrame:
        """(shard, pos, sample_id, edges) of all shards; one that isn't valid is an error."""
        own = self.commits().join(self.states().select("shard", "state"), "shard", "right")
        sure = F.when(F.col("state") == "valid", F.col("file")).otherwise(F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), F.lit(" is "), "state")))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{self.root}/parts")
        lines = F.posexplode(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("pos", "line")
        rows = own.select("shard", sure.alias("file")).join(files.select(F.regexp_extract("path", "(parts/.*)$", 1).alias("file"), "content"), "file").select("shard", lines)
        read = F.from_json("line", LINE)
        return rows.select("shard", "pos", read["sample_id"].alias("sample_id"), read["predicted_edge_ids"].alias("edges"))
