"""What a ledger's plans may hold."""

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.streaming.ledger import Ledger


@pytest.mark.parametrize(("per_commit", "attempts"), [(1 << 20, 1), (3, 4)])
def test_open_shards_stay_a_table(spark, tmp_path, monkeypatch, per_commit, attempts):
    """No plan names the shards that are open, so that plans don't grow with their number."""
    run = Ledger(spark, f"file://{tmp_path}/run", {"v": 1})
    rows = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("o:"), "id").alias("sample_id"), F.array("id").alias("edges"))
    run.plan(rows, 10, "k")
    monkeypatch.setattr(Column, "isin", lambda *_: pytest.fail("a filter that names shards"))
    assert run.run(lambda rows: rows, per_commit) == 10
    made = sorted((r.shard, r.attempt) for r in run.commits().collect())
    assert made == [(i, i // per_commit) for i in range(10)] and made[-1][1] == attempts - 1
    assert sorted((r.sample_id, r.edges) for r in run.result().collect()) == sorted((f"o:{i}", [i]) for i in range(100))
    assert run.run(lambda rows: rows, per_commit) == 0
