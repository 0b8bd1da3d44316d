"""Batches of texts in the pipeline."""

import corpus_pipeline
import pyarrow as pa


def test_the_pipeline_sends_short_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    seen = []
    stage = lambda _, docs, __: seen.append(spark.range(5000).coalesce(1).mapInArrow(sizes, "n long").collect()) or docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert max(r.n for r in seen[0]) <= corpus_pipeline.BATCH and sum(r.n for r in seen[0]) == 5000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
