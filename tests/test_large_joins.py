"""Tables with a row for each place or street are joined by a shuffle, however small Spark takes them to be."""

import re

from pyspark.sql import functions as F

from pathloom.operators import joint, scorers, tables
from pathloom.plans import streets

SF = "/root/testdata/sf0.001"


def broadcasts(df) -> int:
    return len(re.findall(r"BroadcastHashJoin", df._jdf.queryExecution().sparkPlan().toString()))


def test_a_network_is_not_broadcast(spark):
    """At 60 times sf0.1 Spark takes 4.5 million streets for less than 10 MB, as it doesn't count what explode adds."""
    arcs = streets.arcs(spark, SF)
    assert broadcasts(streets.places(spark, SF)) == 0
    assert broadcasts(arcs) == 1  # sizes of blocks, one row for 1,024 streets


def test_convolutions_shuffle_their_nodes(spark):
    arcs = tables.kept(streets.arcs(spark, SF))
    features = streets.edges(spark, SF).select(F.col("edge_id").alias("node"), F.array("length").alias("features"))
    norm = scorers.normalised(arcs, features)
    assert broadcasts(norm) == 0 and broadcasts(scorers.propagate(norm, tables.kept(features), 1)) == 0


def test_joint_steps_shuffle_their_coordinates(spark):
    arcs = tables.kept(streets.arcs(spark, SF))
    model = tables.kept(joint.start(arcs, spark.range(2).select(F.col("id").alias("bucket"))))
    counts = tables.kept(model.select("bucket", "coord", F.lit(1).alias("observed"), F.lit(0).alias("predicted")))
    assert broadcasts(joint.joint_step(model, counts, 1, 1, 2, joint.JointOptions())) == 0
