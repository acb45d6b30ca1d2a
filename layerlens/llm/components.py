"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch


def components(edges: DataFrame, into: Scratch | None = None) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node reachable.

    Each round every node takes the smallest label among its own and its neighbours', and then that label's own label, so a
    path shortens by half or better.  Minima are pre-aggregated before each shuffle, so a hub costs a row a task.  Rounds go
    on until none changes a label; each is written to the shared folder, and the last one stays, in `into` if given.

    Defined results: no edges give no rows; edges with a null end are left out; repeated edges and loops change nothing, and
    a node that has only a loop gives no row; other columns aren't read.
    """
    work, rounds = Scratch(edges.sparkSession, "components"), 0
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = work.table(both.where("a <> b").distinct(), "edges")
    label = work.table(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "label-0")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = lower.join(label.select(F.col("node").alias("via"), F.col("label").alias("far")), "via", "left")
        stepped = work.table(jump.select("node", "old", F.least("via", "far").alias("label")), f"label-{rounds + 1}")
        work.drop(f"label-{rounds}")
        label, rounds = stepped.select("node", "label"), rounds + 1
        if not stepped.where("old <> label").take(1):
            return work.result(label, into)
