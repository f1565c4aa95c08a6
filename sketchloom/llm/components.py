"""Connected components of an undirected graph, by smallest labels along links and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.staging import released, written


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> node, label (the smallest node of its component), for the nodes that have links."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "component-links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "component-labels")
    while True:
        near = both.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("l"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("to"))
        # a label is a node, so its own label is a label as well
        jumped = moved.join(labels.toDF("to", "jump"), "to").select("node", "label", F.least("to", "jump").alias("new"))
        jumped = written(jumped, "component-labels")
        released(labels)
        changed = jumped.where("new <> label").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            released(both)
            return labels
        labels.staged_path = jumped.staged_path
