"""Connected components of an edge list by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import Scratch, lookup


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b): the label is the smallest node that is reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label,
    so a path halves from round to round. Every round is a table in the shared folder; the rounds
    end when no label has changed. A node with many neighbours, and a label with many nodes, are
    dealt over several tasks.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), f"{name}-both")
    labels = scratch.save(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), f"{name}-0")
    for i in range(1, 200):
        seen = lookup(both, labels.toDF("other", "label"), ["other"]).groupBy("node").agg(F.min("label").alias("near"))
        least = scratch.save(labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("to")), f"{name}-{i}-near")
        step = lookup(least, labels.toDF("to", "next"), ["to"]).select("node", F.col("label").alias("was"), F.least("to", "next").alias("label"))
        step = scratch.save(step, f"{name}-{i}")
        changed = step.where("was != label").limit(1).count()
        labels = step.select("node", "label")
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-near")
        if not changed:
            scratch.drop(f"{name}-both")
            return labels
    raise RuntimeError("components: no end after 200 rounds")
