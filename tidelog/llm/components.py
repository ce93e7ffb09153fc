"""Connected components by union-find rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", parts: int | None = None) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that links reach.

    Each round, a node takes the smallest label among itself and its neighbours, then its label's own label (the
    find with path halving of a union-find, for all nodes at once), until nothing changes. Both joins read written
    tables, so that Spark can split a node that has very many links; minima are combined before each shuffle.
    The edges are written in `parts` if given, the tables of the rounds in as many as the edges' bytes ask for.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges", parts)
    parts = scratch.parts(f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), f"{name}-0", parts)
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        lower = scratch.save(seen.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), f"{name}-{step}-low", parts)
        own = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(own, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
        after = scratch.save(jumped, f"{name}-{step}", parts)
        before = labels.select("node", F.col("label").alias("was"))
        changed = after.join(before, "node").where("label <> was").limit(1).count()
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-low")
        labels = after
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
