"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescape.llm.shared import Scratch, saved


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of an edge; a component is named by its smallest node.

    Labels fall along edges and then jump to their label's own label, until none changes: a number of rounds that grows as the
    logarithm of a component's width. Each round is written, so that nothing depends on an executor that may be lost, and both
    joins start from written tables, so that Spark can split a node with very many edges. Only the result's table stays, among those of
    keep if that is given.

    Defined cases: edges from a node to itself and edges with a null end count for nothing; repeated edges count once; no edges
    give no rows.
    """
    with Scratch() as tables:
        both = tables.saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u <> v"), "edges")
        rounds = Scratch()
        labels = rounds.saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
            lower = rounds.saved(labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
            up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = rounds.saved(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
            changed = jumped.where("label <> old").limit(1).count()
            rounds.drop(2)  # those of the round before
            labels = jumped.select("node", "label")
            if not changed:
                out = (keep.saved if keep else saved)(labels.withColumnRenamed("label", "component"), "components")
                rounds.drop()
                return out
