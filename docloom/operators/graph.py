"""Connected components as a join loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of the component.

    Each round hooks: every root takes the smallest parent found across its edges;
    then shortcuts: parents jump to their parents' parents.  Loops and repeated edges are
    ignored, edges with a null end too.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "parents")
    for _ in range(MAX_ROUNDS):
        across = both.join(parent.select(F.col("node").alias("b"), F.col("root").alias("over")), "b").groupBy(F.col("a").alias("node")).agg(F.min("over").alias("over"))
        offers = parent.join(across, "node").select("root", "over").where("over < root").groupBy(F.col("root").alias("hook")).agg(F.min("over").alias("over"))
        own = parent.join(offers, parent["root"] == offers["hook"], "left").select("node", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved"))
        own = written(own, "hooked")
        up = own.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        parent = written(own.join(up, own["root"] == up["mid"], "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "moved"), "parents")
        if not parent.where("moved").limit(1).count():
            return parent.select("node", "root")
        parent = parent.select("node", "root")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
