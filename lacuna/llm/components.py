"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b of one orderable type; a written table) to (node, root): root is the least node of the component.

    Every round a node takes the least label among its own, its neighbours' and its label's own label,
    so paths shorten by more than half. Labels of a round are written, and a round that changes
    nothing is the last. Null nodes are left out.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialize(stepped.join(above, "root", "left").select("node", F.coalesce(F.least("root", "above"), F.col("root")).alias("root"), (F.col("old") != F.coalesce(F.least("root", "above"), F.col("root"))).alias("moved")), "labels")
        release(labels)
        labels = new
        if labels.where("moved").isEmpty():
            release(both)
            return labels.select("node", "root")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
