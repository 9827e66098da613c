"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import cut, remove, temporary


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that edges reach.

    Each round a node takes the least label among its own and its neighbours', then the label of that label, so long
    chains shrink by more than half a round. Every round's labels are written to the shared folder.
    """
    spark = edges.sparkSession
    with temporary(spark) as keep:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v").distinct()
        both = cut(both, "edges")
        new = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("new")).select(F.col("u").alias("node"), F.lit(None).cast("long").alias("comp"), "new"), "labels")
        for _ in range(rounds):
            labels = new.select("node", F.col("new").alias("comp"))
            near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
            low = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "comp", F.least("comp", "near").alias("low"))
            up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
            last, new = new, cut(low.join(up, "low").select("node", "comp", F.least("low", "up").alias("new")), "labels")
            remove(spark, last.scratch_path)
            if new.filter("comp <> new").isEmpty():
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        keep(new)
    out = new.select("node", F.col("new").alias("comp"))
    out.scratch_path = new.scratch_path
    return out
