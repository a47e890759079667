"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round, every node that has a smaller neighbour hooks onto its smallest one - one
    map-side combined aggregate, whatever a node's degree - the hooks are shortened by
    pointer jumping, and edges are relabelled by their ends' roots until none is left.
    Hooks only lead to smaller nodes, so they form trees."""
    live = common.stage(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                        .where("lo < hi").distinct(), "edges")
    labels = common.stage(edges.select(F.explode(F.array("a", "b")).alias("node")).dropna().distinct()
                          .withColumn("root", F.col("node")), "labels")
    while not live.isEmpty():
        hooks = common.stage(live.groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("next"))
            jumped = common.stage(hooks.join(above, "up", "left").select(
                "hi", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "hooks")
            common.drop(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        hooks_lo, hooks_hi = (hooks.select(F.col("hi").alias(k), F.col("up").alias(f"{k}_root")) for k in ("lo", "hi"))
        a, b = F.coalesce("lo_root", "lo"), F.coalesce("hi_root", "hi")
        relabelled = common.stage(
            live.join(hooks_lo, "lo", "left").join(hooks_hi, "hi", "left")
            .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
        moved = common.stage(labels.join(hooks.select(F.col("hi").alias("root"), "up"), "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")), "labels")
        common.drop(live, labels, hooks)
        live, labels = relabelled, moved
    return labels
