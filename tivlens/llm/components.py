"""Connected components of a link table by hooking and pointer jumping.

Every vertex with a smaller neighbour hooks to the smallest one; as pointers only go down
they form a forest, whose roots are found by joining the pointers with themselves. Links
are then moved to the roots, and the next round starts with what still joins two roots.
Every step is written to the shared folder, so lineage stays short. Hot vertices meet
in pre-aggregated minima and in joins with plain tables, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tivlens.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, component`` of the vertices whose component, its smallest vertex, is another one."""
    live = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    live = stored(live, "links")
    label = live.select(F.col("hi").alias("vertex"), F.col("lo").alias("component")).limit(0)
    while not live.isEmpty():
        hook = stored(live.groupBy("hi").agg(F.min("lo").alias("to")), "hooks")
        while True:
            above = hook.select(F.col("hi").alias("to"), F.col("to").alias("top"))
            hook = stored(hook.join(above, "to", "left").select(
                "hi", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "hooks")
            still = hook.where("moved").isEmpty()
            hook = hook.drop("moved")
            if still:
                break
        moved = hook.select(F.col("hi").alias("component"), "to")
        label = label.join(moved, "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
        label = stored(label.unionByName(hook.select(F.col("hi").alias("vertex"), F.col("to").alias("component"))), "labels")
        low = hook.select(F.col("hi").alias("lo"), F.col("to").alias("lo_to"))
        live = (live.join(hook, "hi").drop("hi").join(low, "lo", "left")
                .select(F.col("to").alias("x"), F.coalesce("lo_to", "lo").alias("y")).where("x <> y")
                .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
        live = stored(live, "links")
    return label
