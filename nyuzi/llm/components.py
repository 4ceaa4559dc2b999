"""Connected components of a large graph by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nyuzi.session import cut


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the undirected links ``a, b``; ``root`` is the least node of its component.

    Each round a node and its root hook onto the least root among its neighbours, then every node jumps to its
    root's root, so the height halves and a chain of length n needs about log n rounds. A round is two aggregations and two joins on
    pre-aggregated rows; no neighbourhood is ever collected. The table of each round goes to the shared
    checkpoint folder. Nulls in a link and self-links are ignored; an empty table has no components.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    both = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(max_rounds):
        seen = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("seen"))
        step = roots.join(seen, "node").select("node", "root", F.least("root", "seen").alias("low"))
        hook = step.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        low = step.join(hook, "node", "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        low = cut(low)
        jumped = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left").select(
            "node", F.coalesce("next", "low").alias("root"), (F.coalesce("next", "low") != F.col("root")).alias("moved")
        )
        jumped = cut(jumped)
        roots = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
