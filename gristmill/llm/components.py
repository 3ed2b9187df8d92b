"""Connected components of a link table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every linked node.

    ``links`` has long columns ``a`` and ``b``; loops, repeats and both directions may occur, rows
    with a null are ignored. Returns ``node``, ``root`` for each node that occurs in a link.
    An empty table gives an empty result.

    Each round points every node at the least root seen across its links, then follows pointers
    once (min-label hooking with pointer jumping), so long chains take a logarithmic number of
    rounds. Only minima per key are exchanged, which are combined before the shuffle, so a node
    with very many links does not gather them in one task. Each round is written to the shared
    folder; only the number of links that still join two roots comes to the driver.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = store(links.distinct(), "edges")
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    root = None
    current = edges
    for _ in range(most_rounds):
        # Each root takes the least root it is linked with.
        hook = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        jump = hook.alias("h").join(hook.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
        hook = store(jump, "hook")
        if root is None:
            nodes = both.distinct()
            root_new = store(nodes.join(hook, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
        else:
            h = hook.select(F.col("node").alias("root"), F.col("root").alias("to"))
            root_new = store(root.join(h, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            drop_stored(root)
        root = root_new
        h = hook.select(F.col("node").alias("x"), F.col("root").alias("to"))
        moved = (
            current.join(h, F.col("a") == F.col("x"), "left").select(F.coalesce("to", "a").alias("a"), "b")
            .join(h, F.col("b") == F.col("x"), "left").select("a", F.coalesce("to", "b").alias("b"))
            .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        following = store(moved, "edges")
        drop_stored(current)
        drop_stored(hook)
        current = following
        if current.isEmpty():
            drop_stored(current)
            return root
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
