"""Connected components by contraction, in DataFrame operations alone.

Each round every vertex that has a smaller neighbour hooks onto the smallest one, chains of hooks are
shortened by pointer jumping, and the edges are rewritten between what is left.  Nothing is collected;
the driver sees only whether edges remain.  Joins are between written tables, so that Spark can split
a hot vertex's partition, and the only grouping is a minimum, which is summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import saved, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed -> (node, component), component the least node.

    Only nodes that occur in an edge to another node are returned; null ends are left out; no edges, no rows.
    """
    with scratch() as keep:
        live = keep(edges_of(edges, ("a", "b")))
        parents: DataFrame | None = None
        while live.limit(1).count():
            hooks = keep(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")))
            hooks = flattened(hooks, keep)
            parents = hooks if parents is None else keep(followed(parents, hooks).unionByName(hooks))
            left = live.join(hooks.withColumnsRenamed({"node": "hi", "up": "hi_up"}), "hi", "left")
            left = left.join(hooks.withColumnsRenamed({"node": "lo", "up": "lo_up"}), "lo", "left")
            live = keep(edges_of(left.select(F.coalesce("hi_up", "hi").alias("a"), F.coalesce("lo_up", "lo").alias("b")), ("a", "b")))
        if parents is None:
            return saved(live.select(F.col("hi").alias("node"), F.col("lo").alias("component")))
        roots = parents.select(F.col("up").alias("node")).distinct().join(parents, "node", "left_anti")
        return saved(parents.select("node", F.col("up").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))))


def edges_of(edges: DataFrame, names: tuple[str, str]) -> DataFrame:
    a, b = map(F.col, names)
    return edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def followed(parents: DataFrame, hooks: DataFrame) -> DataFrame:
    """parents, where a node's parent has since got a parent of its own."""
    on = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
    return parents.join(on, "up", "left").select("node", F.coalesce("next", "up").alias("up"))


def flattened(hooks: DataFrame, keep) -> DataFrame:
    """Pointer jumping: every node points at the end of its chain."""
    while True:
        on = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        if not hooks.join(on, "up", "left_semi").limit(1).count():
            return hooks
        hooks = keep(followed(hooks, hooks))
