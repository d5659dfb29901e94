"""Connected components of a table of links, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which the hooks so far are folded into one table.
FOLD = 4


def components(links: DataFrame) -> DataFrame:
    """node, root of each node of ``links`` (a, b: long): root is the smallest node that links lead to.

    A round hooks every node to its first neighbour or itself, in an order by hash
    (so that a path of ascending ids takes about log n rounds, not n), and
    contracts the links to the hooks; it ends when no link is left. Counting is a
    partial aggregation and the joins are plain equi-joins of stored tables, so a
    hub of many links is split like any skewed key. Nulls and loops link nothing;
    repeated links count once.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    out, pending = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        hook = written(first.select(F.col("a").alias("node"), F.least(place("a"), "m")["id"].alias("to")), "hooks")
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        # a node that hooks to another may hook further in the next round
        out = hook if out is None else out.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        pending += 1
        if pending == FOLD:
            out, pending = written(out, "folded"), 0
    if out is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if pending:
        out = written(out, "folded")
    least = written(out.groupBy("to").agg(F.min("node").alias("root")), "roots")
    return out.join(least, "to").select("node", "root")
