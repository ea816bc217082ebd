"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Rounds of hooking and contraction: every node points to its smallest neighbour if that is smaller, pointers are
    doubled until all point at roots, and links are rewritten between roots; links within a root vanish. Each round at
    least halves the nodes that still have links, and stars of any size take one. All state is in tables, written anew
    each round; minima are taken before the shuffle, so a node with very many links is no hot group. rows, the number of
    links if it is known, says how many files the tables need: there are two nodes a link at most.
    """
    nodes = None if rows is None else 2 * rows
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi")
    edges = scratch.keep(edges.distinct(), "links", rows)
    labels = None
    while True:
        hooks = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to"))
        lows = edges.select(F.col("lo").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti")
        hooks = scratch.keep(hooks.unionByName(lows.withColumn("to", F.col("node"))), "hooks", nodes)
        if labels is None and not hooks.take(1):
            return hooks.select("node", F.col("to").alias("component"))
        # Pointer doubling until every pointer is at a root. Pointers lead to smaller nodes, so there are no cycles.
        while True:
            next_ = hooks.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            doubled = scratch.keep(hooks.join(next_, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to"), (F.col("to") != F.col("_t")).alias("moved")), "doubled", nodes)
            scratch.drop(hooks)
            hooks = doubled
            if not hooks.filter("moved").take(1):
                break
        if labels is None:
            labels = scratch.keep(hooks.select("node", F.col("to").alias("component")), "labels", nodes)
        else:
            next_ = hooks.select(F.col("node").alias("_n"), "to")
            new = labels.join(next_, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("to", "component").alias("component"))
            old, labels = labels, scratch.keep(new, "labels", nodes)
            scratch.drop(old)
        lo, hi = (hooks.select(F.col("node").alias(f"_{k}"), F.col("to").alias(f"_{k}to")) for k in ("lo", "hi"))
        moved = edges.join(lo, F.col("lo") == F.col("_lo")).select(F.col("_loto").alias("x"), "hi").join(hi, F.col("hi") == F.col("_hi")).select("x", F.col("_hito").alias("y"))
        moved = moved.filter("x != y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
        old, edges = edges, scratch.keep(moved, "links", rows)
        scratch.drop(old, hooks)
        if not edges.take(1):
            scratch.drop(edges)
            return labels
