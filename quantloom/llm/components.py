"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import scratch, settled

#: No table of fewer than 2^64 nodes needs more: the trees left at least halve
#: in two levels, and the depth of a tree halves in every jump.
MOST_LEVELS, MOST_JUMPS = 130, 66


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of ``links`` (a, b)."""
    return settled(lambda: _components(links), "components")


def _components(links: DataFrame) -> DataFrame:
    """In each level every node hooks to its smallest neighbour if that is smaller,
    the trees shrink to their roots by pointer jumping, and the links between
    different roots are the next level's.  A root without smaller neighbours
    that nothing hooks to has one in the next level.  So the levels grow with
    the logarithm of the nodes, whatever the length of a chain, and the loop
    ends when no link is left.  Every step is written to the shared folder.
    """
    links = scratch(links.select("a", "b").distinct(), "links")
    levels = []
    while not levels or not links.isEmpty():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"components: links left after {MOST_LEVELS} levels")
        labels = _roots(links)
        levels.append(labels)
        mapped = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la <> lb")
        links = scratch(mapped.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    out = levels.pop()
    while levels:
        below = levels.pop().join(out.toDF("label", "top"), "label", "left")
        out = scratch(below.select("node", F.coalesce("top", "label").alias("label")), "labels")
    return out


def _roots(links: DataFrame) -> DataFrame:
    """node, label: the root of the tree that hooking to the smallest neighbour puts each node in."""
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    hooked = ends.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("least"))
    labels = scratch(hooked.select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(MOST_JUMPS):
        inner = labels.filter("node <> label").toDF("label", "far")
        new = labels.join(inner, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
        new = scratch(new, "labels")
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components: trees left after {MOST_JUMPS} jumps")
