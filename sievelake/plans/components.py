"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.plans.shared import forget, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links lead to; only nodes with a link are listed.

    Each round points every node at its smallest neighbour, shortens the pointers until they end at a root, and puts roots
    in place of the links' ends. Links inside a root's tree vanish, and every tree has two nodes or more, so at least half
    of the nodes are gone after a round and the rounds work on ever smaller tables. All of them are written; only whether
    anything is left reaches the driver. Nodes of very many links are pre-aggregated before the shuffle, and the pointers'
    side of every join has one row a node, so adaptive execution can split the other.
    """
    one = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null and a <> b")
    # greatest and least skip nulls, so a link with one end would be a loop, which goes
    edges = written(one.distinct(), "links")
    labels: DataFrame | None = None
    while labels is None or edges.limit(1).count():
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        roots = _rooted(written(near.select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "pointers"))
        of = lambda x: roots.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))  # noqa: B023, E731
        moved = edges.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b")
        fewer = written(moved.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "links")
        if labels is None:
            labels, old = roots, []
        else:
            old = [labels, roots]
            onward = roots.select(F.col("node").alias("at"), F.col("component").alias("to"))
            labels = written(labels.join(onward, labels["component"] == onward["at"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        forget(edges, *old)
        edges = fewer
    forget(edges)
    return labels


def _rooted(pointers: DataFrame) -> DataFrame:
    """Pointers (node, component) followed to their ends, by doubling."""
    while True:
        jump = pointers.select(F.col("node").alias("at"), F.col("component").alias("to"))
        new = written(pointers.join(jump, pointers["component"] == jump["at"]).select("node", F.col("to").alias("component"), (F.col("to") != F.col("component")).alias("moved")), "pointers")
        forget(pointers)
        pointers = new.select("node", "component")
        pointers._written = new._written
        if not new.where("moved").limit(1).count():
            return pointers
