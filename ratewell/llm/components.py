"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    In each round every node hangs itself on the smallest among itself and its neighbours, the trees
    that arise are flattened, and links between different roots are the table of the next round. A
    root that is left after two rounds has taken in another node or has hung itself on one, so two
    rounds leave half of the nodes that still have links, at most: rounds grow with the logarithm of
    the longest chain, and each one's tables are smaller. They end when no link is left, without a
    cap. Each round is written to the shared folder. Null ends are not allowed; repeated links and
    links of a node to itself do no harm.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    rounds = []
    while True:
        up = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("up"))
        up = _flattened(materialize(up, "labels"))
        rounds.append(up)
        both = both.join(up.select(F.col("node").alias("a"), F.col("up").alias("of_a")), "a")
        both = both.join(up.select(F.col("node").alias("b"), F.col("up").alias("of_b")), "b")
        both = both.where("of_a != of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        both = materialize(both.distinct(), "links")
        if both.isEmpty():
            break
    found = rounds.pop().withColumnRenamed("up", "component")
    while rounds:  # a root without further links has no row in the next round
        up = rounds.pop()
        found = up.join(found.withColumnRenamed("node", "up"), "up", "left")
        found = materialize(found.select("node", F.coalesce("component", "up").alias("component")), "labels")
    return found


def _flattened(up: DataFrame) -> DataFrame:
    """Every node's root; each step takes twice as many links of a tree as the one before."""
    while True:
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = up.join(far, "up").select("node", F.col("up").alias("was"), F.col("far").alias("up"))
        step = materialize(step, "labels")
        up = step.select("node", "up")
        if step.where("up != was").isEmpty():
            return up
