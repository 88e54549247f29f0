"""Connected components of a link table, by rounds of minimum labels and pointer jumping.

No link or component is ever collected to the driver: a round is two joins whose sums are combined
before they are shuffled, and every round is cut into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Links may point either way, repeat or join a node with itself. Each round, a node takes the
    smallest label among its own, its neighbours' and, by a jump, its label's label; the number of
    rounds grows with the logarithm of the longest path.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        # What neighbours offer also lowers the label itself, so whole stars move at once.
        offers = hooked.groupBy(F.col("was").alias("root")).agg(F.min("to").alias("offer"))
        moved = hooked.join(offers, hooked["to"] == offers["root"], "left").select("node", F.least("to", F.coalesce("offer", "to")).alias("label"), "was")
        moved = cut(moved)
        if moved.where(F.col("label") < F.col("was")).isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
