"""Connected components of an edge table, without collecting any of it.

Labels spread by minimum over neighbours, with a pointer jump each round, so the
rounds grow with the logarithm of the longest path.  Each round is written to the
shared scratch folder, which keeps the lineage short; the one before it is then
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.session import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` of edges ``a, b``: the least node of the component. Nodes without an edge don't appear.

    Null ends are ignored; an edge from a node to itself makes a component of one.
    """
    one_way = edges.filter("a is not null and b is not null").select("a", "b")
    both = written(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels"
    )
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        moved = written(
            step.join(jump, "to", "left").select("node", F.least("to", "beyond").alias("component"), "before"), "labels"
        )
        changed = moved.filter("component <> before").limit(1).count()
        discard(labels)
        labels = moved
        if not changed:
            discard(both)
            return labels.select("node", "component")
    raise RuntimeError("connected_components: not settled; raise max_rounds")
