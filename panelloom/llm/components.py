"""Connected components of a links table, by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import materialize, materialize_counted


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) per node of ``links``; component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows those pointers to their ends by doubling, and contracts
    the links. Every table is written to the shared folder, so no lineage grows and a lost executor costs one step.
    Null ends and self-links are ignored; an empty table gives no rows.
    """
    edges, seen = materialize_counted(
        links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    )
    left, labels = seen["n"], None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("parent")))
        moved = 1 if left else 0
        while moved:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped, seen = materialize_counted(
                parent.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("went")),
                moved=F.sum(F.col("went").cast("long")),
            )
            parent, moved = jumped.select("node", "parent"), seen["moved"] or 0
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), F.col("parent").alias("top"))
            labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
        if not left:
            return labels
        px, py = parent.select(F.col("node").alias("x"), F.col("parent").alias("px")), parent.select(F.col("node").alias("y"), F.col("parent").alias("py"))
        edges, seen = materialize_counted(
            edges.join(px, "x").join(py, "y").where("px <> py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct()
        )
        left = seen["n"]
        if not left:
            return labels
