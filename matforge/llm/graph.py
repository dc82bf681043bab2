"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable from each node of ``edges`` (columns ``a, b``).

    Each round takes the smallest label among the neighbours and then the label's own label, which halves the way to go; every
    round's table is written to the shared folder, and goes when the next one is there.  Nothing but whether a label changed
    reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    table = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    labels = table.select("id", "component")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("d"))
        new = written(step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("d", "c")).alias("component")), "labels")
        discard(table)
        table, labels = new, new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            discard(both)
            return labels
