"""Connected components by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links(a, b), a row for each linked node; the label is the smallest node of the component.

    Each round takes the smallest label around every node and then follows that label's own label, so long chains
    halve; a round's table is written to the shared folder. Null ends and self links are ignored. The edges of a
    hub are one key of a plain join, which adaptive execution splits.
    """
    ends = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    label = materialize(label, "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        low = label.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        up = label.select(F.col("node").alias("at"), F.col("label").alias("up"))
        best = F.least("low", F.coalesce("up", "low"))
        new = materialize(low.join(up, F.col("low") == F.col("at"), "left").select("node", best.alias("label"), (best != F.col("label")).alias("moved")), "labels")
        if not new.where("moved").limit(1).count():
            return new.select("node", "label")
        label = new.select("node", "label")
