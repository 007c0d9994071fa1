"""Connected components of a table of links, by labels that spread along links and jump ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetable.session import staged


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among neighbours (combined before the exchange, so a node of very many links
    is no hot group), then replaces it by that label's own label; the number of rounds follows the logarithm of the
    longest path. Rounds are written to the shared folder, so lost executors cost one round and plans stay short.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-links")
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{label}-labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        spread = now.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        spread = staged(spread, f"{label}-spread")
        jump = spread.select(F.col("node").alias("c"), F.col("c").alias("far"))
        new = staged(spread.join(jump, "c").select("node", F.least("c", "far").alias("component"), F.col("component").alias("was")), f"{label}-labels")
        if new.where(F.col("component") < F.col("was")).isEmpty():
            return new.select("node", "component")
        now = new.select("node", "component")
