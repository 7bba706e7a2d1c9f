"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.workspace import Workspace

#: Links for which a task writes labels, so that a small graph is not dealt to many files.
LINKS_A_FILE = 100_000


def connected_components(edges: DataFrame, src: str, dst: str, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label of
    that label. The joins are plain equi-joins, which adaptive execution splits
    on a hub, and the minima combine before the shuffle. Every round's labels
    are a written table. Nodes without an edge do not appear; null ends and
    loops are ignored.
    """
    a, b = F.col(src), F.col(dst)
    both = edges.select(a.alias("a"), b.alias("b")).unionByName(edges.select(b.alias("a"), a.alias("b")))
    links = work.table(both.where("a <> b").distinct(), f"{name}-links")
    files = max(1, -(-links.count() // LINKS_A_FILE))
    first = links.groupBy("a").agg(F.min("b").alias("m"))
    labels = work.table(first.select(F.col("a").alias("node"), F.least("a", "m").alias("component")).coalesce(files), f"{name}-0")
    round_no = 0
    while True:
        round_no += 1
        label_of = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = links.join(label_of, "b").groupBy("a").agg(F.min("c").alias("c"))
        up = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("up"))
        tops = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        moved = up.join(tops, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("component"))
        after = work.table(moved.coalesce(files), f"{name}-{round_no}")
        still = after.where("component < old").limit(1).count()
        work.drop(f"{name}-{round_no - 1}")
        labels = after.select("node", "component")
        if not still:
            work.drop(f"{name}-links")
            return labels
