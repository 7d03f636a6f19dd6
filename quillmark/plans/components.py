"""Connected components by repeated contraction, entirely in DataFrame joins.

Every round maps a vertex to the smallest vertex among itself and its neighbours, follows that
map once more, and contracts the edges.  A star contracts in one round and a chain of n vertices
in O(log n); only the emptiness of the edge set returns to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a long, b long`` to ``node, label``; label is the smallest node of the component.

    Loops and repeated edges are ignored, null ends are ignored, and vertices without an edge to
    another vertex do not appear.  An empty input gives an empty result.
    """
    cur = stash(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", thin=True
    )
    labels = None
    while True:
        seen = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        hop = step.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        step2 = stash(step.join(hop, "m").select("node", F.col("mm").alias("to")), "jump", thin=True)
        left = step2.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step2.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        nxt = (
            cur.join(left, "a").join(right, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        nxt = stash(nxt, "edges", thin=True)
        if labels is None:
            labels = step2.select("node", F.col("to").alias("label"))
        else:
            follow = step2.select(F.col("node").alias("label"), "to")
            labels = labels.join(follow, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        discard(cur)
        cur = nxt
        if cur.isEmpty():
            discard(cur)
            return labels
