"""Connected components of a link table by contraction.

Each round every node points at its least neighbour, pointers are doubled until they reach the roots of their trees,
and trees become the nodes of the next round. No node is left alone by a round, so each component's nodes at least
halve and rounds are logarithmic whatever the diameter.

No node, link or label comes to the driver: each step is a join and an aggregate, its result is written to the
shared folder, and only whether rows are left is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def roots_of(live: DataFrame) -> DataFrame:
    """node, root of the trees that pointers to least neighbours make; ``live`` has x, y in both directions.

    A pointer's pointer is never above its node, so the only cycles are pairs, and the lesser one is the root.
    """
    near = live.groupBy("x").agg(F.min("y").alias("to"))
    back = near.select(F.col("x").alias("to"), F.col("to").alias("back"))
    first = near.join(back, "to").select(F.col("x").alias("node"), F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("root"))
    roots = materialise(first, "roots")
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialise(roots.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        discard(roots)
        if not jumped.where("moved").limit(1).count():
            return jumped
        roots = jumped


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node of its component) for every node of a link."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    live = materialise(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or live.limit(1).count():
        roots = roots_of(live)
        rounds.append(roots)
        x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("x", "y"))
        moved = live.join(x, "x").join(y, "y").select(F.col("x_root").alias("x"), F.col("y_root").alias("y"))
        left = materialise(moved.where("x <> y").distinct(), "links")
        discard(live)
        live = left
    whole = rounds.pop()
    while rounds:  # a tree that had no links left is in no later round
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("last"))
        done = whole, rounds.pop()
        whole = materialise(done[1].join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
        discard(*done)
    least = whole.groupBy("root").agg(F.min("node").alias("label"))
    labels = materialise(whole.join(least, "root").select("node", "label"), "labels")
    discard(whole, live)
    return labels
