"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written


def components(links: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """keys, node, root (the smallest node reachable) of all nodes in `links` (keys, a, b), and the number of rounds.

    A round hooks every node to its smallest neighbour, if that is smaller, jumps along the hooks to their end by doubling, and
    drops links inside what has merged.  Only nodes without a smaller neighbour are left, at most half of them, so there are
    at most log n rounds of log n jumps; the tables of a round go when the next one is written.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = written(links.select(*keys, *ends).where("a != b").distinct())
    nodes = written(edges.select(*keys, F.col("a").alias("node")).union(edges.select(*keys, "b")).distinct().withColumn("root", F.col("node")))
    rounds = 0
    while edges.limit(1).count():
        rounds += 1
        both = edges.select(*keys, "a", "b").union(edges.select(*keys, "b", "a"))
        # a node without a smaller neighbour is a root of this round; others follow their smallest neighbour
        hooked = written(both.groupBy(*keys, F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("a")).alias("y")))
        jump = hooked
        while True:  # to the end of the hooks: each step doubles the way
            far = written(jump.select(*keys, "x", "y").join(jump.select(*keys, F.col("x").alias("y"), F.col("y").alias("z")), [*keys, "y"]).select(*keys, "x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")))
            discard(jump)
            jump = far
            if not jump.where("moved").limit(1).count():
                break
        moved = written(nodes.join(jump.select(*keys, F.col("x").alias("root"), F.col("y").alias("z")), [*keys, "root"], "left").select(*keys, "node", F.coalesce("z", "root").alias("root")))
        left = edges.join(jump.select(*keys, F.col("x").alias("a"), F.col("y").alias("za")), [*keys, "a"]).join(jump.select(*keys, F.col("x").alias("b"), F.col("y").alias("zb")), [*keys, "b"])
        fewer = written(left.where("za != zb").select(*keys, F.least("za", "zb").alias("a"), F.greatest("za", "zb").alias("b")).distinct())
        for old in (edges, nodes, jump):
            discard(old)
        edges, nodes = fewer, moved
    discard(edges)
    return nodes, rounds
