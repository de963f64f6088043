"""Connected components of an edge table, by alternating star contraction with nothing but joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, materialise

#: Each round at least halves the distance to a root, so this is beyond any table; it only stops a loop gone wrong.
MOST_ROUNDS = 100


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (a long, b long); root is the smallest node that it is connected with.

    Rows with a null end and loops are ignored; repeated edges are harmless; no edges give no rows.  Every round is written
    to the shared folder, so a lost executor costs one round at most, and no node's neighbours are gathered in one place.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    seen = None
    for _ in range(MOST_ROUNDS):
        # Large star: every neighbour above a node moves to the smallest neighbour of that node.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("center")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), "m")
        moved = large.join(lower, F.col("u") == F.col("center")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, materialise(moved.select("e.u", "e.v").where("u <> v").distinct(), name)
        discard(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("star contraction did not end")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
