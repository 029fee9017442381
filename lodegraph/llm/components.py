"""Connected components by alternating large-star and small-star.

Large-star joins every node's larger neighbours to the least node of its
neighbourhood; small-star joins its smaller neighbours and itself to the least of
them. Both keep the components. Alternated, they end in stars around each
component's least node after about log2 of the longest path rounds. Edges stay
distributed; each round is written to the shared folder, so a lost executor costs
at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import discard, materialise


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), in any orientation, repeated or loops: (u, v), v the least node of u's component, for every u but the least ones.

    An empty table gives an empty one; rows with a null end are no edges.
    """
    now = materialise(small_star(edges.where("u is not null and v is not null and u <> v")))
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now
        mark, before = seen, now
        now = materialise(small_star(large_star(before)))
        discard(before)
