"""Connected components of links between integer nodes, without gathering a component anywhere.

Links are kept as child -> parent with parent < child.  Each round gives every child its smallest parent and
links its other parents to that one, then lets every link skip to the parent's own smallest parent.  Rounds
are written to the shared folder; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import materialise


def roots(links: DataFrame) -> DataFrame:
    """links: a long, b long (any order, repeats allowed).  Returns node, root for every node that is not its own root."""
    a, b = F.col("a"), F.col("b")
    edges = materialise(links.where(a != b).select(F.greatest(a, b).alias("c"), F.least(a, b).alias("p")).distinct(), "links")
    while True:
        # the link to the smallest parent stays, any other parent is linked to that one in its place
        smallest = edges.groupBy("c").agg(F.min("p").alias("m"))
        star = edges.join(smallest, "c").select(F.when(F.col("p") == F.col("m"), F.col("c")).otherwise(F.col("p")).alias("c"), F.col("m").alias("p"))
        edges = materialise(star.distinct(), "star")
        least = materialise(edges.groupBy("c").agg(F.min("p").alias("up"), F.count("*").alias("n")), "least")
        hops = materialise(edges.join(least.select(F.col("c").alias("p"), "up"), "p", "left").select("c", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")), "hops")
        many = least.where("n > 1").limit(1).count()
        moved = hops.where("moved").limit(1).count()
        if not many and not moved:
            return edges.select(F.col("c").alias("node"), F.col("p").alias("root"))
        edges = materialise(hops.select("c", "p").distinct(), "links") if moved else edges
