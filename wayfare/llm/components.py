"""Connected components of links by alternating large and small stars (Kiveris et al. 2014).

Each half-round hangs neighbours on the smallest id they know. Rounds are written to the shared
folder; the driver sees a count and a checksum. Hubs are joined with plain equi-joins that Spark
can split, so a component with a third of all ids needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    Links may repeat, stand in either order, or join an id to itself. Nulls are left out.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = links.filter("a is not null and b is not null").select(low, high)
    ids = links.filter("a = b").select(F.col("a").alias("id"))
    edges, before = staged(links.filter("a < b").distinct(), "links"), None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.least("m", "a").alias("m"), "b")
        large = large.filter("m < b").select(F.col("m").alias("a"), "b").distinct()
        # Small star: every id keeps the least of its smaller neighbours, the others hang on that.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.col("m"), F.explode(F.array("a", "b")).alias("v")
        )
        small = small.filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = staged(small.distinct(), "links")
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    leaves = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    alone = ids.select("id", F.col("id").alias("component"))
    found = roots.unionByName(leaves).unionByName(alone)
    return found.groupBy("id").agg(F.min("component").alias("component"))
