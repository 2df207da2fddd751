"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geozone.session import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of `links` (a, b: bigint) that is not itself the smallest of its component.

    Rounds of large-star and small-star contraction: each node's links are moved to its smallest neighbour until
    only stars are left, after about log(longest path) rounds. Only minima are taken per node, so a node with very
    many links is combined before the shuffle, and its join is one that adaptive execution can split. Each round is
    a table in the shared folder, which also cuts the lineage.

    Nulls and loops are left out; repeated links count once; no links give no rows.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = written(links, name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
