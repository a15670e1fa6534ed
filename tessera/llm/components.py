"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a join and an aggregate; vertices of very high degree are pre-aggregated
before the shuffle and their joins read stored tables, so the adaptive skew join can
split them.  Nothing is collected on the driver but one row of counts per round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Null ends and loops are ignored; repeated edges are harmless; no edges give no rows.  Each
    round deletes the tables of the one before; the last one's go with the caller's ``scratch``."""
    scratch, caller = Scratch(), scratch
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, "edges")
    while True:
        # Large star: each vertex links its larger neighbours to its smallest one.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: each vertex links its smaller neighbours and itself to the smallest.
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.keep(small, "small")
        scratch.clear(e)
        # Done when no vertex has two smaller ends and none of those ends has a smaller one.
        n, heads = e.agg(F.count("*"), F.count_distinct("u")).first()
        deep = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi").limit(1).count()
        if n == heads and not deep:
            if caller:
                caller.tables.append(e)
            roots = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
