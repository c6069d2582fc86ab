"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.sources.storage import discard, materialize


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component) of every node of edges(a, b); a component's name is its least id.

    Alternates large-star and small-star steps: every node is linked with the least neighbour seen so far, until
    all point to the least node of their component. The least neighbour comes from a partially aggregated minimum
    and a join, so that a hub's neighbours need not meet in one task. It goes on until nothing changes; with max_rounds
    given, it raises where they are not enough.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, rounds = None, 0
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v")
        old, links = links, materialize(small.distinct(), "links")
        discard(old)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rounds = now, rounds + 1
        if rounds == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    found = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
