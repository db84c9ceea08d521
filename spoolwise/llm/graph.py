"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scans import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``node``, ``root``: for every node of a link, the least node it can reach. Nodes of any orderable type.

    Alternating large-star and small-star rounds; each links nodes nearer to the least one and drops repeated links
    before the shuffle, so a node with very many links is never gathered. Rounds grow with the logarithm of a
    component's diameter; each is written to the shared folder. A link with a null end, or to itself, links nothing.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut_lineage(both.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if not edges.head(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most):
        # large star: everything greater than u beside it goes to the least node beside u
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the lesser nodes beside u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut_lineage(new)
        same = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        was = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = new
        if same == was:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
