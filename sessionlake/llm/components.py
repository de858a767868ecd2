"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlake.session import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), the root being the smallest node.

    Large-star and small-star in turn: each node hands its neighbours to the smallest
    node it knows, until every link is a spoke of a star. Links only get fewer. The
    table is written after each round, so a lost executor costs no earlier round.
    """
    edges = stage(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("node", "root").cast("bigint"))).first())
        if now == before:
            return edges
        before = now
        both = edges.union(edges.select(F.col("root"), F.col("node"))).toDF("at", "other")
        least = both.groupBy("at").agg(F.min("other").alias("low"))
        least = least.select("at", F.least("at", "low").alias("low"))
        larger = both.where("other > at").join(least, "at").select("other", "low")
        large = stage(larger.toDF("node", "root").distinct(), "large_star")
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(
            F.explode(
                F.array(F.struct("node", "low"), F.struct(F.col("root").alias("node"), "low"))
            ).alias("e")
        )
        edges = stage(
            small.select("e.node", F.col("e.low").alias("root")).where("node <> root").distinct(),
            "small_star",
        )
