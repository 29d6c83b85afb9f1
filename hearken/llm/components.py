"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` to `(id, component_id)`, the smallest id reachable, for each linked id.

    Rounds of large and small stars (Kiveris et al. 2014): each id is linked to the smallest
    id it sees, until every component is one star. A round is two grouped minima; no group is
    ever gathered. The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        # large star: larger neighbours of an id are linked to the least id around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # small star: an id and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))))
            .select(F.col("col.b").alias("a"), F.col("col.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = stored(small, "stars")
        rows, ids = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if rows == ids and not _chained(edges):
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)


def _chained(edges: DataFrame) -> bool:
    """Whether some id is both a centre and linked to a smaller one."""
    centres = edges.select(F.col("b").alias("a")).distinct()
    return not edges.join(centres, "a", "left_semi").isEmpty()
