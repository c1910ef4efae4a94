"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import settled


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b): the smallest node that it can reach.

    Rounds of stars: every node hands its larger neighbours to its smallest one, then every node hands
    its smaller neighbours to the smallest. Each round is written to the shared folder. A node's
    smallest neighbour is a partial aggregate and reaches the links by a join whose hot side adaptive
    execution can split, so no neighbourhood is gathered anywhere. Links with a null end and loops are
    ignored; an empty table has no nodes. Ends until a round changes nothing.
    """
    edges = settled(
        links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        .where("a is not null and b is not null and low < high").distinct(), "links")
    mark = None
    while True:
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(edges.select("high", "low"))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        parents = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(parents, "high")
        edges = settled(
            small.select(F.col("low").alias("high"), F.col("m").alias("low")).where("low < high")
            .unionAll(parents.select("high", F.col("m").alias("low"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(roots)
