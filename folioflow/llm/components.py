"""Connected components by alternating large-star and small-star steps, all on DataFrames.

The least neighbour of each node is aggregated before its shuffle and written; the join that ties a node's neighbours to it then has a plain
exchange on either side, so adaptive execution can split the rows of a hub with very many neighbours. A round writes three tables; whether it
changed anything is told by a count and a sum of hashes taken while its links are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioflow.plans.materialize import spill

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = spill(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = spill(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    tied = down.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and what tells two sets of links apart."""
    seen = Observation()
    kept = spill(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return kept, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the least node reachable. Nodes without links aren't listed."""
    edges, seen = _written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        edges, now = _written(_small(_large(edges)))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
