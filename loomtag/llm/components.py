"""Connected components of an edge table by alternating large and small stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtag.llm.shared import cut


#: Edges of a partition: a small graph is one partition, where Spark needs no exchange, a large one many.
PARTITION_EDGES = 50_000


def _sized(edges: DataFrame, n: int) -> DataFrame:
    return edges.coalesce(1 + n // PARTITION_EDGES)


def _toward_least(edges: DataFrame, keep) -> DataFrame:
    """Every neighbour that `keep` selects is linked to the least node around its centre.

    The least neighbour is aggregated before the shuffle; the join back may be
    skewed on a hot centre and is split at run time.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u").where(keep)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of the undirected edges (u, v); the root is the least node reachable.

    Self-links and repeated edges are allowed; null ends are ignored. An empty
    edge table gives an empty result. Raises RuntimeError if the stars have not
    formed after most_rounds (each round at least halves the depth).
    """
    edges = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v"))
    edges, state = _sized(edges, edges.count()).distinct(), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _toward_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), F.lit(True))
        links = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(links.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges, state = _sized(edges, now[0]), now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
