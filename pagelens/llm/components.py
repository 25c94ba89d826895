"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import pulled
from pagelens.scratch import remove, written


def _star(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """edges (u, v), u > v. Large star: link each larger neighbour of a node to the node's least
    neighbour. Small star: link each smaller neighbour, and the node, to it."""
    spread = F.xxhash64("u", "v")
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        out = pulled(edges, least, "u", total, spread).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = pulled(both, least, "u", 2 * total, spread).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the least node reachable.

    Nulls link nothing, self links and repeated links are ignored, an empty table gives an empty
    result. The minima of a hot node combine before the shuffle and go back to its links by broadcast
    (common.pulled). Each round is a written table, which the next one replaces. The number of rounds
    grows with the logarithm of the graph; reaching `rounds` raises rather than returning a partial
    answer.
    """
    spark = edges.sparkSession
    now, path = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            roots = now.groupBy("v").agg(F.lit(1).alias("_")).select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen, old = mark, path
        now, path = written(_star(_star(now, mark[0], small=False), mark[0], small=True), "links")
        remove(spark, old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
