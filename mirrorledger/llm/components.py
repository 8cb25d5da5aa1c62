"""Connected components of a link table by alternating star contraction. No links or labels reach the driver."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..workspace import new_path
from .rows import unsent


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The table written to the shared folder, which cuts its lineage, and its row count and checksum."""
    spark, path, seen = edges.sparkSession, new_path(edges.sparkSession, "links"), Observation()
    total = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("s")).write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), (seen.get["n"], seen.get["s"])


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(unsent(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them. ``u > v`` in all rows."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(unsent(least, n), "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with u > v. Returns (u, v) with v the smallest node of u's component, for all u but the smallest."""
    edges, state = _written(links.distinct())
    while state[0]:
        edges, now = _written(_small_star(_large_star(edges, state[0]), state[0]))
        if now == state:
            break
        state = now
    return edges
