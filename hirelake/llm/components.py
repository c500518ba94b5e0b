"""Connected components of an edge table, by alternating large and small stars, and the checkpoints that
iterative operators cut their lineage with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import partitions


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder that spark.checkpoint.dir names; without one it is an error on a cluster, as no
    machine's own folder outlives the machine. A session that runs in one process may use its warehouse."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


#: Edges in a partition, at least, while there are partitions enough.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the smallest node that it reaches. Each round
    links every node to the smallest one near it; rows never exceed twice the edges, and a node with many edges
    is aggregated before its shuffle."""
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        # Few edges in many partitions are many tiny files at each exchange.
        n = min(partitions(edges.sparkSession), now[0] // EDGES + 1)
        edges = edges.coalesce(n)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n).distinct().coalesce(n)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u <> v").coalesce(n).distinct().coalesce(n))
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
