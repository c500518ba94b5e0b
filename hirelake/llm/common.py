"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as a trim set.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    """How many partitions an explicit exchange gets: what the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on several columns, so that rows with a null key find their own."""
    cond = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def identity(text: Column) -> Column:
    """128 bits that tell texts apart, as two longs in a struct."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"))


def join_spread(rows: DataFrame, small: DataFrame, key: str, total: int, *spread: str) -> DataFrame:
    """rows joined with small (key, members, ...), which has one row per key and tells how many of the `total` rows have
    it. Keys of more than a partition's share, at most as many as there are partitions, are broadcast, and their rows
    go through the join of the others by a hash of the columns `spread`, so a key with a third of all rows isn't one task."""
    share = max(total // partitions(rows.sparkSession), 1)
    told = [c for c in small.columns if c not in (key, "members")]
    hot = F.broadcast(small.where(F.col("members") > share).select(key, F.struct(*told).alias("hot")))
    cold = small.where(F.col("members") <= share).select(F.col(key).alias("j"), F.lit(False).alias("spread"), F.struct(*told).alias("cold"))
    found = rows.join(hot, key, "left").withColumn("spread", F.col("hot").isNotNull())
    found = found.withColumn("j", F.when(F.col("spread"), F.xxhash64(*spread)).otherwise(F.col(key)))
    return found.join(cold, ["j", "spread"], "left").select(*rows.columns, *[F.coalesce(F.col("hot")[c], F.col("cold")[c]).alias(c) for c in told])
