"""Incremental batches as streams over files: every pending file once, through Silver and Gold into the mart."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hirelake.operators import mart, silver
from hirelake.operators.tables import insert_if_absent, keep_first
from hirelake.sources import files

#: What a landed posting holds.
POSTING = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "title", "company", "location", "link")] + [T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("crawl_batch", T.StringType())])


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def append_new_rows(target: str, keys: Sequence[str], order: Sequence) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the first row per key and appends what the target lacks; a replayed batch adds nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        new = keep_first(batch, keys, order)
        if files.exists(batch.sparkSession, target):
            new = insert_if_absent(new, batch.sparkSession.read.parquet(target), keys)
        new.write.mode("append").parquet(target)

    return sink


def silver_gold_mart(root: str, at: Column | None = None, after_step: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that takes raw postings through the incremental source's Silver and Gold layers (written by batch, a batch's own partition anew each
    time) into the mart. Every step may be repeated: a micro-batch that failed half way is run again whole, and changes only what is missing."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        built = silver.incremental_silver(batch).where("trim(crawl_batch) <> ''")
        if batch.isEmpty():
            return
        names = [r[0] for r in batch.select("crawl_batch").where("trim(crawl_batch) <> ''").distinct().collect()]
        files.write_layer(built, root, "silver")
        (after_step or (lambda s: None))("silver")
        mine = F.col("crawl_batch").isin(names)
        files.write_layer(silver.gold(files.read_layer(spark, root, "silver").where(mine)), root, "gold", dealt=True)
        (after_step or (lambda s: None))("gold")
        if files.exists(spark, files.layer_path(root, "gold")):
            mart.append_batches(files.read_layer(spark, root, "gold").where(mine), f"{root}/mart", at, after_step)

    return sink


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes everything that is there, once."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_mart(spark: SparkSession, landing: str, root: str, at: Column | None = None, files_a_time: int = 1000, after_step: Callable[[str], None] | None = None) -> StreamingQuery:
    """Takes the batches that have landed since the last run into the layers and the mart at root. Runs on one root go on where the last one
    stopped: its state is kept there. A batch is one file, in a folder crawl_batch=<name>, so it is always whole in its micro-batch."""
    stream = stream_files(spark, landing, POSTING, maxFilesPerTrigger=str(files_a_time))
    return run_available(stream, f"{root}/state", silver_gold_mart(root, at, after_step))
