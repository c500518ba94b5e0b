"""The mart of the incremental source: three tables with keys, appended batch by batch, in steps that may be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators import tables


def _schema(texts: Sequence[str], **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, others.get(n, T.StringType())) for n in texts])


#: The mart's tables with their columns, and what identifies a row of each.
JOBS = _schema(["source_job_id", "source", "company", "job_title_canonical", "occupation_group_final", "occupation_family_final", "seniority", "city_clean", "country_clean", "location_final", "skills_count_final", "crawl_batch", "job_url", "job_link"], skills_count_final=T.IntegerType())
SKILLS = _schema(["source_job_id", "skill", "job_title_canonical", "company", "occupation_group_final", "occupation_family_final", "seniority", "city_clean", "country_clean", "location_final", "crawl_batch"])
BATCHES = _schema(["crawl_batch", "processed_at"], processed_at=T.TimestampType())
MART = {"jobs": (JOBS, ["source_job_id"]), "job_skills": (SKILLS, ["source_job_id", "skill"]), "batches": (BATCHES, ["crawl_batch"])}
#: The most new keys that are broadcast to find those that the mart has.
MOST_BROADCAST = 500_000


def jobs_table(gold: DataFrame) -> DataFrame:
    """The postings of a Gold batch: all columns there, stripped, counts as numbers, no blank key, one row per key."""
    rows = tables.ensure_columns(gold, JOBS.names).withColumn("skills_count_final", tables.coerce_int(F.col("skills_count_final")))
    rows = tables.strip_text(rows, [n for n in JOBS.names if n != "skills_count_final"]).where("source_job_id <> ''")
    return tables.keep_first(rows, ["source_job_id"], [F.col(n) for n in JOBS.names[1:]])


def job_skills_table(gold: DataFrame) -> DataFrame:
    """One row per posting and skill of a Gold batch, with the posting's nine attributes; blank keys go. Postings are moved to their key before
    they become a row for each skill, which then needs no more moving."""
    rows = tables.strip_text(tables.ensure_columns(gold, [n for n in SKILLS.names if n != "skill"] + ["skills_canonical"]), [n for n in SKILLS.names if n != "skill"])
    return tables.mart_job_skills(rows.withColumnRenamed("skills_canonical", "skills").repartition("source_job_id"), SKILLS.names[2:]).select(*SKILLS.names)


def with_checked_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows as they are, but a null, blank or repeated key is an error when they are written: found in the same pass, over the partitioning by
    key that the rows' own dedup has left."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    told = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    bad = blank | (F.col("_n") > 1)
    first = rows.columns[0]
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"a key of ({', '.join(keys)}) is blank or not unique: "), told)).cast(rows.schema[first].dataType)).otherwise(F.col(first))
    return rows.withColumn("_n", n).withColumn(first, checked).drop("_n")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the mart, empty before its first batch."""
    schema, _ = MART[name]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], most: int = MOST_BROADCAST) -> DataFrame:
    """The rows of new whose keys existing doesn't have. As a batch is small and a mart is large, up to `most` new keys are broadcast and only the
    keys that both have are left of the mart, which isn't shuffled then."""
    wanted = new.select(*keys).distinct()
    if wanted.limit(most + 1).count() <= most:
        existing = existing.select(*keys).join(F.broadcast(wanted), list(keys), "left_semi")
    return tables.insert_if_absent(new, existing, keys)


def append(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Adds the rows whose keys the table doesn't have; rows that are there win. Once more changes nothing."""
    schema, keys = MART[name]
    rows = rows.select(*schema.names)
    # A table without rows has none of the keys; asking it would make the rows once more.
    existing = read_table(spark, root, name)
    new = with_checked_keys(rows if existing.isEmpty() else absent(rows, existing, keys), keys)
    new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(f"{root}/{name}")


#: The steps of a batch, in their order.
STEPS = ["jobs", "job_skills", "batches"]


def append_batches(gold: DataFrame, root: str, at: Column | None = None, after_step=None) -> list[str]:
    """Brings the batches of gold that the ledger doesn't have into the mart at root: postings, then skills, each by key, and the ledger last. A
    run that stops between two steps is made good by running again, as what is there stays and the ledger tells only what is whole. Returns the batches;
    `after_step` is called with each step's name."""
    spark = gold.sparkSession
    names = gold.select("crawl_batch").where("trim(crawl_batch) <> ''").distinct()
    new = [r[0] for r in names.join(read_table(spark, root, "batches"), "crawl_batch", "left_anti").orderBy("crawl_batch").collect()]
    if not new:
        return []
    # The names of the pending batches are few; the rows themselves are read once for each table.
    rows = gold.where(F.col("crawl_batch").isin(new))
    ledger = rows.select("crawl_batch").distinct().select("crawl_batch", (F.current_timestamp() if at is None else at).alias("processed_at"))
    for step, build in zip(STEPS, (lambda: jobs_table(rows), lambda: job_skills_table(rows), lambda: ledger), strict=True):
        append(spark, root, step, build())
        if after_step:
            after_step(step)
    return new


def counts(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, n) of the mart at root."""
    return tables.mart_counts({name: read_table(spark, root, name) for name in MART})


