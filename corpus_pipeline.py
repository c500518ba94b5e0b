"""A training corpus from the documents table, in five stages. Each takes all that the one before kept and returns
rows of documents; the last returns packed pieces.

Cases: null and empty texts aren't toxic, have one line, are in no group of near copies, and have no word to be mixed; null and
repeated ids and repeated rows stay apart but for near copies; an empty table passes every stage. Python workers get at most
BATCH_ROWS whole texts at once: the stages set spark.sql.execution.arrow.maxRecordsPerBatch for their session, as a
DataFrame reads it when it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import jaccard, lines, mixing, packing, toxicity
from hirelake.llm.common import table
from hirelake.llm.components import saved


def _row(docs: DataFrame):
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


#: Rows of whole texts that a Python worker holds at once, and words whose ids it keeps between tasks.
BATCH_ROWS, REMEMBERED = "1000", 300_000


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    _bound_batches(spark)
    return toxicity.score(docs.select(_row(docs)), model).where("score < 0.5").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each line that many documents share in one of them; the others' texts get shorter."""
    out = lines.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by word shingles: five words, similarity 0.8 or more."""
    _bound_batches(spark)
    return jaccard.keep_one(docs, percent=80, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources' words have the weights 1, 2, 3."""
    return mixing.mixed_rows(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every document into sequences of power-of-two length."""
    _bound_batches(spark)
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Learned scores and shingle components can't be told in SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, saved(docs) if i else docs, sf_dir)
    return docs
