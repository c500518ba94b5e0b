"""Line dedup: lines that many documents share stay in one of them.

Range partitions of the line keys, with a secondary sort by document and position, keep a common line's rows spread
over many tasks: a key that holds a third of all lines fills a third of the ranges. The first row of each (key,
document) run is counted inside its range, one small row per key and range goes on, and each key's verdict returns to
the ranges that hold the key, so no task ever sees more of a key than a range of it. What comes back to a
document is a sparse bitmap of its lines, 64 to a word, never text. All of it is DataFrame expressions.

Cases: a null or empty text is one empty line. Rows that share a doc_id count as one document for the
number of documents of a key, yet each row gets its own bitmap. A null doc_id is a document of its
own, smaller than any other. An empty table gives an empty result. Columns besides those named are
left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import BLANKS, ascii_lower, partitions
from hirelake.llm.components import saved

#: Lines in one word of a bitmap.
WORD_BITS = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _id(doc_id: Column, text: Column) -> Column:
    """A row's own identity: its doc_id with a hash of its text, so that repeated ids don't mix."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, th, pos): every line that is long enough, by a 128-bit key hash."""
    lines = docs.select(_id(F.col("doc_id"), F.col("text")).alias("id"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), F.col("id.doc_id").alias("doc_id"), F.col("id.th").alias("th"), "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, th, drops): for each row that loses lines, a map from word index to the bits of the
    lines to drop; a row or a word that isn't there keeps everything."""
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    # Saved, as both the heads and the lost lines come from it, and a range's number must not change.
    ranged = occurrences(docs, min_chars).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "pos")
    ranged = saved(ranged.withColumn("range", F.spark_partition_id()))
    # A range keeps the whole of a (key, document) run, so its first row and a key's documents are counted without a shuffle.
    firsts = ranged.groupBy("h1", "h2", "doc_id", "range").agg(F.min("pos").alias("first_pos"))
    held = saved(firsts.groupBy("h1", "h2", "range").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("head")))
    heads = held.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("head").alias("head")).where(F.col("n_docs") >= min_docs)
    told = held.select("h1", "h2", "range").join(heads.select("h1", "h2", "head"), ["h1", "h2"])
    lost = ranged.join(told, ["h1", "h2", "range"]).where(~F.col("doc_id").eqNullSafe(F.col("head")))
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD_BITS} as int))")
    words = lost.groupBy("doc_id", "th", F.expr(f"pos div {WORD_BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def is_dropped(drops: Column, pos: Column) -> Column:
    """Whether the bitmap drops the line at pos."""
    bits = F.coalesce(F.try_element_at(drops, F.floor(pos / WORD_BITS).cast("int")), F.lit(0).cast("long"))
    return F.getbit(bits, (pos % WORD_BITS).cast("int")) == 1


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of docs (doc_id, text and any others, in a struct `row`) with its lines, how many it
    loses and the text that is left."""
    maps = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(F.struct("doc_id", "th").alias("drop_id"), "drops")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("id", _id(F.col("row.doc_id"), F.col("row.text")))
    joined = rows.join(maps, rows["id"].eqNullSafe(maps["drop_id"]), "left")
    lines = split_lines(F.col("row.text"))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda _, i: ~is_dropped(F.col("drops"), i)))
    out = joined.select("row", lines.alias("lines"), kept.alias("kept"))
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
