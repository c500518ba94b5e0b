"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, run through up to `max_epochs` times. A queue is served in packets
of at most `quantum` words (a packet never crosses documents). A packet's virtual finish time is the number of its
source's words up to its end, divided by the source's weight. All packets are range-sorted by finish time, summed up
range by range, and the queue is truncated where the running total meets the budget, the size of all documents: what
finishes by that time is in the mix. `mix` lets the packets in service at the cut count in part, by their words' own finish times, so the sum over all
documents is the budget (words that finish at the very same time go together), and a source is off its target by less than
1 + weight * sources / sum of weights words. A source that is smaller than its share runs out, and what it can't give goes to
the others, as their packets come next. Only (finish, words) rows are ranged; what a document gets follows from the
cut alone.

The running totals of a source are two-level: totals per (source, shuffle chunk), then within one chunk, so a
source that holds a third of all rows is spread over `chunks` tasks. All of it is DataFrame expressions; the driver
sees one row per step.

`target` is what a source is entitled to, from one row per source; nothing is cut by it.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; repeated rows are
documents of their own; a text longer than a packet is many packets; the shuffle depends on nothing but doc_id and
text, so reruns agree; columns besides doc_id, source and text are left out by `mix` and kept, whatever their names,
by `mixed_rows`. An empty table, or one without a word, gives rows with nothing taken, and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import partitions, word_count
from hirelake.llm.components import saved

#: Seed of the shuffle, and words in a packet.
SEED, QUANTUM = "mix-1", 64
#: The most bytes of sources' rows that a join broadcasts.
BROADCAST_BYTES = 16 << 20


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size). The weights repeat over
    the sources in code point order, null last. The budget is the size of everything. One row per
    source goes through the two windows here, never one per document.

    Sources fill up in the order of max_epochs * size / weight; source k is the last to fill if the
    time at which the rest would share the remaining budget isn't later than its own."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * max_epochs).withColumn("full_at", F.col("most") / F.col("weight"))
    line = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole, upto = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), line.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0)))
    per = per.withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    per = per.withColumn("time", F.col("left") / F.col("share"))
    # The first source, in filling order, that doesn't fill up by its time sets V*.
    per = per.withColumn("v", F.min(F.when(F.col("time") <= F.col("full_at"), F.struct("full_at", "time"))).over(whole)["time"])
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("v"))
    return per.select("source", "source_size", "weight", F.coalesce(target, F.col("most").cast("double")).alias("target"))


def queue(docs: DataFrame, chunks: int = 1024) -> DataFrame:
    """Every document (doc_id, source, size, key) with `before`: its source's words ahead of it. A column
    `row` goes along."""
    row = [c for c in docs.columns if c == "row"]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key"), *row)
    rows = rows.withColumn("chunk", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % chunks)
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("t_source"), F.col("chunk").alias("t_chunk"), F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0)).alias("chunk_before"))
    within = Window.partitionBy("source", "chunk").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(totals, rows["source"].eqNullSafe(totals["t_source"]) & (rows["chunk"] == totals["t_chunk"]))
    return joined.select("doc_id", "source", "size", "key", *row, (F.col("chunk_before") + F.col("within")).alias("before"))


def packets(line: DataFrame, max_epochs: int, quantum: int) -> DataFrame:
    """(finish, words) of every packet of every copy of line (size, before, source_size, weight)."""
    copies = line.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    parts = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / quantum))))
    end = F.least(F.col("size"), (F.col("part") + 1) * quantum)
    return parts.select(_finish(F.col("epoch"), end).alias("finish"), (end - F.col("part") * quantum).alias("words"))


def _finish(epoch: Column, end: Column) -> Column:
    """When the first `end` words of a row's copy are served."""
    return (F.col("source_size") * epoch + F.col("before") + end) / F.col("weight")


def cut_time(served: DataFrame, budget: int) -> float | None:
    """The finish time at which the running total of served (finish, words) meets the budget: ranges in order,
    then the packets of the one range that holds the cut. None without a packet."""
    ranged = saved(served.repartitionByRange(partitions(served.sparkSession), "finish").withColumn("range", F.spark_partition_id()))
    line = lambda column: Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("range").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(line("range")))
    here = totals.where(F.col("upto") >= budget).orderBy("range").first()
    if here is None:
        return None
    inside = ranged.where(F.col("range") == here["range"]).groupBy("finish").agg(F.sum("words").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(line("finish")) + (here["upto"] - here["words"]))
    return inside.where(F.col("upto") >= budget).agg(F.min("finish")).first()[0]


def _line(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, chunks: int, quantum: int) -> tuple[DataFrame, DataFrame, float | None]:
    """(every document's place in its queue, the sources' sizes, weights and targets, the time of the cut)."""
    line = saved(queue(docs.select("doc_id", "source", "text"), chunks))
    per = saved(source_targets(line, weights, max_epochs))
    budget = per.agg(F.sum("source_size")).first()[0]
    return line, per, cut_time(packets(_placed(line, per), max_epochs, quantum), budget) if budget else None


def _placed(line: DataFrame, per: DataFrame) -> DataFrame:
    """line with its source's row of per, which is broadcast while it is small, so rows of a large source stay where they are."""
    size = per.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 100)).first()[0] or 0
    per = per.withColumnRenamed("source", "p_source")
    per = F.broadcast(per) if size <= BROADCAST_BYTES else per
    return line.join(per, line["source"].eqNullSafe(per["p_source"])).drop("p_source")


def words_by(time: Column, weight: Column) -> Column:
    """How many words of a queue with that weight have finished by a time: the largest n with n / weight <= time."""
    near = F.floor(weight * time)
    return F.when((near + 1) / weight <= time, near + 1).when(near / weight <= time, near).otherwise(near - 1)


def word_time(per: DataFrame, cut: float, budget: int, max_epochs: int, quantum: int) -> float:
    """The cut to the word: packets in service at the cut count in part, so the words of one packet's time before the cut are
    put in order of their own finish times, and the running total meets the budget at one of these. `per` has one row per source."""
    early = cut - quantum / per.agg(F.min("weight")).first()[0]
    most = F.col("source_size") * max_epochs
    line = per.select("weight", *[F.greatest(F.least(words_by(F.lit(t), F.col("weight")), most), F.lit(0)).alias(n) for n, t in (("first", early), ("last", cut))])
    served = line.agg(F.sum("first")).first()[0]
    words = line.where("last > first").select("weight", F.explode(F.sequence(F.col("first") + 1, "last")).alias("n"))
    return cut_time(words.select((F.col("n") / F.col("weight")).alias("finish"), F.lit(1).cast("long").alias("words")), budget - served)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, chunks: int = 1024, quantum: int = QUANTUM) -> DataFrame:
    """Every document with its source's target and `taken`, the words of it that the mix holds over all epochs: those that
    finish by the cut, to the word. `finish` is the virtual finish time of its first copy."""
    line, per, cut = _line(docs, weights, max_epochs, chunks, quantum)
    time = word_time(per, cut, per.agg(F.sum("source_size")).first()[0], max_epochs, quantum) if cut is not None else 0.0
    upto, taken = words_by(F.lit(time), F.col("weight")), F.lit(0)
    for e in range(max_epochs):
        taken = taken + F.greatest(F.least(upto - F.col("source_size") * e - F.col("before"), F.col("size")), F.lit(0))
    return _placed(line, per).withColumn("taken", taken.cast("long")).withColumn("finish", _finish(F.lit(0), F.col("size")))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, chunks: int = 1024, quantum: int = QUANTUM) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, ranged over the partitions by the
    virtual finish times of the copies. Rows stay whole: the copy in service at the cut stays if half of it is served
    by then."""
    _, per, cut = _line(docs, weights, max_epochs, chunks, quantum)
    kept = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    half = _finish(F.col("epoch"), F.col("size") / 2)
    copies = _placed(queue(kept, chunks), per).where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.where(half <= (cut if cut is not None else -1.0)).withColumn("finish", _finish(F.col("epoch"), F.col("size")))
    ordered = copies.select("row", "key", "finish").repartitionByRange(partitions(docs.sparkSession), "finish", "key").sortWithinPartitions("finish", "key")
    return ordered.select("row.*")
