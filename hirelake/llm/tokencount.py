"""Token counts without tokenizing documents: pieces are counted once per distinct pre-token.

A sentencepiece BPE model merges neighbours only where the merged piece is in its vocabulary. If no piece holds a space
behind another character, and none holds a line feed, no merge crosses the places before a run of spaces and around a
line feed. The pieces between two such places, the pre-tokens, don't depend on what stands around them; `PieceCounter` checks this of the
model and refuses others. Three Spark steps follow:

1. `vocabulary`: every task counts its texts' pre-tokens and sends each once; one row per pre-token is left, and its
   pieces are counted. This table is written to the shared folder.
2. `frequencies`: (document, pre-token, times) rows, one per pre-token of a document.
3. `token_counts`: the frequencies are joined with the counts and summed per document. The commonest pre-tokens, at most COMMON of
   them by a histogram of their frequencies, are broadcast; the others go through a shuffled join, in which no key is
   hot, as each is rarer than all that are broadcast. No token id of a document is ever made.

A pre-token of more than LONGEST characters goes by its SHA-256, so that keys stay short and the broadcast is bounded by COMMON * 4 *
(LONGEST + 24) bytes, 55 MB, whatever the texts are.

Cases: a null or empty text has 0 bytes and 0 tokens; null and repeated ids and repeated rows each keep their row; a text without a space or
line feed is one pre-token, counted whole; control strings such as <s> are ordinary text, as is the library's default; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.components import saved
from hirelake.llm.packing import tokenizer_path

MODEL = "piece_bpe_32k.model"
#: Most pre-tokens that are broadcast; characters of the longest that goes by its own text.
COMMON, LONGEST = 1 << 18, 32
#: Pre-tokens that a task holds before it sends their counts on; texts, and pre-tokens, that are worked on at once.
HELD, TOGETHER, BATCH = 1 << 18, 64, 4096
#: The piece that stands for a space.
SPACE = "▁"
_PRETOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def pretokens(text: str | None) -> list[str]:
    """A text's pre-tokens in order. The space that the library puts in front of a text is one of theirs."""
    return _PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def key_of(token: str) -> str:
    """A pre-token's key: itself, or its digest behind a line feed, which no pre-token of its length has."""
    return token if len(token) <= LONGEST else "\n" + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


class PieceCounter:
    """Counts pieces of single pre-tokens with a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or "".join(self.model.encode("a  b ", out_type=str)) != f"{SPACE}a{SPACE * 2}b{SPACE}":
            raise ValueError(f"{path} has pieces that cross pre-tokens")
        self.ahead = len(self.model.encode("\n"))

    def __call__(self, tokens: list[str]) -> list[int]:
        # Behind a line feed a pre-token gets no space in front; the line feed's own pieces go.
        return [len(ids) - self.ahead for ids in self.model.encode(["\n" + t for t in tokens], num_threads=1)]


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """One per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def sent() -> Iterator[pa.RecordBatch]:
        tokens = list(held)
        for i in range(0, len(tokens), BATCH):
            part = tokens[i : i + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(t) for t in part], pa.string()), pa.array(part, pa.string()), pa.array([held[t] for t in part], pa.int64())], names=["key", "token", "met"])
        held.clear()

    for b in _slices(batches, TOGETHER):
        for text in b.column(0).to_pylist():
            held.update(pretokens(text))
        if len(held) > HELD:
            yield from sent()
    yield from sent()


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(key, met, pieces) of every distinct pre-token of docs (text): how often it occurs and how many pieces it has."""
    met = docs.select("text").mapInArrow(_met, "key string, token string, met long")
    distinct = met.groupBy("key").agg(F.sum("met").alias("met"), F.first("token").alias("token"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(path)
        for b in _slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("met"), pa.array(pieces(b.column("token").to_pylist()), pa.int64())], names=["key", "met", "pieces"])

    return distinct.mapInArrow(count, "key string, met long, pieces long")


def frequencies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, n_bytes, a, b, key, times): one per distinct pre-token of a document, and one with an
    empty key that counts the document itself. a and b tell texts apart."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"),
        F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("b"),
        "text",
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, TOGETHER):
            keys: list[str] = []
            times: list[int] = []
            sizes: list[int] = []
            for text in b.column("text").to_pylist():
                found = Counter(pretokens(text))
                keys += ["", *map(key_of, found)]
                times += [1, *found.values()]
                sizes.append(len(found) + 1)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            own = [b.column(c).take(at) for c in ("doc_id", "n_bytes", "a", "b")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.string()), pa.array(times, pa.int64())], names=["doc_id", "n_bytes", "a", "b", "key", "times"])

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, a long, b long, key string, times long")


def common_from(words: DataFrame, most: int) -> int:
    """The least frequency, a power of two, that at most `most` pre-tokens reach; from one row per power."""
    tall = {r["power"]: r["n"] for r in words.groupBy(F.floor(F.log2("met")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    power, n = max(tall, default=0) + 1, 0
    while power > 0 and n + tall.get(power - 1, 0) <= most:
        power -= 1
        n += tall.get(power, 0)
    return 1 << power


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text)."""
    words = saved(vocabulary(docs, path or tokenizer_path(MODEL)))
    least = common_from(words, common)
    often = words.where(F.col("met") >= least).select("key", "pieces")
    one = words.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("pieces"))
    document = ["doc_id", "n_bytes", "a", "b"]
    rows = frequencies(docs)
    found = rows.join(F.broadcast(often.unionByName(one)), "key", "left")
    sums = [F.sum(F.col("times") * F.col("pieces")).alias("tokens"), F.sum(F.when(F.col("key") == "", F.col("times"))).alias("copies")]
    out = found.where("pieces is not null").groupBy(*document).agg(*sums)
    if least > 1:
        seldom = words.where(F.col("met") < least).select("key", "pieces")
        rest = found.where("pieces is null").drop("pieces").join(seldom, "key")
        out = out.unionByName(rest.groupBy(*document).agg(*sums)).groupBy(*document).agg(F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    # Rows with one id and one text were summed up together; they come apart in blocks, so no array is long.
    block = 10_000
    blocks = out.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"), "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("block"))
    each = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("copies") - F.col("block") * block))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
