"""Packing by power-of-two decomposition.

A document of n tokens (its end token included) is cut into n // 2048 pieces of 2048 and one piece per
set bit of the rest, longest first. A piece's length is a power of two, so it is a sequence of its own
without padding, and no sequence crosses documents. Sequences are dealt to partitions by document and
ordered by length inside, so each task writes runs of equal lengths (buckets) that a trainer reads as
batches of one shape, and one length or document never fills a task.

Cases: a null or empty text is the end token alone; null and repeated ids are packed like any other row;
an empty table gives an empty result. A text of any length is tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import partitions

MAX_TOKENS, END_ID = 2048, 1
#: Words whose ids a worker remembers; it then starts again. Texts, and new words, that are tokenized together.
REMEMBERED = 1_500_000
TOGETHER, NEW_WORDS = 256, 4096


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of whole texts, with the ids of words between ASCII white space remembered: the tokenizer
    drops white space, so a text's ids are its words' ids in order."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok, self.remembered = Tokenizer.from_file(path), remembered
        self.forget()

    def forget(self) -> None:
        self.new: list[bytes] = []
        new = self.new

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                new.append(word)
                self[word] = n = len(self)
                return n

        self.number = Numbers()
        self.flat, self.first = np.empty(1 << 20, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Tokenizes the words met for the first time, and appends their ids."""
        firsts = [self.first]
        for i in range(0, len(self.new), NEW_WORDS):
            words = [w.decode() for w in self.new[i : i + NEW_WORDS]]
            found = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            at = int(firsts[-1][-1])
            ends = at + np.cumsum([len(x) for x in found])
            if ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat[:at], np.empty(int(ends[-1]) * 2 - at, np.uint32)])
            self.flat[at : ends[-1]] = [i for x in found for i in x]
            firsts.append(ends)
        self.first = np.concatenate(firsts)
        self.new.clear()

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end token."""
        if len(self.number) > self.remembered:
            self.forget()
        number = self.number.__getitem__
        words = [list(map(number, (t or "").encode().split())) for t in texts]
        if self.new:
            self.learn()
        out = []
        for w in words:
            at = np.array(w, np.int64)
            start, n = self.first[at], self.first[at + 1] - self.first[at]
            total = np.cumsum(n)
            ids = np.full(int(total[-1] if len(w) else 0) + 1, END_ID, "<u4")
            ids[:-1] = self.flat[np.repeat(start - (total - n), n) + np.arange(len(ids) - 1)]
            out.append(ids)
        return out


_TOKENS: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, remembered: int) -> WordTokens:
    """One per Python worker, so that later tasks know the words of earlier ones."""
    if (path, remembered) not in _TOKENS:
        _TOKENS[path, remembered] = WordTokens(path, remembered)
    return _TOKENS[path, remembered]


def pieces(n: int, most: int = MAX_TOKENS) -> list[int]:
    """The lengths that n tokens are cut into."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece of docs (doc_id, text); with_ids adds the token ids themselves. A worker
    keeps the ids of `remembered` words between its tasks, about 0.25 GB a million."""
    path = path or tokenizer_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokens(path, remembered)
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.batch(batch.column(1).to_pylist()), strict=True):
                at = 0
                for n in pieces(len(ids), max_tokens):
                    part = ids[at : at + n]
                    rows.append((doc, at, n, zlib.crc32(part), len(ids)) + ((part.astype(np.int32),) if with_ids else ()))
                    at += n
            cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, schema)
    dealt = found.repartition(partitions(docs.sparkSession), "doc_id", "start").sortWithinPartitions(F.col("length").desc(), "doc_id", "start", "ids_crc32")
    return dealt.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
