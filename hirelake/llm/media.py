"""Media columns: content-defined payload chunking.

A text's payload (its bytes, padded with zero bytes to a positive multiple of 64) is stored as the
8-bit samples of a mono WAV file: a 44-byte header, which follows from the length, and the payload cut into
chunks of LEAST to MOST bytes where a rolling gear hash says so (about one place in 2 048), so that a passage shared by
ordinary texts is stored once. Chunks are stored once per digest, compressed, after a shuffle by digest that drops copies
on the map side already; a payload is the ordered list of its chunk digests.

Reading joins lists and chunks by digest, checks every chunk against its digest, puts the file together again and
computes from that. Chunks that more than a partition's share of all list entries name are at most HOT many, a few MB,
and are joined by broadcast, so a passage of a third of all texts isn't one task. A payload of one chunk is whole right
at the join; the others' chunks are ranged by content and put together as they stream by, one content at a time, and
texts with equal content are put together once.

Short chunks compress badly alone. They share a dictionary, trained on DICTIONARY_TEXTS distinct texts, those of
the least content ids (at most DICTIONARY_BYTES of each), so reruns store the same bytes; it changes how many bytes a chunk takes, never what is read back.

Cases: null and empty texts are 64 zero bytes; equal texts share everything; a chunk that doesn't match its digest, or
one that is missing, is an error; null and repeated ids keep their rows; other columns are left out; a text of any length is
chunked whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm import rolling
from hirelake.llm.common import partitions
from hirelake.llm.components import saved

#: Bytes: the least and the most in a chunk; a cut at every 2048th place between.
LEAST, MOST, MASK = 256, 8_192, 0x7FF << 8
RATE, LEVEL, PAD, DIGEST = 8_000, 16, 64, 16
#: The dictionary's size and the bounds of its sample; the most chunks that are joined by broadcast.
DICTIONARY, DICTIONARY_TEXTS, DICTIONARY_BYTES, HOT = 65_536, 2_000, 4_096, 1_000


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def wav_header(n: int) -> bytes:
    """Of a mono file of n unsigned 8-bit samples."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def chunks(data: bytes) -> list[bytes]:
    ends = rolling.cuts(np.frombuffer(data, np.uint8), MASK, LEAST, MOST)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, mean step and rate of crossings of the middle, from exact counts."""
    count = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = int((count * values).sum()) / n
    dev = max(int((count * values * values).sum()) / n - mean * mean, 0.0) ** 0.5
    p = count[count > 0] / n
    step = np.abs(np.diff(samples.astype(np.int16)))
    crossed = np.count_nonzero(np.diff(samples >= 128))
    return f"{mean:.4f},{dev:.4f},{float(-(p * np.log2(p)).sum()):.4f},{int(step.sum()) / n:.4f},{crossed / n:.6f}"


def content_id(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, DIGEST)


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=DIGEST).digest()


def dictionary(contents: DataFrame) -> bytes:
    """What short chunks share: trained on a bounded sample of contents (cid, text), the same in every run; empty for small tables."""
    import zstandard

    last = contents.select("cid").distinct().orderBy("cid").limit(DICTIONARY_TEXTS).agg(F.max("cid")).first()[0]
    chosen = contents.where(F.col("cid") <= F.lit(bytes(last or b""))).select("cid", F.substring("text", 1, DICTIONARY_BYTES)).dropDuplicates(["cid"])
    sample = [payload(r[1]) for r in sorted(chosen.collect(), key=lambda r: bytes(r["cid"]))]
    if sum(map(len, sample)) < 16 * DICTIONARY:
        return b""
    return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        found = dict(zip(b.column(0).to_pylist(), b.column(1), strict=True))
        lists = [[_digest(p) for p in chunks(payload(t.as_py()))] for t in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["cid", "digests"])


def _store(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(words) if words else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, dict_data=shared)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            found = dict(zip(b.column(0).to_pylist(), b.column(1), strict=True))
            parts = {_digest(p): p for t in found.values() for p in chunks(payload(t.as_py()))}
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.binary()), pa.array([z.compress(p) for p in parts.values()], pa.binary())], names=["digest", "stored"])

    return run


def chunk_store(contents: DataFrame, words: bytes = b"") -> DataFrame:
    """(digest, stored): each distinct chunk of contents (cid, text) once, compressed with the dictionary `words`."""
    return contents.mapInArrow(_store(words), "digest binary, stored binary").dropDuplicates(["digest"])


def chunk_lists(contents: DataFrame) -> DataFrame:
    """(cid, digests): the ordered chunk list of each distinct content."""
    return contents.mapInArrow(_lists, "cid binary, digests array<binary>").dropDuplicates(["cid"])


READ = "cid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _opener(words: bytes):
    import zstandard

    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)

    def opened(digest: bytes, stored: bytes) -> bytes:
        part = z.decompress(stored)
        if _digest(part) != digest:
            raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
        return part

    return opened


def _read(cid: bytes, data: bytes) -> tuple:
    head = wav_header(len(data))
    return cid, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(head) + len(data), hashlib.sha256(head + data).hexdigest(), feature(np.frombuffer(data, np.uint8))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)


def _read_single(words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opener(words)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            yield _batch([_read(c, opened(d, s)) for c, d, s in zip(*(b.column(n).to_pylist() for n in ("cid", "digest", "stored")), strict=True)])

    return run


def _read_long(words: bytes):
    """Rows arrive ordered by content and place; one content is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opener(words)
        parts: list[bytes] = []
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            whole = []
            for cid, seq, n, digest, stored in zip(*(b.column(c).to_pylist() for c in ("cid", "seq", "n", "digest", "stored")), strict=True):
                if seq != len(parts):
                    raise ValueError(f"content {cid.hex()} has lost chunks")
                parts.append(opened(digest, stored))
                if len(parts) == n:
                    whole.append(_read(cid, b"".join(parts)))
                    parts = []
            yield _batch(whole)
        if parts:
            raise ValueError("the last content has lost chunks")

    return run


def read_back(lists: DataFrame, store: DataFrame, words: bytes = b"") -> DataFrame:
    """One row per content: what its stored bytes say."""
    spark = lists.sparkSession
    lists = saved(lists)
    refs = lists.select("cid", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    share = (lists.agg(F.sum(F.size("digests"))).first()[0] or 0) / min(partitions(spark), HOT)
    hot = [r[0] for r in refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(share, 64)).select("digest").collect()]
    # A list without its chunk must not vanish in the join.
    missing = F.coalesce("stored", F.raise_error(F.lit("a chunk is missing")).cast("binary"))
    if hot:
        often = F.col("digest").isin([F.lit(bytes(d)) for d in hot])
        found = refs.where(often).join(F.broadcast(store.where(often)), "digest", "left").unionByName(refs.where(~often).join(store.where(~often), "digest", "left"))
    else:
        found = refs.join(store, "digest", "left")
    found = found.withColumn("stored", missing)
    single = found.where("n = 1").select("cid", "digest", "stored").mapInArrow(_read_single(words), READ)
    long = found.where("n > 1").repartition("cid").sortWithinPartitions("cid", "seq").select("cid", "seq", "n", "digest", "stored")
    return single.unionByName(long.mapInArrow(_read_long(words), READ))


def media_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) stored, read back and described."""
    contents = docs.select(content_id(F.col("text")).alias("cid"), F.col("text").alias("text"))
    words = dictionary(contents)
    read = read_back(chunk_lists(contents), chunk_store(contents, words), words)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content_id(F.col("text")).alias("cid"))
    return rows.join(read, "cid").drop("cid")
