"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else.

Equal suffixes of up to `length` bytes are found block by block, without ever holding a suffix array:

1. Equal texts become one row with a count (before their shuffle); every byte of a text that comes twice and is long
   enough is repeated.
2. Of each remaining text, the positions of a difference cover modulo V get names of the length - V + 1 bytes that
   follow. For two places p and q of one string there is a shift below V that takes both to positions of the cover, so
   a string can only be repeated if a cover position in its first V bytes has a repeated name. Names are dealt into
   buckets, and one bucket at a time is sorted.
3. Positions before a repeated cover position get the name of all `length` bytes; these, too, are dealt into buckets
   and sorted one bucket at a time, which tells the repeated ones.

A name stands for a rank: it is a 64-bit hash in a bucket that a second, independent hash chooses, so n suffixes in b
buckets make a wrong match with probability n^2 / (2^65 b). Ranks themselves would need the order of two suffixes at the
shift that takes both to the cover, which differs from pair to pair, so the text behind a suffix would have to travel with
it: 307 bytes for each candidate. Names need 8.

Groups of texts and buckets of names are as many as the bytes ask for (TASK_BYTES of text each), never fewer than the
session's partitions. A task holds one of them at a time, whatever the input; names travel as packed arrays per (group, bucket),
each once per group, so a passage of a third of all texts is one name per group in its bucket, and what comes back is a
bitmap. With very many groups and buckets the arrays get short, down to a row per name.

Cases: null and empty texts have nothing to remove; overlapping matches count, also within one text; repeated
rows are documents of their own; null ids are kept; a text longer than TASK_BYTES is a group's only large one; columns besides
doc_id and text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import rolling
from hirelake.llm.common import partitions

U = np.uint64
#: TASK_BYTES: of whole texts in a group.
LENGTH, FIELD, TASK_BYTES = 400, 17, 16 << 20


@cache
def difference_cover(q: int = FIELD) -> tuple[int, np.ndarray]:
    """(v, cover) with v = q^2 + q + 1 and q + 1 elements: every residue is a difference of two of them. The
    zeros of a linear recurrence of order three over the field of q elements (q prime) are such a set for some
    coefficients."""
    v = q * q + q + 1
    for code in range(q, q**3):
        a, b, c = code % q, code // q % q, code // q // q
        s, zeros = (0, 0, 1), []
        for i in range(v):
            if s[0] == 0:
                zeros.append(i)
            s = (s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q)
        if len(zeros) == q + 1:
            d = np.array(zeros)
            if len(np.unique((d[:, None] - d[None, :]) % v)) == v:
                return v, d
    raise ValueError(f"{q} is not prime")


def cover_positions(n: int, length: int) -> np.ndarray:
    """Cover positions of a text of n bytes that have a whole name ahead."""
    v, d = difference_cover()
    end = n - (length - v)
    at = (np.arange(0, max(end, 0), v)[:, None] + d[None, :]).ravel()
    return at[at < end]


def _thin(groups: int):
    """Each task's texts once, with how often they came; later copies of a text travel as a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "cid", "text", "copies"]
        again: dict[bytes, int] = {}
        for b in batches:
            cids, texts = b.column(0).to_pylist(), b.column(1)
            new = []
            for i, c in enumerate(cids):
                if c in again:
                    again[c] += 1
                else:
                    again[c] = 0
                    new.append(i)
            at = pa.array(new, pa.int64())
            gs = [int.from_bytes(cids[i][:8], "little") % groups for i in new]
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int32()), b.column(0).take(at), texts.take(at), pa.array([1] * len(new), pa.int64())], names=names)
        more = [(c, n) for c, n in again.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(c[:8], "little") % groups for c, _ in more], pa.int32()), pa.array([c for c, _ in more], pa.binary()), pa.nulls(len(more), pa.string()), pa.array([n for _, n in more], pa.int64())], names=names)

    return run


def _group(rows: pa.Table) -> list[tuple[bytes, np.ndarray, int]]:
    """(cid, bytes, copies) of a group's distinct texts, in order of cid."""
    found: dict[bytes, list] = {}
    for cid, text, copies in zip(*(rows[c] for c in ("cid", "text", "copies")), strict=True):
        x = found.setdefault(cid.as_py(), [None, 0])
        x[1] += copies.as_py()
        if text.is_valid and x[0] is None:
            x[0] = np.frombuffer(text.as_py().encode(), np.uint8)
    return [(c, x[0], x[1]) for c, x in sorted(found.items())]


class Names:
    """A group's names: 64-bit hashes, each once, in order of (bucket, hash); the bucket comes from a second hash."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], buckets: int):
        none = np.empty(0, U)
        first, second = (np.concatenate([none, *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
        order = np.argsort(first)
        own = np.concatenate([[True], first[order][1:] != first[order][:-1]])[: len(first)]
        self.place = np.empty(len(first), np.int64)
        self.place[order] = np.cumsum(own) - 1
        self.many = np.bincount(self.place, minlength=int(own.sum())) > 1
        self.hash, bucket = first[order][own], (second[order][own] % U(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.used, start = np.unique(bucket[self.order], return_index=True)
        self.cut = np.append(start, len(bucket))

    def dealt(self, g: int, kind) -> pa.Table:
        """Rows (bucket, g, names); short kinds keep the upper bits."""
        short = (self.hash[self.order] >> U(64 - 8 * np.dtype(kind).itemsize)).astype(kind)
        packed = [short[a:z].tobytes() for a, z in zip(self.cut[:-1], self.cut[1:], strict=True)]
        return pa.table({"bucket": pa.array(self.used, pa.int32()), "g": pa.array([g] * len(self.used), pa.int32()), "names": pa.array(packed, pa.binary())})

    def returned(self, marks: pa.Table) -> np.ndarray:
        """Which of the group's places have a repeated name: within the group, or by the bitmaps that came back."""
        hit = self.many.copy()
        for i, bits in zip(np.searchsorted(self.used, marks["bucket"].to_numpy()), marks["bits"], strict=True):
            at = self.order[self.cut[i] : self.cut[i + 1]]
            hit[at] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(at)).astype(bool)
        return hit[self.place]


def _marks(kind):
    """One bucket: which of its names come more than once, as a bitmap per group that has any."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), kind) for x in rows["names"]]
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        twin = names[order][1:] == names[order][:-1]
        hit = np.zeros(len(names), bool)
        hit[order[1:][twin]] = True
        hit[order[:-1][twin]] = True
        ends = np.cumsum([len(p) for p in parts])
        found = [(i, hit[e - len(p) : e]) for i, (p, e) in enumerate(zip(parts, ends, strict=True)) if hit[e - len(p) : e].any()]
        at = pa.array([i for i, _ in found], pa.int64())
        return pa.table({"g": rows["g"].cast(pa.int32()).take(at), "bucket": rows["bucket"].cast(pa.int32()).take(at), "bits": pa.array([np.packbits(h).tobytes() for _, h in found], pa.binary())})

    return run


def _hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rolling.spans(rolling.prefix(data, k), at, at + size, k) for k in (0, 1))


def _cover_names(group: list, length: int, buckets: int) -> tuple[Names, list[np.ndarray]]:
    """Names of the cover positions of a group's texts, and their positions by text."""
    v, _ = difference_cover()
    where = [cover_positions(len(data), length) if len(data) >= length else np.empty(0, np.int64) for _, data, _ in group]
    return Names([_hashes(data, at, length - v + 1) for (_, data, _), at in zip(group, where, strict=True) if len(at)], buckets), where


def _suffixes(group: list, cover: np.ndarray, where: list[np.ndarray], length: int, buckets: int) -> tuple[Names, list[np.ndarray]]:
    """Names of all positions that may start a repeated string, and these positions by text."""
    v, _ = difference_cover()
    names, found, used = [], [], 0
    for (_, data, _), at in zip(group, where, strict=True):
        hits = at[cover[used : used + len(at)]]
        used += len(at)
        last = len(data) - length
        if not len(hits) or last < 0:
            found.append(np.empty(0, np.int64))
            continue
        edge = np.zeros(last + 2, np.int32)
        np.add.at(edge, np.minimum(np.maximum(hits - v + 1, 0), last + 1), 1)
        np.add.at(edge, np.minimum(hits + 1, last + 1), -1)
        p = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        found.append(p)
        if len(p):
            names.append(_hashes(data, p, length))
    return Names(names, buckets), found


RESULT = "cid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(cid, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) for each distinct text of docs (text); cid
    is the text's sha256, starts and ends are the removed runs."""
    v, _ = difference_cover()
    if length < v:
        raise ValueError(f"length must be {v} or more")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = buckets = max(partitions(spark), -(-size // TASK_BYTES))
    texts = docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("cid"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.mapInArrow(_thin(groups), "g int, cid binary, text string, copies long").repartition(groups, "g")
    dealt, marked = "bucket int, g int, names binary", "g int, bucket int, bits binary"
    # Cover names only rule positions out, so four bytes and the bucket do.
    first = texts.groupBy("g").applyInArrow(lambda t: _cover_names(_group(t), length, buckets)[0].dealt(t["g"][0].as_py(), np.uint32), dealt)
    covered = first.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_marks(np.uint32), marked)

    def deal_suffixes(t: pa.Table, marks: pa.Table) -> pa.Table:
        group = _group(t) if t.num_rows else []
        names, where = _cover_names(group, length, buckets)
        found, _ = _suffixes(group, names.returned(marks), where, length, buckets)
        return found.dealt(t["g"][0].as_py() if group else 0, np.uint64)

    second = texts.groupBy("g").cogroup(covered.repartition(groups, "g").groupBy("g")).applyInArrow(deal_suffixes, dealt)
    suffixes = second.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_marks(np.uint64), marked)
    both = covered.withColumn("kind", F.lit(0)).unionByName(suffixes.withColumn("kind", F.lit(1))).repartition(groups, "g")

    def cut(t: pa.Table, marks: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        group = _group(t) if t.num_rows else []
        kind = marks["kind"].to_numpy()
        names, where = _cover_names(group, length, buckets)
        suffix, at = _suffixes(group, names.returned(marks.filter(pa.array(kind == 0))), where, length, buckets)
        hit, used = suffix.returned(marks.filter(pa.array(kind == 1))), 0
        for (cid, data, copies), p in zip(group, at, strict=True):
            p = p[hit[used : used + len(p)]] if copies == 1 else np.arange(max(len(data) - length + 1, 0))
            used += len(at[len(rows)])
            new = np.concatenate([[True], p[1:] > p[:-1] + length]) if len(p) else np.empty(0, bool)
            starts, ends = p[new], p[np.append(new[1:], True)] + length if len(p) else p
            edges = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(data)]]).astype(np.int64)
            kept = hashlib.sha256(b"".join(data[a:z].tobytes() for a, z in zip(edges[::2], edges[1::2], strict=True))).hexdigest()
            rows.append((cid, len(data), int((ends - starts).sum()), len(starts), kept, starts.tolist(), ends.tolist()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(RESULT.split(", "), cols, kinds, strict=True)})

    return texts.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(cut, RESULT)


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) with what is repeated in each."""
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("cid"))
    return rows.join(repeated(docs, length), "cid").drop("cid")
