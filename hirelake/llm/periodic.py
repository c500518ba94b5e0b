"""Periodic runs of words, found by branching tandem repeats in an enhanced suffix array.

A word that a document holds fewer than `powers` times is in no run of that many periods, so such words cut the documents of a
batch into stretches, and stretches shorter than the least run go. The stretches that are left get one suffix array, with a mark
of its own behind each, so that nothing matches across two of them: ranks by prefix doubling, the LCP of neighbours from
the ranks of every level. Each place between two neighbours is the parting of an LCP interval at a depth: there the interval falls
into two parts, and the suffixes i of the smaller part ask the inverse suffix array whether i + depth or i - depth lies in the
other one. If so, a square of that period begins at the smaller of the two and branches: it can't go on to the right. As a run of
`powers` periods is asked for, the suffixes that lie one and two (in general powers - 2) periods before the square have to be in the interval too.
The squares are rotated to the left as far as their words agree, which gives the run's start. Squares of a period
that is a multiple of a shorter run's over the same words are that run again and go.

The intervals' bounds come from one walk with a stack over the LCP array; no tree is built. Everything but that walk is numpy over a
batch of documents, of about BATCH_WORDS words; a longer document is a batch of its own. Memory is some 400 bytes for each word that is left,
and time grows as n log n.

Cases: null and empty texts have no runs and an empty collapsed text; null and repeated ids and repeated rows keep their rows; a
text of one word over and over is one run of period 1; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import WORD

#: Words, at least, and periods, at least, in a run.
LEAST, POWERS = 6, 4
#: Words whose suffixes are sorted together, unless one document has more.
BATCH_WORDS = 100_000
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, rank of each, number of ranks)."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ordered = keys[order]
    step = np.cumsum(ordered[1:] != ordered[:-1])
    ranks[order[:1]] = 0
    ranks[order[1:]] = step
    return order, ranks, int(step[-1]) + 1 if len(step) else len(keys)


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix, LCP with the suffix before) of codes, whose last one is unique."""
    n = len(codes)
    order, ranks, distinct = _dense(codes)
    levels = [ranks]
    while distinct < n:
        step, before = 1 << (len(levels) - 1), levels[-1]
        # Only suffixes that share their rank are sorted again; the others keep their place.
        sizes = np.bincount(before, minlength=distinct)
        open_ = np.flatnonzero(sizes[before] > 1)
        # The last code is in none of their prefixes, so each has a suffix that far behind it.
        follow = before[open_ + step]
        _, among, _ = _dense(before[open_] * (n + 1) + follow + 1)
        ahead = np.cumsum(sizes) - sizes
        place = ahead[before].copy()
        # A suffix's new key: the first place of its old group, plus how many of the group's keys are smaller.
        by = np.argsort(among, kind="stable")
        group, key = before[open_][by], among[by]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(by))
        first_of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        place[open_[by]] += first_of_key - first_of_group
        order, ranks, distinct = _dense(place)
        levels.append(ranks)
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        grown = same.astype(np.int64) << level
        a += grown
        b += grown
        lcp[1:] += grown
    return order, levels[-1], lcp


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place k of the LCP array: the nearest smaller place to the left, the nearest smaller or equal one to the left and the
    nearest smaller one to the right. The first LCP is 0."""
    values = lcp.tolist()
    n = len(values)
    smaller, equal, right = [0] * n, [0] * n, [n] * n
    stack: list[int] = []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        top = stack[-1] if stack else 0
        equal[k] = top
        smaller[k] = smaller[top] if stack and values[top] == v else top
        stack.append(k)
    return np.array(smaller), np.array(equal), np.array(right)


def _flat(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of each range start..end, and the range that it is of."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def branching_squares(codes: np.ndarray, powers: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square of codes that doesn't go on to the right and has powers - 2 more periods before it. The last code is
    unique."""
    n = len(codes)
    order, rank, lcp = suffix_array(codes)
    smaller, equal, right = _intervals(lcp)
    k = np.flatnonzero(lcp > 0)
    left_at, right_end = equal[k], right[k]
    takes_left = k - left_at <= right_end - k
    # The smaller part, in the suffix array, and the other one.
    starts, ends = np.where(takes_left, left_at, k), np.where(takes_left, k, right_end)
    other_start, other_end = np.where(takes_left, k, left_at), np.where(takes_left, right_end, k)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # The parts are gone through in blocks, so that no array is longer than a few times the codes.
    sizes = np.cumsum(ends - starts)
    for i in range(0, int(sizes[-1]) if len(sizes) else 0, max(n, 1 << 16)):
        block = slice(int(np.searchsorted(sizes, i, "right")) if i else 0, int(np.searchsorted(sizes, i + max(n, 1 << 16), "right")))
        at, which = _flat(starts[block], ends[block])
        place, depth = order[at], lcp[k[block]][which]
        lo, hi = smaller[k[block]][which], right_end[block][which]
        for way in (1, -1):
            mate = place + way * depth
            ok = (mate >= 0) & (mate < n)
            p, d, w = place[ok], depth[ok], which[ok]
            r = rank[mate[ok]]
            hit = (r >= other_start[block][w]) & (r < other_end[block][w])
            p, d, low, high = (p if way > 0 else mate[ok])[hit], d[hit], lo[ok][hit], hi[ok][hit]
            for m in range(1, powers - 1):
                before = p - m * d
                r = rank[np.maximum(before, 0)]
                good = (before >= 0) & (r >= low) & (r < high)
                p, d, low, high = p[good], d[good], low[good], high[good]
            found.append((p, d))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rotated(codes: np.ndarray, start: int, period: int) -> int:
    """The leftmost start that a square at start can be rotated to."""
    step = 64
    while start > 0:
        lo = max(start - step, 0)
        differ = np.flatnonzero(codes[lo:start] != codes[lo + period : start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, step = lo, step * 2
    return start


def runs_of(codes: np.ndarray, least: int = LEAST, powers: int = POWERS) -> np.ndarray:
    """Rows (start, length, period) of the runs of codes, whose last code is unique."""
    starts, periods = branching_squares(codes, powers)
    by = np.lexsort((periods, starts + 2 * periods))
    out: list[tuple[int, int, int]] = []
    last, met = -1, []
    for p, q in zip(starts[by].tolist(), periods[by].tolist(), strict=True):
        end = p + 2 * q
        if end != last:
            last, met = end, []
        # A multiple of a shorter period that covers the whole square; equal squares count once.
        if any(q % s == 0 and at <= p for at, s in met):
            continue
        start = _rotated(codes, p, q)
        met.append((start, q))
        if end - start >= max(least, powers * q):
            out.append((start, end - start, q))
    return np.array(out, np.int64).reshape(-1, 3)


def _stretches(codes: np.ndarray, docs: np.ndarray, least: int, powers: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words that their document holds often enough, `least` long or longer; codes tell documents apart."""
    often = np.bincount(codes)[codes] >= powers if len(codes) else np.empty(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)) != 0)
    first, end = edge[::2], edge[1::2]
    # Neighbouring documents part, too.
    parts = np.flatnonzero(docs[1:] != docs[:-1]) + 1
    cut = parts[often[parts] & often[parts - 1]] if len(parts) else parts
    first, end = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([end, cut]))
    keep = end - first >= least
    return first[keep], end[keep]


def runs_in(texts: list[list[bytes]], least: int = LEAST, powers: int = POWERS) -> list[np.ndarray]:
    """The runs of each list of words, as rows (start, length, period) by start, then period."""
    numbers: list[int] = []
    sizes = [len(t) for t in texts]
    for words in texts:
        own: dict[bytes, int] = {}
        base = len(numbers)
        # Codes of one document aren't those of another.
        numbers += [base + own.setdefault(w, len(own)) for w in words]
    codes = np.array(numbers, np.int64)
    docs = np.repeat(np.arange(len(texts)), sizes)
    first, end = _stretches(codes, docs, least, powers)
    where, which = _flat(first, end)
    marks = np.arange(len(first)) + len(codes)
    # Each stretch, then its own mark.
    ends = np.cumsum(end - first) if len(first) else np.empty(0, np.int64)
    joined, origin = np.insert(codes[where], ends, marks), np.insert(where, ends, -1)
    found = runs_of(joined, least, powers) if len(joined) else np.empty((0, 3), np.int64)
    begins = np.cumsum(sizes) - sizes if sizes else np.empty(0, np.int64)
    at = origin[found[:, 0]] if len(found) else np.empty(0, np.int64)
    doc = docs[at] if len(found) else at
    rows = np.column_stack([at - (begins[doc] if len(found) else 0), found[:, 1:]]) if len(found) else found
    order = np.lexsort((rows[:, 2], rows[:, 0], doc)) if len(found) else doc
    rows, doc = rows[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without what a run holds behind its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, d in zip(words, np.cumsum(depth)[:-1].tolist(), strict=True) if not d])


def periodic_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of docs (doc_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0

        def done() -> pa.RecordBatch:
            found = runs_in(texts, least, powers)
            kept = [collapsed(t, r).decode() for t, r in zip(texts, found, strict=True)]
            every = np.concatenate([np.empty((0, 3), np.int64), *found])
            runs = pa.StructArray.from_arrays([pa.array(every[:, c], pa.int64()) for c in range(3)], names=["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, runs), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                ids.append(b.column(0)[i].as_py())
                texts.append((text or "").encode().split())
                held += len(texts[-1])
                if held >= BATCH_WORDS or len(ids) >= 4096:
                    yield done()
                    ids, texts, held = [], [], 0
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, RUNS)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, but for a tenth of the documents: there the words from a place on are those of one period from that place, over and over. Both
    follow from the id's CRC-32. A null id leaves its text alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def tail(w: Column, g: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    planted = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda x: F.when(F.size(x["w"]) > 0, tail(x["w"], x["g"])).otherwise(""))
    return F.when(h % 10 == 0, planted[0]).otherwise(text)
