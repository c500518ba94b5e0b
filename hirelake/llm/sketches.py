"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text is cut into paragraph pieces, at newlines and where a rolling hash of the last 8 bytes says so
(about every 48 bytes), so an edit changes only the pieces that it touches. Each piece's 64-bit digest is added
to one cell in each of three parts of the sketch: a count, the xor of the digests and the xor of their checks.
Subtracting two sketches leaves the pieces that differ, and peeling cells that hold one digest recovers
them. When that fails, both texts are sketched again with four times the cells. The likeness is the
Jaccard index of the two multisets of pieces.

The fingerprint string is the text's own sketch: CELLS times a power of two cells, the first size of SPARE cells a piece or more
that peels when nothing is subtracted, twice as large after each failure. It depends on the text alone, so equal texts have equal
fingerprints, and any two fingerprints tell their texts' likeness without the texts (`likeness_of`): a sketch folds onto each smaller
size, so a difference is peeled from small folds first and retried larger; where even the size of the smaller one fails, both give back
their pieces alone and these are compared. `edited_cells` and `next_cells` tell the size at which a difference decoded.

To meet its neighbour, every text moves once, by range of (doc_id, hash), so rows without an id or with one repeated
id spread too; only the two ends of each range are looked at again.

Cases: a null text is empty; two empty texts are alike (1.0), a single row is its own neighbour; rows of one id and
those without are ordered by their text's hash; null ids come last; other columns are left out; texts of any length
are sketched whole; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm import rolling
from hirelake.llm.common import partitions

CELLS, HASHES, TOGETHER = 24, 3, 128
#: Cells for each piece of a text, at least, in its own sketch.
SPARE = 1.5
U = np.uint64


def digests(text: str) -> np.ndarray:
    """The piece digests of a text; the n-th repeat of a piece has a digest of its own."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.empty(0, U)
    cut = (rolling.gear(data, 8) & np.uint32(0x2F << 3)) == 0
    ends = np.flatnonzero(cut | (data == 10)) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1]])
    h = np.sort(rolling.spans(rolling.prefix(data), starts, ends))
    first = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return rolling.mixed(h + nth.astype(U) * U(0x9E3779B97F4A7C15)) if nth.any() else rolling.mixed(h)


def _check(keys: np.ndarray) -> np.ndarray:
    return (rolling.mixed(keys ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)).astype(np.uint32)


def _cells(keys: np.ndarray, m: int) -> np.ndarray:
    """(HASHES, n): each key's cell in each part."""
    part = m // HASHES
    return np.stack([(rolling.mixed(keys + U((j + 1) * 0xD1B54A32D192ED03 % 2**64)) % U(part)).astype(np.int64) + j * part for j in range(HASHES)])


class Sketches:
    """One sketch of m cells for each of many documents."""

    def __init__(self, many: list[np.ndarray], m: int):
        n = len(many)
        self.m, self.count, self.key, self.check = m, np.zeros(n * m, np.int32), np.zeros(n * m, U), np.zeros(n * m, np.uint32)
        keys = np.concatenate([np.empty(0, U), *many])
        self.put(np.repeat(np.arange(n), [len(x) for x in many]), keys, np.ones(len(keys), np.int32))

    def put(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        check = _check(keys)
        for row in _cells(keys, self.m):
            at = doc * self.m + row
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def strings(self) -> list[str]:
        raw = np.concatenate([self.count.astype("<i4").view(np.uint8).reshape(-1, 4 * self.m), self.key.astype("<u8").view(np.uint8).reshape(-1, 8 * self.m), self.check.astype("<u4").view(np.uint8).reshape(-1, 4 * self.m)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]

    def folded(self, m: int) -> Sketches:
        """The same pieces in m cells; self.m is m times a power of two."""
        out, n = object.__new__(Sketches), len(self.count) // self.m
        many = lambda x: x.reshape(n, HASHES, self.m // m, m // HASHES)
        out.m, out.count = m, many(self.count).sum(axis=2, dtype=np.int32).ravel()
        out.key, out.check = (np.bitwise_xor.reduce(many(x), axis=2).ravel() for x in (self.key, self.check))
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.m, out.count, out.key, out.check = self.m, self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents that came out whole, document, digest, sign of each recovered piece)."""
        found: list[tuple] = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_check(self.key[at]) == self.check[at]]
            if not len(at):
                break
            doc, keys, sign = at // self.m, self.key[at], self.count[at]
            order = np.lexsort((keys, doc))
            doc, keys, sign = doc[order], keys[order], sign[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])
            doc, keys, sign = doc[new], keys[new], sign[new]
            found.append((doc, keys, sign))
            self.put(doc, keys, -sign)
        whole = ~((self.count != 0) | (self.key != 0)).reshape(-1, self.m).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int32)]
        return whole, *parts


def read_string(fingerprint: str) -> Sketches:
    """The sketch of a fingerprint string."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    out = object.__new__(Sketches)
    m = out.m = len(raw) // 16
    out.count, out.key, out.check = raw[: 4 * m].view("<i4").copy(), raw[4 * m : 12 * m].view("<u8").copy(), raw[12 * m :].view("<u4").copy()
    return out


def differing_pieces(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the pieces that only the first fingerprint's text has, and only the second's."""
    x, y, m = read_string(a), read_string(b), CELLS
    while m <= min(x.m, y.m):
        whole, _, keys, sign = x.folded(m).minus(y.folded(m)).peel()
        if whole[0]:
            return keys[sign > 0], keys[sign < 0]
        m *= 4
    alone = [s.peel()[2] for s in (x, y)]
    return np.setdiff1d(*alone), np.setdiff1d(*alone[::-1])


def likeness_of(a: str, b: str) -> float:
    """The likeness of two texts from their fingerprints."""
    both = sum(int(read_string(f).count.sum()) for f in (a, b)) // HASHES
    d = sum(map(len, differing_pieces(a, b)))
    return (both - d) / (both + d) if both else 1.0


def own_strings(many: list[np.ndarray]) -> list[str]:
    """The fingerprint of each document's pieces: its sketch at the first size that peels alone."""
    out, rest = [""] * len(many), np.arange(len(many))
    size = np.array([CELLS * 2 ** max(math.ceil(math.log2(max(len(x), 1) * SPARE / CELLS)), 0) for x in many], np.int64)
    while len(rest):
        m = int(size[rest].min())
        now = rest[size[rest] == m]
        sketch = Sketches([many[i] for i in now], m)
        strings, (whole, *_) = sketch.strings(), sketch.peel()
        for i in np.flatnonzero(whole):
            out[now[i]] = strings[i]
        size[now] *= 2
        rest = rest[~np.isin(rest, now[whole])]
    return out


def differing(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(how many pieces differ between each a[i] and b[i], the cells that told it); failures are tried again, four
    times larger."""
    out, used, rest, m = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a)), cells
    while len(rest):
        x, y = [a[i] for i in rest], [b[i] for i in rest]
        whole, doc, _, _ = Sketches(x, m).minus(Sketches(y, m)).peel()
        out[rest], used[rest] = np.bincount(doc, minlength=len(rest)), m
        rest, m = rest[~whole], m * 4
    return out, used


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[float], list[int]]:
    """The Jaccard index of the pieces of each a[i] and b[i], and the cells that told it."""
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    d, used = differing(a, b)
    return np.where(both > 0, (both - d) / np.maximum(both + d, 1), 1.0).tolist(), used.tolist()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_cells long, next_cells long"


def _rows(ids: list, texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    changed = [digests(t) for t in edited]
    (near, near_cells), (far, far_cells) = likeness(own, changed), likeness(own, after)
    cols = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], own_strings(own), own_strings(changed), near, far, near_cells, far_cells]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of an ordered range but its last, against the row after it."""
    ids: list = []
    texts: list[str] = []
    own: list[np.ndarray] = []
    for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
        ids += batch.column(0).to_pylist()
        new = [t or "" for t in batch.column(1).to_pylist()]
        texts += new
        own += [digests(t) for t in new]
        yield _rows(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
        del ids[:-1], texts[:-1], own[:-1]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, following = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], [t or "" for t in b.column(2).to_pylist()]
        yield _rows(ids, texts, following, [digests(t) for t in texts], [digests(t) for t in following])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns for docs (doc_id, text), each against the next by descending doc_id; the
    last one's next is the first."""
    order = [F.col(c).desc_nulls_last() for c in ("doc_id", "th", "text")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order[:2])
    inside = ranged.sortWithinPartitions(*order).mapInArrow(_inside, SCHEMA)
    whole = F.struct("doc_id", "th", "text")
    edges = ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.max(whole).alias("head"), F.min(whole).alias("tail"))
    # One row per range from here on.
    line = Window.orderBy("pid")
    ring = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = edges.select(F.col("tail.doc_id").alias("doc_id"), F.col("tail.text").alias("text"), F.coalesce(F.lead("head").over(line), F.first("head").over(ring))["text"].alias("following"))
    return inside.unionByName(pairs.mapInArrow(_ends, SCHEMA))
