"""Vector code compression: product codes whose codebooks are trained by exact k-means, with norm-of-sum bounds.

A vector's components become integers, and the vector is cut into equal parts. Each part position has a codebook, which starts as that
part of the first vectors and is trained for some rounds: all parts go to their nearest entry, then entries become means. Everything is integer
arithmetic, so results don't depend on the order of rows or on how they are dealt.

Each (vector, part) keeps its entry, an upper bound of the distance to it, a lower bound of the distance to every other entry, and for
each of both bounds the stamp of the round whose codebook it was measured against. All rounds' codebooks are kept (a few kB). A bound of round s is
carried to round t by the true net displacement |C_t(j) - C_s(j)| of the entry, the norm of the sum of its moves, which is
never more than the sum of their norms: the upper bound grows by its entry's displacement and the lower one shrinks by the largest displacement
of the other entries. If they still don't meet, the part stays where it is and the vector isn't looked at. Else the distance to
its own entry is measured and stamped with this round; only if that doesn't part the bounds either are all entries measured exactly. Bounds are stored
rounded away from each other, and a tie never passes the test, so no assignment differs from a full scan's.

The state is 88 bytes a vector of eight parts, beside its integers. Rounds are narrow maps of the rows of the round before, cached; nothing but
the sums by entry is shuffled, as differences that the moved parts make. The driver sees at most parts * entries * (width + 1) sums a round. A lost
executor's rows are computed again from the table through the rounds' maps, which the codebooks' history determines.

Cases: vectors that are null, empty, or hold a null, NaN, infinite or larger component than LARGEST (its squares wouldn't fit a long) are
dropped; so are vectors whose length isn't that of the first kept one, or isn't a multiple of the parts. Fewer vectors than entries give as
many entries; equal first vectors give equal entries, of which the first wins. Null and repeated ids keep their rows, null ids are last in order (ties by
the vector); null labels are one label; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from hirelake.llm.common import join_spread
from hirelake.llm.components import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest component that is taken: its integer has 27 bits.
LARGEST = 32_768.0
#: Vectors that are worked on at once in a task.
TOGETHER = 4096
STATE = "vec_id long, label string, x binary, state binary"


def _record(parts: int) -> np.dtype:
    """One vector's state: its entries, those of the round before, both bounds and their stamps."""
    return np.dtype([("now", "u1", parts), ("was", "u1", parts), ("upper", "<f4", parts), ("lower", "<f4", parts), ("upper_at", "u1", parts), ("lower_at", "u1", parts)])


def kept_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the vectors of rows (vec_id, embedding, label) whose components are all numbers of a size that can be coded."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    return named.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(fine, F.lit(False)))


def integers(vectors: list, scale: int = SCALE) -> np.ndarray:
    return np.floor(np.asarray(vectors, np.float64) * scale).astype(np.int64)


def distances(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) to the entries (k, width), exact."""
    out = np.zeros((len(x), len(codebook)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - codebook[None, :, i]) ** 2
    return out


def _down(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf), dtype=np.float32)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf), dtype=np.float32)


class Moves:
    """What bounds of earlier rounds have to allow for at the last codebook of a history (rounds, parts, entries, width)."""

    def __init__(self, history: np.ndarray):
        squares = ((history[-1][None] - history) ** 2).sum(-1)
        #: (round, part, entry): the entry's net displacement since that round, rounded up.
        self.own = _up(squares)
        self.own[squares == 0] = 0
        by = np.sort(self.own, axis=-1)
        self.top, self.next = by[..., -1], by[..., -2] if by.shape[-1] > 1 else np.zeros_like(by[..., -1])
        self.top_entry = self.own.argmax(-1)

    def others(self, at: np.ndarray, part: int, entry: np.ndarray) -> np.ndarray:
        """The largest displacement since the rounds `at` of the entries besides `entry`."""
        return np.where(self.top_entry[at, part] == entry, self.next[at, part], self.top[at, part])


def rescan(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, the second one's) of each part by a full scan."""
    d = distances(x, codebook)
    near = d.argmin(1)
    own = d[np.arange(len(d)), near]
    d[np.arange(len(d)), near] = np.iinfo(np.int64).max
    return near, own, d.min(1)


def assign(x: np.ndarray, state: np.ndarray, history: np.ndarray) -> int:
    """Brings state to the last codebook of history (rounds, parts, entries, width), for x (n, parts, width); returns how many parts
    were scanned against all entries. With one round in history everything is."""
    now = len(history) - 1
    state["was"] = state["now"]
    moves, scanned = Moves(history), 0
    for part in range(history.shape[1]):
        codebook = history[-1][part]
        entry = state["now"][:, part].astype(np.int64)
        if now:
            up = state["upper"][:, part] + moves.own[state["upper_at"][:, part], part, entry]
            low = state["lower"][:, part] - moves.others(state["lower_at"][:, part], part, entry)
            # One more step outwards makes up for the sums' own rounding.
            low = np.nextafter(low, np.float32(-np.inf), dtype=np.float32)
            tight = np.flatnonzero(~(np.nextafter(up, np.float32(np.inf), dtype=np.float32) < low))
            own = ((x[tight, part] - codebook[entry[tight]]) ** 2).sum(-1)
            up = _up(own)
            state["upper"][tight, part], state["upper_at"][tight, part] = up, now
            open_ = tight[~(up < low[tight])]
        else:
            open_ = np.arange(len(x))
        near, own, second = rescan(x[open_, part], codebook)
        state["now"][open_, part], state["upper"][open_, part], state["lower"][open_, part] = near, _up(own), _down(second)
        state["upper_at"][open_, part] = state["lower_at"][open_, part] = now
        scanned += len(open_)
    return scanned


def _read(b: pa.RecordBatch, shape: tuple[int, int], record: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    parts, width = shape
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(-1, parts, width).astype(np.int64)
    return x, np.frombuffer(b"".join(b.column("state").to_pylist()), record).copy()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.nbytes // len(rows) if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(rows.tobytes())])


def _first(shape: tuple[int, int], scale: int, history: np.ndarray):
    record = _record(shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = integers(np.asarray(b.column("vec").flatten(), np.float64).reshape(-1, *shape), scale)
            state = np.zeros(len(x), record)
            assign(x, state, history)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(x.astype("<i4")), _binary(state)], names=["vec_id", "label", "x", "state"])

    return run


def _next(shape: tuple[int, int], history: np.ndarray):
    record = _record(shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x, state = _read(b, shape, record)
            assign(x, state, history)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _binary(state)], names=["vec_id", "label", "x", "state"])

    return run


def _gains(shape: tuple[int, int], entries: int, whole: bool):
    """What each entry's count (place -1) and sums change by, per task; all parts are new if `whole`."""
    record, (parts, width) = _record(shape[0]), shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in _slices(batches):
            x, state = _read(b, shape, record)
            for part in range(parts):
                now, was = state["now"][:, part], state["was"][:, part]
                moved = np.arange(len(x)) if whole else np.flatnonzero(now != was)
                for side, sign in ((now, 1), (was, -1)) if not whole else ((now, 1),):
                    np.add.at(total[part, :, 0], side[moved], sign)
                    np.add.at(total[part, :, 1:], side[moved], sign * x[moved, part])
        p, e, w = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((p, e, w - 1, total[p, e, w]), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "place", "gain"])

    return run


def _coded(shape: tuple[int, int], codebooks: np.ndarray):
    record = _record(shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x, state = _read(b, shape, record)
            error = sum((((x[:, p] - codebooks[p][state["now"][:, p]]) ** 2).sum(-1) for p in range(shape[0])), np.zeros(len(x), np.int64))
            code = [r.tobytes().hex() for r in state["now"]]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame | None, np.ndarray]:
    """((vec_id, label, code, error), codebooks (parts, entries, width)) from rows (vec_id, embedding, label); no table without a vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has one byte")
    kept = kept_vectors(rows)
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(1).collect()
    dim = len(head[0]["vec"]) if head else 0
    if not dim or dim % parts:
        return None, np.zeros((parts, 0, 0), np.int64)
    shape = (parts, dim // parts)
    kept = kept.where(F.size("vec") == dim)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    history = integers([r["vec"] for r in first], scale).reshape(-1, *shape).transpose(1, 0, 2)[None].copy()
    state = kept.mapInArrow(_first(shape, scale, history), STATE).persist(StorageLevel.MEMORY_AND_DISK)
    total = np.zeros((*history.shape[1:3], shape[1] + 1), np.int64)
    for i in range(rounds):
        gains = state.select("x", "state").mapInArrow(_gains(shape, history.shape[2], not i), "part int, entry int, place int, gain long")
        for r in gains.groupBy("part", "entry", "place").agg(F.sum("gain").alias("gain")).collect():
            total[r["part"], r["entry"], r["place"] + 1] += r["gain"]
        if i:
            before.unpersist()
        count = total[..., :1]
        means = np.where(count > 0, total[..., 1:] // np.maximum(count, 1), history[-1])
        history = np.concatenate([history, means[None]])
        before, state = state, state.mapInArrow(_next(shape, history), STATE).persist(StorageLevel.MEMORY_AND_DISK)
    coded = saved(state.select("vec_id", "label", "x", "state").mapInArrow(_coded(shape, history[-1]), "vec_id long, label string, code string, error long"))
    if rounds:
        before.unpersist()
    state.unpersist()
    return coded, history[-1]


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector of rows (vec_id, embedding, label)."""
    coded, codebooks = train(rows, parts, entries, rounds, scale)
    if coded is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    labels = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members")))
    total = labels.agg(F.sum("members")).first()[0]
    keyed = coded.withColumn("h", F.xxhash64("label"))
    small = labels.groupBy(F.xxhash64("label").alias("h")).agg(F.sum("members").alias("members"), F.map_from_entries(F.collect_list(F.struct("label", "label_error"))).alias("errors"))
    found = join_spread(keyed, small, "h", total, "vec_id", "code")
    return found.select("vec_id", "code", "error", F.element_at("errors", F.col("label")).alias("label_error"), F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))
