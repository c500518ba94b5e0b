"""N-gram Jaccard join with filters under several global token orders.

A document is the set of its distinct word shingles (64-bit hashes); documents with equal sets are one node.
Under any global order of the shingles, two sets with Jaccard similarity of t or more share one of each other's
first |x| - ceil(t |x|) + 1, their prefixes. There are ORDERS of them, each a permutation of its own that puts shingles
of crowded counting buckets last. The first order's prefixes are joined, which gives candidates; a candidate stays
only if it passes the filters of all orders, which travel with the nodes as short hashes: sizes, the parity bitmaps of
both sets (their distance is at most the sets' symmetric difference), and a shared prefix shingle under every
other order. Only then do texts move, a centre's once for up to PAIRS others, and the exact overlap decides. No filter
loses a link.

Groups stay small in four steps: (1) only shingles in two nodes or more go on; (2) each shingle's nodes are
compared with its most connected one, and the links found are joined into components; (3) what is left of a
shingle's group, pairs in different components, is compared inside tasks, in pairs of blocks of bounded size,
which return the pairs that pass, not all pairs; (4) components again. Node ids are 64-bit hashes of whole
sets; two different sets get one id with probability n^2 / 2^65.

Cases: a text with fewer words than a shingle is one shingle; null, empty and blank texts have none, link
with nothing and are their own component; copies, repeated rows and repeated ids share a node; a null
doc_id never names a component that has another id; texts of any length count whole; columns besides doc_id and text
are left out by `similar` and kept, whatever their names, by `keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm import rolling
from hirelake.llm.common import join_spread
from hirelake.llm.components import components, saved

U = np.uint64
#: Counting buckets of the orders, least bits of a parity bitmap, orders in all, shingles in a block, pairs per centre's text.
BUCKET_BITS, BITMAP, ORDERS, BLOCK_TOKENS, PAIRS = 16, 1024, 3, 1 << 21, 1024
#: From so many prefix shingles on, their hashes have 32 bits instead of 16.
WIDE = 256
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_MULTIPLIERS = np.random.default_rng(4).integers(1, 2**63, 16, dtype=U) | U(1)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def shingles(text: str | None, size: int = 4) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U)
    words = rolling.spans(rolling.prefix(data), starts, ends)
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, U)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _MULTIPLIERS[i % 16]
    return np.unique(rolling.mixed(total))


def prefix_size(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def prefix(sh: np.ndarray, order: int, percent: int, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a set under one order: low crowding levels first, a permutation within."""
    p = int(prefix_size(len(sh), percent)) if len(sh) else 0
    if p <= 0:
        return sh[:0]
    key = rolling.mixed(sh + U((order + 1) * int(_MULTIPLIERS[order]) % 2**64)) >> U(8) | levels[(sh >> U(64 - BUCKET_BITS)).astype(np.int64)] << U(56)
    return sh[np.argpartition(key, p - 1)[:p]]


def bitmap(sh: np.ndarray) -> bytes:
    """Parities of the shingles by hash: a power of two of bits, BITMAP at least and half the set's size, so that
    sets that have little in common are further apart than a link allows, however long they are."""
    m = max(BITMAP, 1 << max(len(sh) // 2 - 1, 0).bit_length())
    return np.packbits((np.bincount((sh & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bitmaps as bitmaps of `width` bytes: the halves xor-ed."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def by_width(column: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, packed rows) for each width of bitmap in a column."""
    width = np.array([len(x) for x in column])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield at, np.frombuffer(b"".join(column[i] for i in at), np.uint8).reshape(len(at), w)


def most_apart(a, b, percent: int):
    """The largest symmetric difference of sets of a and b elements that still link."""
    return (100 - percent) * (a + b) // (100 + percent)


def node_of(sh: np.ndarray) -> int:
    """A set's own id: 64 bits of a hash of all its shingles."""
    return int.from_bytes(hashlib.blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


#: Buckets of shingles met that are counted at once.
MET = 1 << 18


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met, n_met = np.zeros(1 << BUCKET_BITS, np.int64), [np.empty(0, np.int64)], 0
        names = ["doc_id", "th", "n", "node", "bits", "bucket", "cnt"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for b in batches:
            ns, nodes, bits = [], [], []
            for text in b.column(2):
                sh = shingles(text.as_py(), size)
                met.append((sh >> U(64 - BUCKET_BITS)).astype(np.int64))
                n_met += len(sh)
                if n_met >= MET:
                    counts += np.bincount(np.concatenate(met), minlength=len(counts))
                    met, n_met = [np.empty(0, np.int64)], 0
                ns.append(len(sh))
                nodes.append(node_of(sh))
                bits.append(bitmap(sh))
            cols = [b.column(0), b.column(1), ns, nodes, bits, [None] * len(ns), [None] * len(ns)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        counts += np.bincount(np.concatenate(met), minlength=len(counts))
        at = np.flatnonzero(counts)
        none = [pa.nulls(len(at), k) for k in kinds[:5]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=names)

    return run


def describe(docs: DataFrame, size: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, th, n, node, bits), crowding level of each bucket) in one pass over docs (doc_id, text).
    The levels are a fixed 2**BUCKET_BITS numbers: how many quarter powers of two a bucket's count is over
    the mean, none if within its spread."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    both = saved(rows.mapInArrow(_describe(size), "doc_id long, th long, n int, node long, bits binary, bucket int, cnt long"))
    counts = np.zeros(1 << BUCKET_BITS)
    for r in both.where("bucket is not null").groupBy("bucket").agg(F.sum("cnt").alias("cnt")).collect():
        counts[r["bucket"]] = r["cnt"]
    mean = max(counts.mean(), 1.0)
    over = np.where(counts > mean + 6 * mean**0.5, np.log2(np.maximum(counts, 1) / mean) * 4 + 1, 0)
    return both.where("bucket is null").drop("bucket", "cnt"), np.clip(over, 0, 255).astype(U)


def short_hashes(tokens: np.ndarray) -> bytes:
    """The prefix of a set under one order, as sorted short hashes."""
    kind = np.uint32 if len(tokens) >= WIDE else np.uint16
    return bytes([np.dtype(kind).itemsize]) + np.unique((tokens >> U(8)).astype(kind)).tobytes()


def share(a: bytes, b: bytes) -> bool:
    """Whether two prefixes may share a shingle: true whenever they do."""
    x, y = (np.frombuffer(h, np.uint32 if h[0] == 4 else np.uint16, offset=1) for h in (a, b))
    if x.dtype != y.dtype:
        x, y = (np.unique(h.astype(np.uint16)) for h in (x, y))
    return len(np.intersect1d(x, y, assume_unique=True)) > 0


OTHERS = [f"p{k}" for k in range(1, ORDERS)]
FILTERS = "node long, tokens array<long>, " + ", ".join(f"{p} binary" for p in OTHERS)


def _filters(size: int, percent: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, tuple] = {}
            for text in b.column(0):
                sh = shingles(text.as_py(), size)
                if len(sh) and (node := node_of(sh)) not in found:
                    found[node] = (prefix(sh, 0, percent, levels).view(np.int64), *(short_hashes(prefix(sh, k, percent, levels)) for k in range(1, ORDERS)))
            cols = list(zip(*found.values(), strict=True)) or [()] * ORDERS
            kinds = [pa.list_(pa.int64())] + [pa.binary()] * len(OTHERS)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["node", "tokens", *OTHERS])

    return run


def _verified(size: int, percent: int):
    """Rows arrive ordered by (v, part, side): a centre's text, then the texts to hold against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.empty(0, U)
        for b in batches:
            us, vs = [], []
            for v, side, node, text in zip(*(b.column(n).to_pylist() for n in ("v", "side", "node")), b.column("text"), strict=True):
                if not side:
                    centre, held = v, shingles(text.as_py(), size)
                elif v != centre:
                    raise ValueError(f"the text of node {v} is missing")
                elif linked(shingles(text.as_py(), size), held, percent):
                    us.append(node)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _apart(bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Distances of all pairs of packed bitmaps."""
    ones_a, ones_b = np.unpackbits(bits_a, axis=1).astype(np.float32), np.unpackbits(bits_b, axis=1).astype(np.float32)
    return ones_a.sum(1)[:, None] + ones_b.sum(1)[None, :] - 2 * (ones_a @ ones_b.T)


def _block_pairs(percent: int):
    """Rows arrive ordered by (token, i, j); each such group is one pair of blocks."""

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, node, comp, n = (t[c].to_numpy() for c in ("block", "node", "comp", "n"))
        column = t["bits"].to_pylist()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        us, vs = [], []
        for p, x in by_width([column[k] for k in left]):
            for q, y in by_width([column[k] for k in right]):
                w = min(x.shape[1], y.shape[1])
                for at in range(0, len(p), 512):
                    a, z = left[p[at : at + 512]], right[q]
                    ok = (comp[a][:, None] != comp[z][None, :]) & (100 * np.minimum(n[a][:, None], n[z][None, :]) >= percent * np.maximum(n[a][:, None], n[z][None, :]))
                    if not ok.any():
                        continue
                    ok &= _apart(folded(x[at : at + 512], w), folded(y, w)) <= most_apart(n[a][:, None].astype(np.int64), n[z][None, :], percent)
                    f, g = np.nonzero(ok)
                    us.append(node[a][f])
                    vs.append(node[z][g])
        u, v = np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs])
        return np.maximum(u, v), np.minimum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t[c].to_numpy() for c in ("token", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *cut], [*cut, t.num_rows], strict=True):
                u, v = pairs(t.slice(a, z - a))
                if len(u):
                    found = np.unique(np.stack([u, v]), axis=1)
                    found = found[:, found[0] != found[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            last = tuple(t[c][-1].as_py() for c in ("token", "i", "j"))
            whole = np.all([t[c].to_numpy() == x for c, x in zip(("token", "i", "j"), last, strict=True)], axis=0)
            n = int(np.argmax(whole))
            if n:
                yield from flush(t.slice(0, n))
            held = t.slice(n).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _passing(percent: int):
    """Pairs that pass the filters of every order: their bitmaps are near enough for a link, and so are their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            far, xs, ys = np.zeros(b.num_rows, np.int64), b.column("bu").to_pylist(), b.column("bv").to_pylist()
            for p, x in by_width(xs):
                for q, y in by_width([ys[k] for k in p]):
                    w = min(x.shape[1], y.shape[1])
                    far[p[q]] = _ONES[folded(x[q], w) ^ folded(y, w)].sum(1)
            ok = far <= most_apart(b.column("nu").to_numpy().astype(np.int64), b.column("nv").to_numpy(), percent)
            for i in np.flatnonzero(ok):
                ok[i] = all(share(b.column(f"{p}u")[i].as_py(), b.column(f"{p}v")[i].as_py()) for p in OTHERS)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], names=["u", "v"])

    return run


#: Bits of the filter that keeps texts without a pair out of a shuffle; a fixed size, whatever the input.
FILTER_BITS = 1 << 22


def _among(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() & (FILTER_BITS - 1)
            yield b.filter(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)))

    return run


def places(wanted: DataFrame) -> DataFrame:
    """(w, bits): a bitmap of FILTER_BITS hashed places with those of wanted (t), in words of 64."""
    place = F.col("t").bitwiseAND(F.lit(FILTER_BITS - 1))
    return wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts (d, t, text) whose t may be among those of wanted (t). When the bitmap is crowded, more rows
    pass, and the join that follows sorts them out."""
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in places(wanted).collect():
        bits[r["w"]] = r["bits"]
    return texts.mapInArrow(_among(bits), "d long, t long, text string")


def similar(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, label, first) for every row of docs (doc_id, text); th is xxhash64 of the
    text. component_id is a doc_id, so components without ids or with a shared id can have the same one; label, the
    component's smallest node, tells them apart, and first is its smallest (doc_id, th), nulls before all (both null
    for texts without a word)."""
    rows, levels = describe(docs, size)
    filled = rows.where("n > 0")
    filters = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(_filters(size, percent, levels), FILTERS).dropDuplicates(["node"])
    nodes = filled.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("members"))
    nodes = saved(nodes.join(filters, "node"))
    entries = nodes.select(F.explode("tokens").alias("token"), "node")
    # Counted where they lie: a join with the shingles of two nodes or more would move all entries a second time.
    shared = saved(entries.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1"))
    pop = shared.groupBy("node").agg(F.sum("df").alias("pop")).join(nodes.select("node", "n"), "node")
    shared = shared.drop("df")
    known = shared.join(pop, "node").withColumn("rank", F.col("pop") / F.col("n"))
    centres = known.groupBy("token").agg(F.max(F.struct("rank", "node", "n")).alias("c"))
    near = (100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n"))) & (F.col("node") != F.col("c.node"))
    pairs = known.join(centres, "token").where(near).select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct()
    sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"), *(F.col(p).alias(p + s) for p in OTHERS)) for s in "uv"]

    def passing(found: DataFrame) -> DataFrame:
        return saved(found.join(sides[0], "u").join(sides[1], "v").mapInArrow(_passing(percent), "u long, v long"))

    stars = passing(pairs)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")

    def verify(found: DataFrame) -> DataFrame:
        """The pairs that link. Texts of nodes in pairs alone go through the shuffle by node; then each u's text, and v's
        once for PAIRS of them, meet by v and part."""
        used = found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
        used = saved(used)
        held = only(texts, used.select(F.col("rep.th").alias("t"))).join(used, F.col("d").eqNullSafe(F.col("rep.doc_id")) & (F.col("t") == F.col("rep.th"))).select("node", "text").dropDuplicates(["node"])
        part = F.pmod(F.xxhash64("u"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("v")) / PAIRS))
        need = found.select("v", part.alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("v").alias("node")), F.struct(F.lit(1).alias("side"), F.col("u").alias("node")))).alias("x"))
        need = need.select("v", "part", "x.side", "x.node").distinct()
        ordered = need.join(held, "node").repartition("v", "part").sortWithinPartitions("v", "part", "side").select("v", "part", "side", "node", "text")
        return saved(ordered.mapInArrow(_verified(size, percent), "u long, v long"))

    links = verify(stars)
    labels = components(links)
    # What the centres didn't settle: shingles of three nodes or more in different components.
    placed = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label").join(nodes.select("node", "n"), "node")
    rest = placed.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("weight")).where("df > 2 and lo <> hi")
    rest = rest.select("token", F.ceil(F.col("weight") / BLOCK_TOKENS).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    dealt = placed.join(rest, "token").join(nodes.select("node", "bits"), "node").withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "bits")
    ordered = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    left = ordered.mapInArrow(_block_pairs(percent), "u long, v long").distinct().join(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    more = verify(passing(left))
    labels = components(links.unionByName(more))
    total = nodes.agg(F.sum("members")).first()[0] or 0
    placed = nodes.select("node", "members").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "members")
    named = saved(join_spread(filled.select("doc_id", "th", "n", "node"), placed, "node", total, "doc_id", "th").drop("node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("members"))
    out = join_spread(named, smallest, "label", total, "doc_id", "th").select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "label", "first")
    alone = rows.where("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast(out.schema["first"].dataType).alias("first"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """The rows of docs, one for each group of linked documents (the one with the smallest doc_id); texts
    without a word all stay."""
    found = similar(docs, percent, size).where("n_shingles > 0")
    # Null ids get a value and a mark, so plain keys serve the join and the repeats.
    key = lambda d, t: (F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("no_id"), t.alias("t"))
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    keys = found.groupBy(*key(F.col("doc_id"), F.col("th"))).agg(F.first(first).alias("kept"), F.count(F.lit(1)).alias("n"))
    unsettled = saved(keys.where("not kept or n > 1"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row, *key(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))))
    # Only rows that may be dropped or come again go through a shuffle, as these are whole rows; the others stay as they lie.
    at = F.col("t").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = rows.withColumn("at", at).withColumn("w", F.shiftright("at", 6)).join(F.broadcast(places(unsettled)), "w", "left")
    stays = F.expr("coalesce(shiftright(bits, cast(at & 63 as int)) & 1, 0) = 0") | ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    open_rows = rows.where(~stays).join(unsettled.where("not kept"), ["d", "no_id", "t"], "left_anti").dropDuplicates(["d", "no_id", "t"])
    return rows.where(stays).select("row.*").unionByName(open_rows.select("row.*"))
