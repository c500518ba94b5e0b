"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and clean labelled documents, with the words of both as an informative
Dirichlet prior, score each token; tokens without evidence cost a small amount. A token's terms are the word
itself and its first 4 to 6 letters, so that stems with many endings count together; the term with the
most evidence speaks for it, and a document counts once per term. Of near copies among the labelled
documents of one kind, one counts, so that a copied text's own words don't pass for evidence. A linear scan (the
all-maximal-segments algorithm of Ruzzo and Tompa, run over the few tokens with evidence and the gaps
between them) finds every passage that scores above its surroundings. A passage's score S is calibrated as an
extreme value: E = K * n * exp(-lambda * S) passages of that score are expected in n clean tokens. lambda is the root
of E[exp(lambda * s)] = 1 over the clean token scores, K the most likely one for the best passages of the clean
labelled documents. A logistic curve over -ln E of the best passage, the sum of all significant ones, a document's
length and the log-odds of its distinct words maps it to 0..1.

The labelled sample has at most `max_labelled` rows, and the lexicon holds what has |z| >= LEAST_Z in it, so both
may be broadcast; every text is scored whole. Learning and scoring cut words by one and the same rule, letters of the
composed (NFC) lower-cased text.

Cases: null and empty texts get the score of a text without a passage; without labelled documents of both
kinds every score is 0; repeated rows and null ids are scored like others, and a null id counts as the empty text
where ids are hashed, so it is held out; a very long text is one document; columns besides doc_id and text go along
in a struct `row`, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm import rolling
from hirelake.llm.jaccard import shingles

_FIND = re.compile(r"[^\W\d_]+").findall
#: The classifier's bound: labelled rows.
MAX_LABELLED = 20_000
PRIOR_STRENGTH, PRIOR_FLOOR, LEAST_Z, GAP = 200.0, 0.5, 3.0, 0.05
STEMS = (4, 5, 6)
#: Least hashes that tell near copies in the labelled sample, and the words of a shingle for them.
LEAST_HASHES, SHINGLE = 8, 3


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]
    lam: float
    k: float
    curve: tuple[float, ...]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def tokens(text: str | None) -> list[str]:
    """The words of a text: runs of letters of its composed, lower-cased form."""
    return _FIND(unicodedata.normalize("NFC", text or "").lower())


def terms(token: str) -> list[str]:
    """What can speak for a token: the word itself and its stems."""
    return ["=" + token, *(token[:n] for n in STEMS if len(token) >= n)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [list({x for w in set(tokens(t.as_py())) for x in terms(w)}) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["toxic", "terms"])


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> tuple[Column, Column]:
    """(log-odds, z) of a term from its counts in both kinds, under the prior of both together: its share
    of all terms times the prior's strength, and a floor."""
    prior = F.lit(PRIOR_FLOOR) + PRIOR_STRENGTH * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    na, nb = n_toxic + PRIOR_STRENGTH + 1, n_clean + PRIOR_STRENGTH + 1
    delta = F.log(a / (na - a)) - F.log(b / (nb - b))
    return delta, delta / F.sqrt(1 / a + 1 / b)


def segments(weights: list[float], where: list[int], gap: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last token) of a sequence that scores weights[i] at
    token where[i] and -gap elsewhere."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum through
    total, last = 0.0, -1
    for w, at in zip(weights, where, strict=True):
        total -= gap * (at - last - 1)
        last = at
        if w <= 0:
            total += w
            continue
        cand = (at, at, total, total + w)
        total += w
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cand[2]:
                j -= 1
            if j < 0 or stack[j][3] >= cand[3]:
                stack.append(cand)
                break
            cand = (stack[j][0], cand[1], stack[j][2], cand[3])
            del stack[j:]
    return [(r - le, a, b) for a, b, le, r in stack]


class Scanner:
    """Passages and features of one text under a lexicon of term -> (log-odds, z)."""

    def __init__(self, weights: dict[str, tuple[float, float]], lam: float, k: float):
        self.weights, self.lam, self.k = weights, lam, k
        self.known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        """Of the term with the most evidence; 0 without any."""
        w = self.known.get(token)
        if w is None:
            w = max((self.weights[t] for t in terms(token) if t in self.weights), key=lambda x: abs(x[1]), default=(0.0, 0.0))[0]
            if len(self.known) > 150_000:
                self.known.clear()
            self.known[token] = w
        return w

    def passages(self, text: str | None) -> tuple[int, float, list[tuple[float, int, int]]]:
        """(tokens, log-odds of the distinct words that have evidence, maximal segments)."""
        words = tokens(text)
        hits = [(w, i) for i, w in enumerate(map(self.weight, words)) if w]
        return len(words), sum(map(self.weight, set(words))), segments([w for w, _ in hits], [i for _, i in hits], GAP)

    def features(self, text: str | None) -> tuple[float, ...]:
        n, words, found = self.passages(text)
        return surprise(n, words, [s for s, _, _ in found], self.lam, self.k)


def surprise(n: int, words: float, scores: list[float], lam: float, k: float) -> tuple[float, ...]:
    """(-ln E of the best passage, the logarithm of the sum over all with E below 1, ln(K n), the words' own log-odds)
    of n tokens."""
    scale = float(np.log(k * max(n, 1)))
    bits = [lam * s - scale for s in scores]
    return max(bits, default=-scale), float(np.log1p(sum(b for b in bits if b > 0))), scale, float(words)


def extreme_k(n: np.ndarray, best: np.ndarray, lam: float) -> float:
    """The most likely K, given the best passage scores of clean documents of n tokens: P(S < x) = exp(-K n exp(-lambda x))."""
    expected = float((np.maximum(n, 1) * np.exp(-lam * best)).sum())
    return len(n) / expected if expected > 0 else 1.0


def _rate(weights: np.ndarray, freq: np.ndarray) -> float:
    """The positive root of E[exp(lambda * s)] = 1, by bisection; 1 if the mean isn't negative."""
    f = lambda x: float((freq * np.exp(np.minimum(x * weights, 50))).sum()) - 1
    lo, hi = 1e-6, 1e-3
    if (freq * weights).sum() >= 0 or weights.max(initial=0) <= 0:
        return 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights of the columns of x and of a constant: Newton's steps on centred and scaled columns, each halved until
    the penalised likelihood grows."""
    mid, width = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mid) / width, np.ones(len(x))])
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + ridge / 2 * (w @ w))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, z.T @ (y - p) - ridge * w), loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        w += step
    slopes = w[:-1] / width
    return np.append(slopes, w[-1] - slopes @ mid)


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = np.arange(1, LEAST_HASHES + 1, dtype=np.uint64) << np.uint64(32)
    for b in batches:
        sets = [shingles(t.as_py(), SHINGLE) for t in b.column(1)]
        found = [[int(rolling.mixed(s ^ k).min() >> np.uint64(1)) for k in salts] if len(s) else [0] * LEAST_HASHES for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "least"])


def _without_copies(sample: DataFrame) -> DataFrame:
    """The bounded labelled sample (doc_id, toxic, text) with one of the documents of a kind that share a least
    hash: hash after hash, as the first may miss some of them."""
    kind = dict(sample.dtypes)["doc_id"]
    keys = sample.select("doc_id", "text").mapInArrow(_least_hashes, f"doc_id {kind}, least array<long>")
    rows = sorted((r["doc_id"], tuple(r["least"]), r["toxic"]) for r in keys.join(sample.select("doc_id", "toxic"), "doc_id").collect())
    for k in range(LEAST_HASHES):
        rows = list({(x[1][k], x[2]): x for x in reversed(rows)}.values())
    kept = sample.sparkSession.createDataFrame([(x[0],) for x in rows], f"doc_id {kind}")
    return sample.join(F.broadcast(kept), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from docs (doc_id, text) that labels (doc_id, toxic) covers, held-out rows left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(max_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # Of several texts with one labelled id, the same one in every run.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "toxic")).alias("first")).select("doc_id", "first.text", "first.toxic")
    sample = _without_copies(sample).select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    words = sample.mapInArrow(_terms, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    sums = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not sums or not sums[0] or not sums[1]:
        return Model({}, 1.0, 1.0, (0.0, 0.0, 0.0, 0.0, -30.0))
    delta, z = log_odds(F.col("toxic"), F.col("clean"), float(sums[0]), float(sums[1]))
    scored = counts.select("word", delta.alias("delta"), z.alias("z"), ((F.col("toxic") + F.col("clean")) / float(sums[0] + sums[1])).alias("freq"))
    top = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").collect()
    weights = {r["word"]: (float(r["delta"]), float(r["z"])) for r in top}
    w, f = np.array([r["delta"] for r in top] + [-GAP]), np.array([r["freq"] for r in top])
    lam = _rate(w, np.append(f, max(1 - f.sum(), 0)))
    scan = Scanner(weights, lam, 1.0)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan.passages(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([float(w) for _, w, _ in found]), pa.array([[s for s, _, _ in p] for _, _, p in found], pa.list_(pa.float64()))], names=["y", "n", "words", "scores"])

    rows = sample.mapInArrow(scanned, "y int, n long, words double, scores array<double>").collect()
    clean = [(r["n"], max(r["scores"], default=0.0)) for r in rows if not r["y"]]
    k = extreme_k(*map(np.array, zip(*clean, strict=True)), lam) if clean else 1.0
    curve = _logistic(np.array([surprise(r["n"], r["words"], r["scores"], lam, k) for r in rows]), np.array([float(r["y"]) for r in rows]))
    return Model(weights, lam, k, tuple(map(float, curve)))


def score(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """docs (doc_id, text) with `score`; with_passages adds (score, first, last token) of each
    significant passage. Columns besides doc_id and text must be in a struct `row`, which is kept; without a column
    text, the row's own is scored."""
    keep, own = [c for c in docs.columns if c in ("doc_id", "row")], "text" in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ", passages array<struct<score:double,first:int,last:int>>" * with_passages
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double" + extra

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scan, curve = Scanner(m.weights, m.lam, m.k), np.array(m.curve)
        for b in batches:
            texts = b.column(len(keep)) if own else b.column(keep.index("row")).field("text")
            x = np.array([scan.features(t.as_py()) for t in texts]).reshape(-1, len(curve) - 1)
            s = 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))
            cols = [*b.columns[: len(keep)], pa.array(s)]
            if with_passages:
                found = [[{"score": v, "first": i, "last": j} for v, i, j in p if m.lam * v > np.log(m.k * max(n, 1))] for n, _, p in (scan.passages(t.as_py()) for t in texts)]
                cols.append(pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", *["passages"] * with_passages])

    return docs.select(*keep, *["text"] * own).mapInArrow(scored, schema)
