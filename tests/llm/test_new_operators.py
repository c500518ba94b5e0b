"""Vector codes, token counts and periodic runs against plain Python, with nulls, empty texts, ties, repeated rows and odd columns."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import codes, periodic, queries, tokencount
from hirelake.llm.packing import tokenizer_path
from tests.llm.test_operators import LONG, SCHEMA, fixture, words

DATA = "/root/testdata/sf0.001"


def texts():
    more = [" ", "  two  spaces ", "a\n\n b\n", "▁a▁ b", "<s> </s> <unk>", "x" * 5000, "日本語 🙂\x00 é", "tab\tand\r\nline", LONG + "\n" + "y z " * 3000]
    return [(i, t) for i, t in enumerate(more)] + [(0, " "), (0, " "), (None, None), (None, "  two  spaces "), (99, "")]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokencount.MODEL))


@pytest.mark.parametrize("common", [tokencount.COMMON, 40, 0])
def test_token_counts(spark, library, common):
    """With all pre-tokens broadcast, some, and none but the row of documents."""
    data = texts() + [(r[0], r[1]) for r in fixture()]
    docs = spark.createDataFrame([(*r, "en", 1, 2) for r in data], "doc_id long, text string, key string, n_tokens long, pieces int")
    out = tokencount.token_counts(docs, common=common)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in data]
    assert Counter(map(tuple, out.collect())) == Counter(want) and any(x[3] for x in want)
    assert tokencount.token_counts(docs.where("false"), common=common).count() == 0


def test_pretokens_are_counted_alone(library):
    count = tokencount.PieceCounter(tokenizer_path(tokencount.MODEL))
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab \nÄé🙂▁.1") for _ in range(rng.randint(0, 40)))
        assert sum(count(tokencount.pretokens(t))) == len(library.encode(t)), t


def test_the_least_frequency_bounds_the_broadcast(spark):
    met = [1] * 50 + [2, 3] * 10 + [8] * 5 + [1000]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(met)], "key long, met long")
    for most in (0, 1, 5, 6, 25, 26, 75, 76, 1000):
        least = tokencount.common_from(rows, most)
        assert sum(m >= least for m in met) <= most and sum(2 * m >= least for m in met) >= min(most, len(met)) * (least > 1)
    assert tokencount.common_from(rows.where("false"), 5) == 1


def brute_runs(w, least=6, powers=4):
    n, out = len(w), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, powers * q) and not any(all(w[k] == w[k + r] for k in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_words(rng, letters, n):
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if rng.random() < 0.6 and n > 4:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least,powers", [(6, 4), (2, 2), (5, 3), (10, 5)])
def test_runs_in_many_lists(least, powers):
    rng, met = random.Random(powers), 0
    for _ in range(250):
        lists = [periodic_words(rng, rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 5, 6, 10, 30, 60])) for _ in range(rng.randint(1, 5))]
        want = [brute_runs(w, least, powers) for w in lists]
        assert [[tuple(r) for r in g.tolist()] for g in periodic.runs_in(lists, least, powers)] == want
        met += sum(map(len, want))
    assert met > 100


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(60):
        c = np.append(rng.integers(0, 3, rng.integers(0, 60)), 99)
        order, rank, lcp = periodic.suffix_array(c)
        t = c.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:]) and (rank[order] == np.arange(len(t))).all()
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_periodic_runs(spark):
    rng = random.Random(4)
    data = [(i, b" ".join(periodic_words(rng, 3, rng.choice([6, 40, 90]))).decode()) for i in range(60)]
    data += [(7, "a " * 30_000), (None, "b b b b b b\tb"), (None, None), (8, ""), (8, " \n"), (9, data[0][1]), (9, data[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, runs string, start int")
    got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    for i, t in data:
        w = words(t)
        runs = brute_runs(w) if len(w) < 1000 else [(0, 30_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want and periodic.periodic_runs(docs.where("false")).count() == 0


def test_periodic_query(spark, tmp_path):
    """The query's planted tails and digests, from the whole table."""
    rng = random.Random(5)
    data = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 9, 80, 300])))) for i in range(600)] + [(None, "a b"), (40, None), (41, "c")]
    spark.createDataFrame([(*r, "en", "s", 0) for r in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t in data:
        w = words(t)
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert Counter(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect())) == want
    assert sum(k[1] > 0 for k in want) > 5


def brute_codes(rows, dim, parts=8, entries=16, rounds=6):
    kept = [(i, lab, np.floor(np.array(v, np.float64) * 4096).astype(np.int64).reshape(parts, -1)) for i, v, lab in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) <= 32768 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = np.stack([r[2] for r in kept])
    book = x[:entries].transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        near, own = d.argmin(2), d.min(2)
        for p in range(parts if i < rounds else 0):
            for e in range(book.shape[1]):
                if (near[:, p] == e).any():
                    book[p, e] = x[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
    total = Counter()
    for r, e in zip(kept, own.sum(1), strict=True):
        total[r[1]] += int(e)
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return Counter((r[0], bytes(c.astype(np.uint8)).hex(), int(e), total[r[1]], sha) for r, c, e in zip(kept, near, own.sum(1), strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, code string, state int"


@pytest.mark.parametrize("n,spread", [(300, 3), (300, 100), (5, 100)])
def test_vector_codes(spark, n, spread):
    """Coarse components tie often; one label is a third of all; a few vectors give as few entries."""
    rng = np.random.default_rng(n + spread)
    data = [(int(i), (rng.integers(-spread, spread, 16) / 64).astype(np.float32).tolist(), int(rng.integers(0, 4)) if i % 3 else 7) for i in rng.permutation(n)]
    bad = [None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e9] + [0.0] * 15, [1.0] * 8, [1.0] * 15]
    data += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(0, data[3][1], None), (0, data[3][1], None), (None, data[4][1], None), (2000, [30_000.0, -30_000.0] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 0) for r in data], VECTORS)
    out = codes.vector_codes(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, out.collect())) == brute_codes(data, 16)
    assert codes.vector_codes(df.where("false")).count() == codes.vector_codes(df.where("embedding is null")).count() == 0


def test_bounds_leave_parts_alone_and_change_nothing():
    """Rounds with bounds against full scans, entry by entry, and fewer parts scanned than there are."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-4000, 4000, (16, 2, 4))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-150, 150, (3000, 2, 4))
    history = x[:16].transpose(1, 0, 2)[None].copy()
    state, scans = np.zeros(len(x), codes._record(2)), []
    for _ in range(8):
        scans.append(codes.assign(x, state, history))
        near = ((x[:, :, None] - history[-1][None]) ** 2).sum(-1).argmin(2)
        assert (state["now"] == near).all()
        book = history[-1].copy()
        for p in range(2):
            for e in range(16):
                if (near[:, p] == e).any():
                    book[p, e] = x[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
        history = np.concatenate([history, book[None]])
    assert scans[0] == 6000 and scans[-1] < 3000 and {int(s) for s in np.unique(state["lower_at"])} - {7}


def test_net_displacements_are_tighter_than_sums_of_drifts():
    rng = np.random.default_rng(1)
    history = rng.integers(-50, 50, (6, 1, 4, 3))
    net = codes.Moves(history).own[:, 0]
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(-1))[:, 0]
    for s in range(6):
        assert (net[s] <= steps[s:].sum(0) + 1e-3).all()
    assert (net[5] == 0).all() and (net[0] < steps.sum(0) - 1).any()


def test_the_fixture_passes_too(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    assert periodic.periodic_runs(docs).count() == tokencount.token_counts(docs).count() == len(fixture())
    assert docs.select(periodic.repeated_tail(F.col("doc_id"), F.col("text"))).count() == len(fixture())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_vector_codes_twin(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got, want = queries.op11_vector_codes(spark, DATA), db.sql(queries.ORACLES["op11_vector_codes"])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
