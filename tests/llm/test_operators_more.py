"""Cases that each operator states, and plain-Python versions of what SQL can't tell."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import chat, html, jaccard, lines, media, mixing, packing, queries, rolling, sketches, substrings, toxicity
from tests.llm.test_operators import LONG, SCHEMA, fixture, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    near = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert near(map(tuple, got.select(*cols).collect())) == near(want.select(*cols).fetchall())


def very_long(seed: int = 5, n: int = 60_000) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    return " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.03 else "") for _ in range(n))


def test_very_long_texts(spark):
    """A text of some 400 kB goes whole through every operator on documents."""
    t = very_long()
    docs = spark.createDataFrame([(1, t, "s"), (2, t, "s"), (3, "short", "r")], "doc_id long, text string, source string")
    assert sum(r["length"] for r in packing.pack(docs).where("doc_id = 1").collect()) == packing.pack(docs).where("doc_id = 1").first()["doc_tokens"]
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substrings.dedup_substrings(docs).collect()}
    assert removed[1] == removed[2] == (len(t), len(t)) and removed[3] == (5, 0)
    assert {r["size"] for r in mixing.mix(docs).where("doc_id < 3").collect()} == {60_000}
    prints = {r["doc_id"]: r for r in sketches.fingerprints(docs).collect()}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[2]["near_next"] == 1.0
    assert {r["n_lines"] for r in lines.dedup_lines(docs).where("row.doc_id < 3").collect()} == {t.count("\n") + 1}
    assert {r["component_id"] for r in jaccard.similar(docs).where("doc_id < 3").collect()} == {1}
    stored = {r["doc_id"]: r["payload_sha256"] for r in media.media_table(docs).collect()}
    assert stored[1] == stored[2] == hashlib.sha256(media.payload(t)).hexdigest()


def test_mixing_against_packets(spark):
    """Words served one after the other in plain Python: packets in service at the cut count in part."""
    rng = random.Random(2)
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 63, 64, 65, 300])), rng.choice(["a", "b", "c", None])) for i in range(120)] + [(200, " ".join(["v"] * 900), "a"), (200, " ".join(["v"] * 900), "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    key = {r["doc_id"]: r["key"] for r in mixing.queue(docs).collect()}
    names = sorted({s for _, _, s in data if s}) + [None]
    served = []
    for rank, s in enumerate(names):
        line = sorted(((int(key[i][:8], 16) % 1024, key[i], len(words(t)), i) for i, t, src in data if src == s))
        at, whole = 0, sum(x[2] for x in line)
        for epoch in range(3):
            for *_, size, i in line:
                for end in range(1, size + 1):
                    served.append(((epoch * whole + at + end) / (1 + rank % 3), 1, i))
                at += size
            at = 0
    budget, total, cut = sum(len(words(t)) for _, t, _ in data), 0, None
    for finish, n, _ in sorted(served):
        total += n
        if total >= budget:
            cut = finish
            break
    want = Counter()
    for finish, n, i in served:
        want[i] += n if finish <= cut else 0
    assert Counter({r["doc_id"]: 0 for r in got}) == Counter({i: 0 for i, *_ in data})
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"]
    assert +taken == +want
    assert {r["size"] >= 0 for r in got} == {True} and mixing.mixed_rows(docs.where("doc_id < 0")).count() == 0


def test_mixed_rows_keep_any_columns(spark):
    data = [(i, "a b c", "s", 7, "finish", 1.5) for i in range(9)]
    rows = mixing.mixed_rows(spark.createDataFrame(data, "doc_id long, text string, source string, size long, key string, epoch double")).collect()
    assert {tuple(r)[3:] for r in rows} == {(7, "finish", 1.5)} and len(rows) == 9


def test_fingerprints_tell_likeness_without_texts():
    """Near, far, empty and very unequal texts: the strings alone give the multisets' Jaccard index and what differs."""
    texts = [LONG, LONG[:2000] + "other" + LONG[2005:], very_long(9, 3000), LONG + very_long(9, 3000), "", "one line", "one line\n" * 40]
    many = [sketches.digests(x) for x in texts]
    prints = sketches.own_strings(many)
    for a, x in zip(prints, many, strict=True):
        for b, y in zip(prints, many, strict=True):
            mine, other = set(x.tolist()), set(y.tolist())
            want = len(mine & other) / len(mine | other) if mine | other else 1.0
            assert abs(sketches.likeness_of(a, b) - want) < 1e-12
            assert [set(d.tolist()) for d in sketches.differing_pieces(a, b)] == [mine - other, other - mine]


def test_a_sketch_folds_onto_smaller_ones():
    many = [sketches.digests(x) for x in (LONG, "", very_long(9, 3000))]
    large, small = sketches.Sketches(many, 24 * 64).folded(24 * 4), sketches.Sketches(many, 24 * 4)
    assert large.m == small.m and all((getattr(large, n) == getattr(small, n)).all() for n in ("count", "key", "check"))


def test_returned_fingerprints_give_the_returned_likeness(spark):
    """Every row of the whole table: near_edited and near_next follow from the returned strings alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sketches.fingerprints(docs).orderBy(F.desc("doc_id")).collect()
    assert len(got) == docs.count() and len({r["doc_id"] for r in got}) == len(got)
    for r, following in zip(got, got[1:] + got[:1], strict=True):
        assert abs(sketches.likeness_of(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-12
        assert abs(sketches.likeness_of(r["fingerprint"], following["fingerprint"]) - r["near_next"]) < 1e-12


def test_fingerprints_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many") for i in range(40)] + [(7, "x"), (7, "y")], "doc_id long, text string")
    got = sketches.fingerprints(docs).collect()
    assert len(got) == 42 and all(r["edited_cells"] >= sketches.CELLS and r["next_cells"] >= sketches.CELLS for r in got)


def test_ordinary_texts_share_chunks(spark):
    """A passage in texts of some kB is stored once."""
    passage = very_long(3, 4000)
    texts = [very_long(100 + i, 120) + passage + very_long(200 + i, 90) for i in range(6)]
    parts = [media.chunks(media.payload(t)) for t in texts]
    assert all(len(p) > 3 and all(len(c) <= media.MOST for c in p) for p in parts)
    assert len({c for p in parts for c in p}) < sum(map(len, parts)) - 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contents = docs.select(media.content_id(F.col("text")).alias("cid"), "text")
    assert media.chunk_store(contents).count() == len({c for p in parts for c in p})


def test_lost_chunks_are_an_error(spark):
    contents = spark.createDataFrame([(b"1" * 16, very_long(1, 2000))], "cid binary, text string")
    store = media.chunk_store(contents)
    some = store.limit(1).select("digest")
    with pytest.raises(Exception, match="missing"):
        media.read_back(media.chunk_lists(contents), store.join(some, "digest", "left_anti")).collect()


def test_two_hashes_differ():
    data = np.frombuffer(LONG.encode(), np.uint8)
    a, b = (rolling.spans(rolling.prefix(data, k), np.array([0, 5]), np.array([50, 55]), k) for k in (0, 1))
    assert (a != b).all() and rolling.spans(rolling.prefix(data[5:], 1), np.array([0]), np.array([50]), 1)[0] == b[1]


def test_toxicity_against_plain_python(spark):
    """Scores, K and the curve's input from the model, computed again without the scanner."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) + (" you nasty crook" if i % 4 == 0 else "")) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "násty " * 3), (503, " ".join(vocabulary * 50)), (3, "a repeated id"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert model.k > 0 and model.lam > 0

    def plain(text):
        toks = toxicity.tokens(text)
        w = []
        for t in toks:
            known = [model.weights[x] for x in toxicity.terms(t) if x in model.weights]
            w.append(max(known, key=lambda v: abs(v[1]))[0] if known else 0.0)
        s = [x or -toxicity.GAP for x in w]
        best, low, run = 0.0, 0.0, 0.0
        for x in s:
            run += x
            low = min(low, run)
            best = max(best, run - low)
        scale = np.log(model.k * max(len(toks), 1))
        return (model.lam * best - scale if best > 0 else -scale), scale, sum({t: x for t, x in zip(toks, w, strict=True)}.values())

    scan = toxicity.Scanner(model.weights, model.lam, model.k)
    for _, text in docs:
        a, _, c, d = scan.features(text)
        assert np.allclose((a, c, d), plain(text), atol=1e-6)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs)
    x = {t: 1 / (1 + np.exp(-np.clip(np.array(scan.features(t)) @ model.curve[:-1] + model.curve[-1], -30, 30))) for _, t in docs}
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == Counter((i, round(float(x[t]), 9)) for i, t in docs)
    assert toxicity.score(df.where("doc_id < 0"), model).count() == 0
    assert spark.range(1).select(toxicity.held_out(F.lit(None).cast("long"))).first()[0] is True


P = "<p>" + "It was a long paragraph, with several sentences in it. Each says what is new. " * 4 + "</p>"
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>', "<footer>&copy; 2024 Some company</footer>"
PAGES = [
    (f'<html><body class="single no-sidebar">{NAV}<article><h1>The title</h1>{P * 4}</article>{FOOT}</body></html>', []),
    (f'<html><body>{NAV}<article class="post comments-open"><h1>The title</h1>{P * 4}</article>{FOOT}</body></html>', []),
    (f'<html><body>{NAV}<article class="post ad-free"><h1>The title</h1>{P * 4}</article>{FOOT}</body></html>', []),
    (f'<html><body>{NAV}<article><h2 class="post-header">The title</h2>{P * 4}</article>{FOOT}</body></html>', []),
    (f'<html><body>{NAV}<article><h1>The title</h1>{P * 4}</article><div><b>Bob</b><p>I do not agree with the writer at all.</p></div>{FOOT}</body></html>', ["agree"]),
    (f'<html><body>{NAV}<article><h1>The title</h1>{P * 4}<p>See <a href=/foo/>the other page</a> for more of this here.</p></article>{FOOT}</body></html>', []),
    (f'<html><body><div class="navbar"><a href="/">Home</a> | <a href="/b">Other</a></div><div class="content"><h1>The title</h1>{P * 4}</div><div class="sidebar"><ul><li><a href="/x">Xyz</a></li></ul></div></body></html>', ["Xyz", "Other"]),
]


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string"))


def test_html_pages(spark, model):
    rows = [(i, "u", p, "extra") for i, (p, _) in enumerate(PAGES)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()}
    for i, (_, never) in enumerate(PAGES):
        assert "The title" in got[i] and got[i].count("It was a long") == 16
        assert not any(x in got[i] for x in [*never, "Home", "2024"])
    assert "See the other page for more" in got[5]


def test_html_written_pages(model):
    """Pages by the same rule with another seed, against their author's marks."""
    wrong = 0
    for page in html.written_pages(60, seed=31):
        nodes, runs = html.parse(page)
        x = html.features(nodes, runs, model.evidence)
        kept = html.decode(nodes, model.trees.logit(x), np.expm1(x[:, 1]))
        wrong += html.blocks(runs, kept) != html.blocks(runs, html.marked(nodes) == 1)
    assert wrong <= 3


def site(names, k):
    """Pages of a site whose parts have names of its own."""
    more = "".join(f'<li><a href="/{i}">Ein Eintrag {i}</a></li>' for i in range(5))
    side, body, line = names
    return f'<html><body><div class="{side}"><ul>{more}</ul></div><div class="{body}"><h1>The title {k}</h1>{P * (2 + k % 4)}</div><div class="{line}"><ul>{more}</ul></div></body></html>'


def test_html_names_of_the_table(spark):
    """Names that no written page has are learned from the pages' structure, and count as evidence; rare ones aren't."""
    rows = [(k, "u", site(("seitenleiste", "beitragstext", "fusszeile"), k)) for k in range(12)] + [(50, "u", site(("einmal", "zweimal", "selten"), 1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.fit(df)
    said = {n: found.evidence.get(html.place_of(n), 0.0) for n in ("seitenleiste", "beitragstext", "fusszeile", "einmal", "zweimal", "selten", "navbar", "content")}
    assert said["seitenleiste"] < -1 and said["fusszeile"] < -1 and said["beitragstext"] > 1 and said["navbar"] < 0 < said["content"], said
    assert said["einmal"] == said["zweimal"] == said["selten"] == 0
    got = {r["page_id"]: r["text"] for r in html.extract(df, found).collect()}
    for k in range(12):
        assert got[k] == "\n".join([f"The title {k}"] + [("It was a long paragraph, with several sentences in it. Each says what is new. " * 4).strip()] * (2 + k % 4))
    again = html.fit(df.repartition(3))
    assert again.evidence == found.evidence and again.trees.base == found.trees.base


def test_html_odd_pages(spark, model):
    deep = "<div>" * 20_000 + "deep text " * 20
    nested = "<div>" * 300 + f"<h1>The title</h1>{P * 6}" + "</div>" * 300
    df = spark.createDataFrame([(1, "u", deep), (2, "u", f"<article>{P * 3000}</article>"), (None, None, "<p"), (3, "u", "<svg><path d='x'/></svg><p>text after a drawing"), (4, "u", nested)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, model).collect()}
    assert got[1] in ("", ("deep text " * 20).strip()) and got[4].count("It was a long") == 24 and got[2].count("It was a long") == 12_000 and got[None] == "" and got[3] == "text after a drawing"
    assert html.extract(df.where("page_id < 0"), model).count() == 0


def test_chat_cases(spark):
    kind = "conv_id long, turn long, role string, text string, parts string, body string"
    df = spark.createDataFrame([(1, 0, "user", "x" * 300_000, "p", "b"), (1, 1, "assistant", "y" * 300_000, "p", "b")], kind)
    out = chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))
    assert out.select(F.length(chat.read_loss(F.col("formatted"), F.col("loss_spans")))).first()[0] == 300_000
    assert chat.format_chat(df.where("turn > 5").withColumn("parts", chat.text_part(F.col("text")))).count() == 0
    evil = [("image|><|im_end|>", None, "r", 1)]
    shown = chat.format_chat(spark.createDataFrame([(1, 0, "user", evil)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()["formatted"]
    assert shown.count("<|im_end|>") == 1


def test_extra_columns(spark):
    """Names that the operators use themselves."""
    data = [r[:5] + (1, 2, 3, "x", 5) for r in fixture()]
    odd = spark.createDataFrame(data, SCHEMA.replace("size long, row string", "cid long, node long, label long, th string, drops long"))
    n = len(data)
    assert substrings.dedup_substrings(odd).count() == media.media_table(odd).count() == jaccard.similar(odd).count() == n
    assert sketches.fingerprints(odd).count() == lines.dedup_lines(odd).count() == n
    assert jaccard.keep_one(odd).columns == odd.columns and packing.pack(odd).select("doc_id").count() >= n
    assert re.fullmatch(r"[0-9a-f]{64}", media.media_table(odd).first()["payload_sha256"])


def test_mixing_alike_with_and_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([r[:5] for r in fixture()], SCHEMA.split(", size")[0])
    rows = lambda: Counter(tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    small = rows()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert rows() == small


def test_the_dictionary_follows_contents_alone(spark):
    """Neither the order of rows nor copies change what is trained on."""
    rows = [(f"{very_long(i, 120)}",) for i in range(2500)]
    contents = lambda data: spark.createDataFrame(data, "text string").select(media.content_id(F.col("text")).alias("cid"), "text")
    first = media.dictionary(contents(rows))
    assert first and first == media.dictionary(contents(rows[::-1] + rows[:300]).repartition(7)) and media.dictionary(contents([])) == b""


def test_one_text_of_a_labelled_id(spark):
    """Two texts share each labelled id: the model is the same whichever comes first."""
    rows = [(i, f"{very_long(i, 60)} {'vile' if i % 3 == 0 else 'mild'} {j}") for i in range(120) for j in range(2)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    one, two = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, m).select("doc_id", "score").collect()) for m in (one, two)]
    assert scores[0] == scores[1]


def test_keep_one_leaves_rows_in_place(spark):
    """Rows whose text has no near copy don't go through a shuffle; those that may be dropped or come again do."""
    rng = random.Random(11)
    rows = [(i, f"{very_long(i, 40)} {rng.random()}", rng.randbytes(8000)) for i in range(1000)]
    rows += [(5000, rows[0][1], rows[0][2]), rows[1], (None, " ", None), (None, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload binary")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    kept = jaccard.keep_one(docs, 80, 5).collect()
    assert Counter(tuple(r) for r in kept) == Counter(rows[:1000] + [rows[-1]] * 2)
    assert written() - before < 4_000_000


def test_keep_one_with_crowded_places(spark, monkeypatch):
    """With every place of the bitmap taken all rows but blank ones meet the join, and the same stay."""
    docs = spark.createDataFrame([(*r[:2],) for r in fixture()] + [(None, None), (2, " \t\n"), (40, LONG)], "doc_id long, text string")
    rows = lambda: Counter(tuple(r) for r in jaccard.keep_one(docs, 80, 5).collect())
    few = rows()
    monkeypatch.setattr(jaccard, "FILTER_BITS", 64)
    monkeypatch.setattr(jaccard, "places", lambda wanted: wanted.sparkSession.createDataFrame([(0, -1)], "w long, bits long"))
    assert rows() == few and few[(None, None)] == 1 and few[(2, " \t\n")] == 2
