"""Each operator against plain Python on a small fixture with nulls, empty texts, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelake.llm import chat, html, jaccard, lines, media, mixing, packing, sketches, substrings, toxicity

LONG = " ".join(f"word{i} of the long text number {i % 7}" for i in range(120))
LINE = "this very line is shared by a good many documents here"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string"


def fixture():
    texts = [None, "", " \t\n", "one", "Ärger mit Ümlauten", LONG, LONG, LONG + " end", LONG[:1500] + " other " + LONG[1500:], "x" * 3000, "a\\b <|im_end|> c"]
    texts += [f"start {i}\n{LINE}\n{LINE.upper()}  \nend {i}" for i in range(7)]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 1, "x") for i, t in enumerate(texts)]
    out += [(3, "one", "en", "s1", 3, 1, "x"), (3, "another text with the same id", None, None, None, None, None), (None, "no id", "en", "s0", 5, 1, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_pack(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    by = {}
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    whole = []
    for parts in by.values():
        parts.sort(key=lambda r: r["start"])
        whole += [tuple(i for r in parts for i in r["ids"])] if len({r["start"] for r in parts}) == len(parts) else []
    want = Counter(tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in fixture())
    assert set(whole) <= set(want) and sum(r["length"] for r in got) == sum(len(k) * n for k, n in want.items())
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 10_000])
def test_pieces(n):
    p = packing.pieces(n)
    assert sum(p) == n and p == sorted(p, reverse=True)


def test_substrings(docs, none):
    data = [(r[0], (r[1] or "").encode()) for r in fixture()]
    seen = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in substrings.dedup_substrings(docs).collect()]
    assert Counter(got) == Counter(want) and any(x[2] for x in want)
    assert substrings.dedup_substrings(none).count() == 0


def test_difference_cover():
    v, d = substrings.difference_cover()
    assert v == 307 and len(d) == 18 and {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in fixture():
        size[r[3]] += len(words(r[1]))
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # Sources in code point order, null last, weigh 1, 2, 3.
    weight = dict(zip(sorted(target, key=lambda s: (s is None, s or "")), [1, 2, 3] * len(target), strict=False))
    assert all(abs(taken[s] - t) < 1 + weight[s] * len(target) / sum(weight.values()) and t <= 3 * size[s] for s, t in target.items())
    # Words that finish at the same time go together, one per source at most.
    assert sum(size.values()) <= sum(taken.values()) < sum(size.values()) + len(target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert mixing.mix(none).count() == 0
    assert Counter(map(tuple, mixing.mix(docs).select("doc_id", "size", "taken").collect())) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mixed_rows_stay_near_the_targets(docs):
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() > 0


def test_sketches(docs, none):
    data = sorted(((r[0], r[1] or "") for r in fixture()), key=lambda x: (x[0] if x[0] is not None else -1, x[1]), reverse=True)
    want = []
    for i, (k, t) in enumerate(data):
        n = data[(i + 1) % len(data)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (Counter(sketches.digests(x).tolist()) for x in (t, e, n))
        like = lambda x, y: (x & y).total() / (x | y).total() if x or y else 1.0
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in sketches.fingerprints(docs).collect()]
    assert Counter(got) == Counter(want)
    assert sketches.fingerprints(none).count() == 0
    assert sketches.fingerprints(docs.where("doc_id = 5")).first()["near_next"] == 1.0


def test_peeling_recovers_what_differs():
    a, b = sketches.digests(LONG), sketches.digests(LONG[:2000] + "something else entirely")
    got, used = sketches.differing([a, a], [b, a])
    assert got.tolist() == [len(set(a.tolist()) ^ set(b.tolist())), 0]


def test_lines(docs, none):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    where = {}
    for r in fixture():
        for x in (r[1] or "").split("\n"):
            where.setdefault(key(x), set()).add(r[0])
    want = []
    for r in fixture():
        ls = (r[1] or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 40 and len(where[key(x)]) >= 5 and max(w for w in where[key(x)] if w is not None) != r[0])]
        want.append((r[0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(docs).collect()]
    assert Counter(got) == Counter(want) and any(x[2] for x in want)
    assert lines.dedup_lines(none).count() == 0


def brute_components(data, percent, size):
    sets = []
    for _, t in data:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = words(w)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


def test_jaccard(spark, docs, none):
    base = [f"w{i}" for i in range(120)]
    data = [(r[0], r[1]) for r in fixture()] + [(100 + k, " ".join(base[:j] + [f"edit{k}"] + base[j + 1 :])) for k, j in enumerate(range(0, 120, 9))] + [(200 + k, " ".join(base[:j] + [f"e{k}", "f"] + base[j + 2 :] + [f"tail{k}"] * 9)) for k, j in enumerate(range(3, 110, 11))]
    sets, label = brute_components(data, 85, 4)
    want = []
    for i, (d, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if label[j] == label[i] and data[j][0] is not None]
        want.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter(want)
    assert jaccard.similar(none).count() == 0


def test_keep_one(docs):
    kept = jaccard.keep_one(docs)
    texts = [r["text"] for r in kept.collect()]
    assert kept.columns == docs.columns and texts.count(LONG) == 1 and None in texts and "no id" in texts


def test_media(docs, none):
    got = {(r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in media.media_table(docs).collect()}
    want = set()
    for r in fixture():
        p = media.payload(r[1])
        want.add((r[0], len((r[1] or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media.wav_header(len(p)) + p).hexdigest()))
    assert got == want and media.media_table(docs).count() == len(fixture())
    assert media.media_table(none).count() == 0


def test_long_media_come_back(spark):
    import random

    rng = random.Random(1)
    big = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    df = spark.createDataFrame([(1, big), (2, "y" + big), (3, big)], "doc_id long, text string")
    assert len(media.chunks(media.payload(big))) > 5
    got = {r["doc_id"]: r["payload_sha256"] for r in media.media_table(df).collect()}
    assert got[1] == got[3] == hashlib.sha256(media.payload(big)).hexdigest() and got[2] == hashlib.sha256(media.payload("y" + big)).hexdigest()


def test_a_changed_chunk_is_noticed():
    with pytest.raises(Exception, match="doesn't match"):
        import zstandard

        media._opener(b"")(b"0" * media.DIGEST, zstandard.compress(b"other"))


def test_read_back_notices_changed_and_lost_chunks(spark):
    import zstandard

    contents = spark.createDataFrame([(b"a" * 16, "some text " * 2000), (b"b" * 16, "short")], "cid binary, text string")
    lists, store = media.chunk_lists(contents), media.chunk_store(contents)
    assert media.read_back(lists, store).count() == 2
    other = F.lit(bytearray(zstandard.compress(b"other")))
    with pytest.raises(Exception, match="doesn't match"):
        media.read_back(lists, store.withColumn("stored", other)).collect()
    first = store.agg(F.min("digest").alias("d")).first()["d"]
    with pytest.raises(Exception, match="a chunk is missing"):
        media.read_back(lists, store.where(F.col("digest") != F.lit(first))).collect()


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\s <|im_start|>\n"), (1, 1, "assistant", "a<|b<\\p"), (1, 2, None, None), (2, None, "us\ner", ""), (None, 1, "assistant", "x<"), (1, 3, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in out.collect()}
    assert got[1] == ([("user", "hi \\s <|im_start|>\n"), ("assistant", "a<|b<\\p"), ("", ""), ("assistant", "z")], "a<|b<\\pz")
    assert got[2] == ([("us\ner", "")], "") and got[None] == ([("assistant", "x<")], "x<")


def test_typed_parts(spark):
    parts = [("text", "see ", None, 0), ("image", None, "s3://a.png", 4), ("text", " and ", None, 0), ("audio", None, "b.wav", 10), ("odd", None, "c", 9)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df).first()
    assert "see <|image_1|> and <|audio_3|><|odd_4|>" in r["formatted"]
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "s3://a.png", 1024), (3, "audio", "b.wav", 250), (4, "odd", "c", 0)]
    assert r["expanded_tokens"] == 1274


def test_segments_against_all_sums():
    import random

    rng = random.Random(3)
    for _ in range(50):
        s = [rng.choice([2.0, 1.0, -1.0, -1.5]) for _ in range(30)]
        found = toxicity.segments(s, list(range(30)), 0.0)
        best = max(sum(s[i:j]) for i in range(30) for j in range(i + 1, 31))
        assert abs(max((x[0] for x in found), default=best) - best) < 1e-9 or best <= 0
        assert all(abs(sum(s[a : b + 1]) - v) < 1e-9 for v, a, b in found)


def test_toxicity_learns(spark):
    good, bad = "the quick brown fox jumps over a lazy dog", "you are a nasty crook and a fool"
    docs = spark.createDataFrame([(i, (bad if i % 3 == 0 else good) + f" n{i % 5} xyz") for i in range(300)] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), with_passages=True).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    empty = toxicity.fit(docs, labels.where("toxic = 5"))
    assert toxicity.score(docs, empty).where("score >= 0.5").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this</div><article><h1>A &amp; B</h1><p>First   <b>paragraph,
long enough to be one.<br>next<p>Second one&nbsp;here, with many more words in it.</p></article><div class="comments"><p>A reader says so.</p></div>
<form>Search</form><footer>&copy; 2024</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain &lt; text"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html.extract(df, html.fit(df)).collect()]
    want = "A & B\nFirst paragraph, long enough to be one. next\nSecond one here, with many more words in it."
    assert Counter(got) == Counter([(1, want), (1, want), (2, ""), (3, ""), (4, "plain < text")])


def test_html_choices_agree():
    nodes, runs = html.parse(PAGE)
    import numpy as np

    kept = html.decode(nodes, np.random.default_rng(0).normal(size=len(nodes)), np.ones(len(nodes)))
    assert all(kept[x.parent] for i, x in enumerate(nodes) if i and kept[i])


def test_held_out(spark):
    rows = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_keep_one_ids(spark):
    """A null id and 0 are different ids; repeated rows and blank texts."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(None, a), (0, b), (0, b), (7, b), (None, " "), (3, None)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(docs, 80, 5).collect()]
    assert len(kept) == 4 and set(kept) == {(None, a), (0, b), (None, " "), (3, None)}
    swapped = jaccard.keep_one(docs.selectExpr("if(doc_id is null, 0, if(doc_id = 0, null, doc_id)) as doc_id", "text").where("trim(text) <> ''"), 80, 5)
    assert swapped.count() == 2


def test_keep_one_of_unlinked_texts(spark):
    """Texts that aren't linked all stay, with null ids or one id; linked ones leave one; against plain Python."""
    t = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdefg"]
    data = [(None, t[0]), (None, t[1]), (None, t[2]), (5, t[3]), (5, t[4]), (None, t[2] + " end"), (6, t[5]), (7, t[5] + " end"), (5, t[6]), (8, t[6]), (None, t[0]), (5, t[3])]
    sets = [{tuple(words(x)[i : i + 5]) for i in range(len(words(x)) - 4)} for _, x in data]
    label = list(range(len(data)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                label = [label[j] if k == label[i] else k for k in label]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string"), 80, 5).collect()]
    assert len(set(label)) == 7 and sorted(label[data.index(r)] for r in kept) == sorted(set(label))
    for doc_id, x in kept:
        ids = [data[k][0] for k, c in enumerate(label) if c == label[data.index((doc_id, x))]]
        assert doc_id == (None if None in ids else min(ids))


@pytest.mark.parametrize("start", ["<body>", "<body class=x><!-- c -->", "", "\n", "<custom-part>"])
def test_html_without_head_end(spark, start):
    closed = PAGE.replace("<body>", start)
    cut = closed.replace("</head>", "")
    assert closed.count("</head>") == 1 and [n.kind for n in html.parse(cut)[0]] == [n.kind for n in html.parse(closed)[0]]
    model = html.fit(spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string"))
    df = spark.createDataFrame([(1, "u", closed), (2, "u", cut), (3, "u", "<head><title>no</title> plain &lt; text")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, model).collect()}
    assert got[2] and got[1] == got[2] and got[3] == "plain < text"
