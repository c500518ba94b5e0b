import random
from collections import Counter

import corpus_pipeline
from hirelake.llm import mixing
from tests.llm.test_operators import LINE, LONG, SCHEMA, fixture, words


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(fixture(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        texts = [r["text"] for r in docs.collect()] if "text" in docs.columns else []
        if name == "toxicity":
            assert len(texts) == len(fixture())
        if name == "line_dedup":
            assert sum(LINE in (t or "") for t in texts) == 1
        if name == "ngram_jaccard":
            assert texts.count(LONG) == 1
    assert docs.count() > 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_against_plain_python(spark, tmp_path):
    """Toxic documents, shared lines, near copies and sources of different sizes; each stage on what the last one kept."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    data = [(i, text(rng.randint(30, 120)) + (" you nasty rotten crook" if i % 5 == 0 else ""), "en", "abc"[i % 3], 0) for i in range(300)]
    data += [(1000 + i, f"{text(40)}\n{LINE}\n{text(40)}", "en", "a", 0) for i in range(8)]
    long = text(300)
    data += [(2000 + i, f"{long} {text(2)}", "en", "b", 0) for i in range(6)] + [(3000, None, None, None, None), (3001, "", "en", "c", 0), (None, text(50), "en", "a", 0)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages, at = dict(corpus_pipeline.STAGES), {}

    def run(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return [tuple(r) for r in at[name].collect()]

    first = run("toxicity", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert Counter(first) == Counter((*r[:4], len(r[1] or "")) for r in data if not (r[0] is not None and r[0] < 300 and r[0] % 5 == 0))
    second = run("line_dedup", at["toxicity"])
    cut = {r[0]: r[1] for r in second}
    assert [LINE in (cut[1000 + i] or "") for i in range(8)] == [False] * 7 + [True]
    assert all(r[4] == len(r[1] or "") for r in second) and len(second) == len(first)
    third = run("ngram_jaccard", at["line_dedup"])
    assert Counter(r[0] for r in third) == Counter(r[0] for r in second if not (r[0] and 2000 < r[0] < 2006))
    fourth = run("mixing", at["ngram_jaccard"])
    size = Counter()
    for r in third:
        size[r[3]] += len(words(r[1]))
    got = Counter()
    for r in fourth:
        got[r[3]] += len(words(r[1]))
    target = {r["source"]: r["target"] for r in mixing.mix(at["ngram_jaccard"]).collect()}
    assert max(Counter(fourth).values()) <= 3 and set(fourth) <= set(third) and abs(got.total() - size.total()) < 500
    assert all(abs(got[s] - t) < 400 for s, t in target.items())
    pieces = run("packing", at["mixing"])
    assert len(pieces) >= len(fourth)
    tokens = {(r["doc_id"], r["start"], r["sequence_id"]): r["length"] for r in at["packing"].collect()}
    assert sum(tokens.values()) == sum(r["doc_tokens"] for r in at["packing"].where("start = 0").collect())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
