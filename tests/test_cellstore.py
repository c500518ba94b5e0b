"""The store of vectors by cell: appends, checks, searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.operators import cellstore, vectors

KINDS = ("title", "skills")


def data(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 3
    x = {k: centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) for k in KINDS}
    return {k: m / np.linalg.norm(m, axis=1, keepdims=True) for k, m in x.items()}


def frames(spark, x, ids):
    rows = [("s", int(i), k, x[k][i].tolist()) for k in KINDS for i in ids]
    meta = [("s", int(i), f"b{i % 3}", f"posting {i}") for i in ids]
    return spark.createDataFrame(rows, "source string, id long, kind string, vec array<double>"), spark.createDataFrame(meta, "source string, id long, crawl_batch string, title string")


def stored(spark, root):
    return sorted((r["kind"], r["cell"], r["id"], tuple(r["vec"])) for r in cellstore.read_vectors(spark, root).collect())


def test_appends_equal_one_build(spark, tmp_path):
    x = data(90)
    vecs, meta = frames(spark, x, range(90))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    cellstore.train_centres(vecs, 4, a)
    spark.read.parquet(f"{a}/centres").write.parquet(f"{b}/centres")
    assert cellstore.append_vectors(a, vecs, meta, KINDS) == ["b0", "b1", "b2"]
    for batch in ("b1", "b0", "b2", "b1"):
        cellstore.append_vectors(b, vecs, meta.where(F.col("crawl_batch") == batch), KINDS)
    assert stored(spark, a) == stored(spark, b) and len(stored(spark, a)) == 180
    assert {r["side"]: r["n"] for r in cellstore.store_counts(spark, b).collect()} == {"title": 90, "skills": 90, "metadata": 90}
    assert cellstore.append_vectors(b, vecs, meta, KINDS) == []


def test_an_append_that_stopped_goes_on(spark, tmp_path):
    """Vectors were written, the batch's metadata wasn't: nothing is there twice afterwards."""
    vecs, meta = frames(spark, data(40), range(40))
    root = str(tmp_path)
    cellstore.train_centres(vecs, 4, root)
    half = cellstore.with_cells(vecs.where("id < 20"), cellstore.read_centres(spark, root))
    half.write.partitionBy("kind", "cell").parquet(f"{root}/vectors")
    cellstore.append_vectors(root, vecs, meta, KINDS)
    assert len(stored(spark, root)) == 80


@pytest.mark.parametrize("wrong", ["no vector", "no metadata", "two vectors", "two rows"])
def test_what_does_not_match_is_an_error(spark, tmp_path, wrong):
    vecs, meta = frames(spark, data(12), range(12))
    root = str(tmp_path)
    cellstore.train_centres(vecs, 2, root)
    if wrong == "no vector":
        vecs = vecs.where("not (id = 3 and kind = 'title')")
    if wrong == "two vectors":
        vecs = vecs.unionByName(vecs.where("id = 3 and kind = 'title'"))
    if wrong == "two rows":
        meta = meta.unionByName(meta.where("id = 3"))
    if wrong == "no metadata":
        with pytest.raises(Exception, match="don't match"):
            cellstore.checked(vecs, meta.where("id <> 3"), KINDS).collect()
        return
    with pytest.raises(Exception, match="don't match"):
        cellstore.append_vectors(root, vecs, meta, KINDS)


@pytest.mark.parametrize("query_bytes", [1 << 20, 0])
def test_search_meets_its_cells_only(spark, tmp_path, query_bytes):
    """Against plain numpy, with broadcast queries and in blocks; all cells are the exact search."""
    x = data(300)
    vecs, meta = frames(spark, x, range(300))
    root = str(tmp_path)
    cellstore.train_centres(vecs, 6, root)
    cellstore.append_vectors(root, vecs, meta, KINDS)
    queries = vecs.where("kind = 'title' and id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    c = cellstore.read_centres(spark, root)["title"]
    cell = (x["title"] @ c.T).argmax(1)
    for nprobe in (2, 6):
        got = cellstore.search(spark, root, queries, "title", 5, nprobe, query_bytes).collect()
        want = set()
        for q in range(0, 300, 20):
            near = np.argsort(-(x["title"][q] @ c.T), kind="stable")[:nprobe]
            pool = np.flatnonzero(np.isin(cell, near))
            best = sorted(pool, key=lambda i: (-round(float(x["title"][q] @ x["title"][i]), 9), i))[:5]
            want |= {(q, int(i), len(pool)) for i in best}
        assert {(r["query_id"], r["item_id"], r["met"]) for r in got} == want and len(got) == len(want)
    exact = vectors.top_k(queries, vecs.where("kind = 'title'").select(F.col("id").alias("item_id"), "vec"), 5, query_bytes=query_bytes)
    assert vectors.recall_at_k(cellstore.search(spark, root, queries, "title", 5, 6, query_bytes), exact, 5).first()["recall"] == 1.0


@pytest.mark.parametrize("k,nprobe", [(5, 1), (10, 2), (400, 1)])
def test_the_exact_mode_finds_all(spark, tmp_path, k, nprobe):
    """Few cells first, with clusters that the bounds can leave out, and with k beyond the items."""
    x = data(300)
    vecs, meta = frames(spark, x, range(300))
    root = str(tmp_path)
    cellstore.train_centres(vecs, 12, root)
    cellstore.append_vectors(root, vecs, meta, KINDS)
    queries = vecs.where("kind = 'skills' and id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    got = cellstore.search(spark, root, queries, "skills", k, nprobe, exact=True).collect()
    m = x["skills"]
    want = {(q, i) for q in range(0, 300, 20) for i in sorted(range(300), key=lambda i: (-round(float(m[q] @ m[i]), 9), i))[:k]}
    assert {(r["query_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert min(r["met"] for r in got) < 300 or k == 400


def test_sweep(spark, tmp_path):
    vecs, _ = frames(spark, data(200), range(200))
    vecs = vecs.where("kind = 'title'")
    queries = vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    rows = {(r["nlist"], r["nprobe"]): r for r in cellstore.sweep(str(tmp_path), vecs, queries, 5, [(4, 1), (4, 4), (12, 3)], "title").collect()}
    assert set(rows) == {(4, 1), (4, 4), (12, 3)} and rows[4, 4]["recall"] == rows[4, 4]["met_share"] == 1.0
    assert rows[4, 1]["met_share"] < 0.6 and all(r["ms"] > 0 and abs(r["speedup"] - r["exact_ms"] / r["ms"]) < 1e-9 for r in rows.values())
