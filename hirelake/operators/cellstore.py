"""A store of vectors by cell: appended batch by batch, checked against its metadata, searched by the cells nearest to a query.

root/centres holds the cells' centres of each kind of vector, trained once on a bounded sample; root/vectors the vectors, in folders by kind
and cell; root/metadata what they stand for, in folders by batch. The metadata is written last and tells which batches are whole."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.operators import vectors as v
from hirelake.sources.files import exists, write_layer

#: The most vectors of a kind that its centres are trained on, and the rounds of that.
MAX_TRAIN, ROUNDS = 50_000, 10


def cells_for(n: int) -> int:
    """How many cells n vectors get: one for every eight, 16 at least and 1 024 at most."""
    return min(1024, max(16, n // 8))


def _centres(x: np.ndarray, nlist: int) -> np.ndarray:
    """Unit centres of the rows of x by k-means on the sphere: seeded by spread rows, an empty cell keeps its centre."""
    rng = np.random.default_rng(42)
    c = x[rng.choice(len(x), nlist, replace=len(x) < nlist)].copy()
    for _ in range(ROUNDS):
        cell = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def train_centres(vectors: DataFrame, nlist: int, root: str, max_train: int = MAX_TRAIN) -> None:
    """Writes `nlist` centres (unit vectors) of each kind of vectors (id, kind, vec). They are trained in one task a kind on the max_train vectors with the smallest
    hashes, a bound that doesn't grow with the table."""
    w = Window.partitionBy("kind").orderBy("h", "id")
    rows = vectors.select("kind", "id", "vec", F.xxhash64("id").alias("h"))
    sizes = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # Most rows go before any window: those whose hash is beyond twice the share that is wanted.
    share = F.least(F.lit(1.0), F.lit(2.0 * max_train) / F.col("n"))
    near = rows.join(F.broadcast(sizes), "kind").where((F.col("n") <= max_train) | ((F.col("h") / 2.0**64 + 0.5) <= share))
    sample = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_train).select("kind", "r", "vec")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("r")["vec"].to_list())
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "cell": np.arange(nlist, dtype=np.int32), "centre": list(_centres(x, nlist))})

    sample.groupBy("kind").applyInPandas(train, "kind string, cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/centres")


def read_centres(spark: SparkSession, root: str) -> dict[str, np.ndarray]:
    """Each kind's centres, at most 1 024 rows of a kind: they are few by construction."""
    rows = spark.read.parquet(f"{root}/centres").orderBy("kind", "cell").collect()
    return {k: np.array([r["centre"] for r in rows if r["kind"] == k]) for k in {r["kind"] for r in rows}}


def with_cells(vectors: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """vectors (..., kind, vec) with the cell of the centre that has the largest inner product."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(kind: pd.Series, vec: pd.Series) -> pd.Series:
        out = np.zeros(len(vec), np.int32)
        for k in kind.unique():
            mine = np.flatnonzero((kind == k).to_numpy())
            out[mine] = (np.stack(vec.iloc[mine].to_list()) @ shared.value[k].T).argmax(1)
        return pd.Series(out)

    return vectors.withColumn("cell", nearest("kind", "vec"))


def checked(vectors: DataFrame, metadata: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """vectors (source, id, kind, vec), but where a key doesn't have one vector of every kind and one row of metadata, writing them is an error. It is found
    in the pass that writes: metadata goes along as a kind of its own."""
    marks = metadata.select("source", "id", F.lit("").alias("kind"), F.lit(None).cast("array<double>").alias("vec"))
    key = Window.partitionBy("source", "id")
    rows = vectors.select("source", "id", "kind", F.col("vec").cast("array<double>").alias("vec")).unionByName(marks)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(key)).withColumn("_kinds", F.array_sort(F.collect_set("kind").over(key)))
    wanted = F.array(*[F.lit(k) for k in sorted(["", *kinds])])
    bad = (F.col("_n") != len(kinds) + 1) | (F.col("_kinds") != wanted)
    told = F.concat(F.lit("vectors and metadata don't match: "), F.coalesce("source", F.lit("null")), F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" has "), F.array_join("_kinds", ","), F.lit(" in rows "), F.col("_n").cast("string"))
    kind = F.when(bad, F.raise_error(told).cast("string")).otherwise(F.col("kind"))
    return rows.select("source", "id", kind.alias("kind"), "vec").where("kind <> ''")


def append_vectors(root: str, vectors: DataFrame, metadata: DataFrame, kinds: Sequence[str]) -> list[str]:
    """Adds the batches of metadata (source, id, crawl_batch, ...) that the store doesn't have, with their vectors (source, id, kind, vec) by cell. Returns the
    batches' names. A run that stopped half way is made good by running again: vectors that are there by key stay, and a batch's metadata comes last."""
    spark = metadata.sparkSession
    names = metadata.select("crawl_batch").where("trim(crawl_batch) <> ''").distinct()
    if exists(spark, f"{root}/metadata"):
        names = names.join(spark.read.parquet(f"{root}/metadata").select(F.col("crawl_batch").cast("string").alias("crawl_batch")).distinct(), "crawl_batch", "left_anti")
    new = sorted(r[0] for r in names.collect())
    if not new:
        return []
    rows = metadata.where(F.col("crawl_batch").isin(new))
    mine = checked(vectors.join(rows.select("source", "id"), ["source", "id"], "left_semi"), rows, kinds)
    mine = with_cells(mine, read_centres(spark, root))
    if exists(spark, f"{root}/vectors"):
        mine = mine.join(read_vectors(spark, root).select("source", "id", "kind"), ["source", "id", "kind"], "left_anti")
    mine.hint("rebalance", "kind", "cell").write.mode("append").partitionBy("kind", "cell").parquet(f"{root}/vectors")
    write_layer(rows, root, "metadata")
    return new


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("source string, id long, vec array<double>, kind string, cell int").parquet(f"{root}/vectors")


def store_counts(spark: SparkSession, root: str) -> DataFrame:
    """(side, n) of the metadata and of each kind of vectors."""
    sides = read_vectors(spark, root).groupBy(F.col("kind").alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return sides.unionByName(spark.read.parquet(f"{root}/metadata").agg(F.count(F.lit(1)).alias("n")).select(F.lit("metadata").alias("side"), "n"))


def probes(spark: SparkSession, root: str, queries: DataFrame, kind: str, nprobe: int) -> DataFrame:
    """queries (query_id, vec) with the cells, nprobe at most, whose centres are nearest."""
    shared = spark.sparkContext.broadcast(read_centres(spark, root)[kind])

    @F.pandas_udf("array<int>")
    def near(vec: pd.Series) -> pd.Series:
        scores = np.stack(vec.to_list()) @ shared.value.T
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :nprobe].astype(np.int32)))

    return queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).withColumn("cells", near("vec"))


def _met(items: DataFrame, ids: np.ndarray, matrix: np.ndarray, by_cell: dict[int, np.ndarray], k: int) -> DataFrame:
    """Every item with the queries that by_cell names for its cell: the k best of each query in each batch, and how many it met there. Only folders of these cells are
    read; an item's own cell tells its queries, wherever its row is read, so a large cell is as many tasks as it has splits."""
    shared = items.sparkSession.sparkContext.broadcast((ids, matrix, by_cell))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, by_cell = shared.value
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                who = by_cell[int(cell)]
                best = v.Best(ids[who], matrix[who], k)
                best.add(part["item_id"].to_numpy(), v._matrix(part["vec"]))
                width = best.items.shape[1]
                yield best.rows().assign(met=np.full(len(who) * width, len(part)), first=np.tile(np.arange(width) == 0, len(who)))

    probed = items.where(F.col("cell").isin(sorted(by_cell))).select(F.col("id").alias("item_id"), "vec", "cell")
    return probed.mapInPandas(meet, f"{v.FOUND}, met long, first boolean")


def _radii(items: DataFrame, centres: np.ndarray) -> np.ndarray:
    """How far the items of each cell reach from its centre, rounded up."""
    shared = items.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("double")
    def reach(cell: pd.Series, vec: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.stack(vec.to_list()) - shared.value[cell.to_numpy()], axis=1))

    out = np.full(len(centres), -1.0)
    for r in items.groupBy("cell").agg(F.max(reach("cell", "vec")).alias("r")).collect():
        out[r["cell"]] = r["r"] * (1 + 1e-12) + 1e-12
    return out


def search(spark: SparkSession, root: str, queries: DataFrame, kind: str, k: int, nprobe: int, query_bytes: int = v.QUERY_BYTES, exact: bool = False) -> DataFrame:
    """(query_id, item_id, score, met): the k best items of the nprobe cells nearest to each query, and how many items the query met in all. With `exact`, cells
    beyond them follow where a bound (centre's score + query's norm * cell's radius) says that they can still hold a result. Query vectors of up to query_bytes
    are broadcast. More queries than that are met in blocks of queries and items of one cell, or, for exact results, by `top_k`."""
    items = read_vectors(spark, root).where(F.col("kind") == kind)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if size["n"] * ((size["dim"] or 0) + nprobe) * 8 > query_bytes:
        if exact:
            n = items.count()
            return v.top_k(queries, items.select(F.col("id").alias("item_id"), "vec"), k, query_bytes).withColumn("met", F.lit(n).cast("long"))
        return _search_in_blocks(probes(spark, root, queries, kind, nprobe), items, k)
    rows = probes(spark, root, queries, kind, nprobe).collect()
    ids, matrix = np.array([r[0] for r in rows], np.int64), v._matrix([r[1] for r in rows]) if rows else np.empty((0, 0))
    probed: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for c in r[2]:
            probed.setdefault(int(c), []).append(i)
    first = _met(items, ids, matrix, {c: np.array(w) for c, w in probed.items()}, k)
    if not exact or not rows:
        return _merged(first, k)
    # The k-th score of each query, from at most n * k rows.
    near = _merged(first, k)
    kth = {r["query_id"]: r["s"] for r in near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect()}
    centres = read_centres(spark, root)[kind]
    radii = _radii(items, centres)
    bound = matrix @ centres.T + np.linalg.norm(matrix, axis=1)[:, None] * radii
    # Scores are rounded to 9 places, so a bound counts as reaching a score that is 1e-8 higher.
    open_ = (bound + 1e-8 >= np.array([kth.get(int(i), -np.inf) for i in ids])[:, None]) & (radii >= 0)
    for c, who in probed.items():
        open_[who, c] = False
    beyond = {int(c): np.flatnonzero(open_[:, c]) for c in np.flatnonzero(open_.any(axis=0))}
    return _merged(first.unionByName(_met(items, ids, matrix, beyond, k)), k) if beyond else near


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id")
    found = found.withColumn("met", F.sum(F.when(F.col("first"), F.col("met")).otherwise(0)).over(w))
    return found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k).select("query_id", "item_id", "score", "met")


def _search_in_blocks(asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Blocks of BLOCK_ROWS of a cell's queries and of its items, brought together by a table of pairs of blocks, each side by both of its keys."""
    each = asked.select("query_id", "vec", F.explode("cells").alias("cell"))
    q = v.in_blocks(each.select("cell", F.col("query_id").alias("key"), "vec"), "cell").select(F.col("cell"), F.col("block").alias("q"), F.col("keys").alias("qs"), F.col("vecs").alias("qv"))
    x = v.in_blocks(items.select("cell", F.col("id").alias("key"), "vec"), "cell").select(F.col("cell"), F.col("block").alias("x"), F.col("keys").alias("xs"), F.col("vecs").alias("xv"))
    return _merged(v.met_in_blocks(q, x, "cell", k), k)


def sweep(root: str, vectors: DataFrame, queries: DataFrame, k: int, configs: Sequence[tuple[int, int]], kind: str = "full") -> DataFrame:
    """(name, nlist, nprobe, recall, met_share, ms, exact_ms, speedup): for each (nlist, nprobe) the search over a store of vectors (source, id, kind, vec) with that many cells, measured against the exact search: its recall,
    the share of all pairs that it met, milliseconds a query, and how much faster it is."""
    spark, n, asked = vectors.sparkSession, vectors.count(), queries.count()

    def timed(df: DataFrame) -> tuple[DataFrame, float]:
        began = time.perf_counter()
        rows = df.collect()
        return spark.createDataFrame(rows, df.schema), (time.perf_counter() - began) * 1000 / max(asked, 1)

    # The results are k rows a query.
    truth, exact_ms = timed(v.top_k(queries, vectors.select(F.col("id").alias("item_id"), "vec"), k))
    out, meta = [], vectors.select("source", "id", F.lit("all").alias("crawl_batch"))
    for nlist in sorted({c[0] for c in configs}):
        here = f"{root}/cells_{nlist}"
        train_centres(vectors, nlist, here)
        append_vectors(here, vectors, meta, [kind])
        for nprobe in sorted(c[1] for c in configs if c[0] == nlist):
            found, ms = timed(search(spark, here, queries, kind, k, nprobe))
            recall = v.recall_at_k(found, truth, k).first()["recall"]
            met = found.groupBy("query_id").agg(F.max("met").alias("met")).agg(F.sum("met")).first()[0] or 0
            out.append((f"cells {nlist}, probes {nprobe}", nlist, nprobe, recall, met / max(n * asked, 1), ms, exact_ms, exact_ms / ms))
    return spark.createDataFrame(out, "name string, nlist int, nprobe int, recall double, met_share double, ms double, exact_ms double, speedup double")
