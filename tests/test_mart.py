"""The mart and its streams: runs that stop between steps, replays, keys, pickup of batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hirelake.operators import mart, silver
from hirelake.sources import files
from hirelake.streaming import ingest

POSTS = [
    ("crawler", "Senior Data Engineer", "Acme", "HCM", "l1", ["sql", "Power Bi"], "b1"),
    ("crawler", "Senior Data Engineer", "Acme", "HCM", "l1", ["sql"], "b1"),
    ("crawler", "Recruiter (Contract)", "Bmce", "Hanoi - Vietnam", "l2", ["Excel", "  "], "b1"),
    ("crawler", "Gardener", None, None, "l3", None, "b1"),
    ("crawler", "Senior Data Engineer", "Acme", "Da Nang", "l1", ["Spark"], "b2"),
    ("crawler", "SEO writer", "Cmce", "Berlin, Germany", "l4", ["seo"], "b2"),
    ("crawler", "Tutor", "Dmce", "Remote", "l5", ["teaching"], "007"),
]


def land(spark, folder, batches):
    rows = spark.createDataFrame([p for p in POSTS if p[-1] in batches], ingest.POSTING)
    rows.repartition(1).write.mode("append").partitionBy("crawl_batch").parquet(folder)


def told(spark, root):
    return {n: sorted(map(tuple, mart.read_table(spark, f"{root}/mart", n).drop("processed_at").collect())) for n in mart.MART}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    land(spark, f"{root}/landing", {"b1", "b2", "007"})
    ingest.stream_mart(spark, f"{root}/landing", root, F.lit("2024-01-02").cast("timestamp"))
    return told(spark, root)


def test_the_whole_mart(whole):
    jobs = {r[13]: r for r in whole["jobs"]}
    assert set(jobs) == {"l1", "l2", "l4", "l5"} and len(whole["jobs"]) == 4
    one = jobs["l2"]
    assert one[1:13] == ("crawler", "Bmce", "Recruiter", "Human Resources", "Professional Services", "Not specified", "Hanoi", "Vietnam", "Hanoi, Vietnam", 1, "b1", "l2")
    assert jobs["l1"][4] == "Data & Analytics" and jobs["l1"][6] == "Senior" and jobs["l5"][11] == "007"
    # Within b1 one of two rows with one id stays, and what b1 brings to postings wins over b2; skills are keyed by themselves.
    assert sorted(r[1] for r in whole["job_skills"]) == ["Microsoft Excel", "SEO", "SQL", "Spark", "Teaching"]
    assert [r[0] for r in whole["batches"]] == ["007", "b1", "b2"]


@pytest.mark.parametrize("stop", ["silver", "gold", "jobs", "job_skills", "batches"])
def test_a_run_that_stops_after_a_step_goes_on(spark, tmp_path, whole, stop):
    """On the same state folder, without a row more or less; then a run with nothing new, then all files once more."""
    root = str(tmp_path)
    land(spark, f"{root}/landing", {"b1", "b2", "007"})
    at = F.lit("2024-01-02").cast("timestamp")

    def fail(step):
        if step == stop:
            raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        ingest.stream_mart(spark, f"{root}/landing", root, at, after_step=fail)
    assert told(spark, root) != whole or stop == "batches"
    for _ in range(2):
        ingest.stream_mart(spark, f"{root}/landing", root, at)
        assert told(spark, root) == whole
    ingest.run_available(ingest.stream_files(spark, f"{root}/landing", ingest.POSTING), f"{root}/other-state", ingest.silver_gold_mart(root, at))
    assert told(spark, root) == whole


def test_batches_that_land_later(spark, tmp_path):
    root, at = str(tmp_path), F.lit("2024-01-02").cast("timestamp")
    land(spark, f"{root}/landing", {"b1"})
    ingest.stream_mart(spark, f"{root}/landing", root, at)
    first = told(spark, root)
    land(spark, f"{root}/landing", {"b2", "007"})
    ingest.stream_mart(spark, f"{root}/landing", root, at, files_a_time=1)
    then = told(spark, root)
    assert [r[0] for r in first["batches"]] == ["b1"] and [r[0] for r in then["batches"]] == ["007", "b1", "b2"]
    # The posting that b1 brought stays as it was.
    assert set(first["jobs"]) <= set(then["jobs"]) and sum(r[13] == "l1" for r in then["jobs"]) == 1
    assert {r["table_name"]: r["n"] for r in mart.counts(spark, f"{root}/mart").collect()} == {"jobs": 4, "job_skills": len(then["job_skills"]), "batches": 3}


def test_processed_batches_are_skipped(spark, tmp_path):
    gold = silver.gold(silver.incremental_silver(spark.createDataFrame(POSTS, ingest.POSTING)))
    assert mart.append_batches(gold, str(tmp_path)) == ["007", "b1", "b2"]
    assert mart.append_batches(gold, str(tmp_path)) == [] and mart.append_batches(gold.where("false"), str(tmp_path)) == []


def test_existing_rows_win_with_and_without_broadcast(spark):
    new = spark.createDataFrame([(i, "new") for i in range(50)], "k long, v string")
    old = spark.createDataFrame([(i, "old") for i in range(0, 50, 2)], "k long, v string")
    for most in (5, 1000):
        assert sorted(r[0] for r in mart.absent(new, old, ["k"], most).collect()) == list(range(1, 50, 2))


@pytest.mark.parametrize("rows", [[("a", "x"), ("a", "y")], [(None, "x")], [(" ", "x")]])
def test_bad_keys_are_errors(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "source_job_id string, source string")
    with pytest.raises(Exception, match="blank or not unique"):
        mart.with_checked_keys(df, ["source_job_id"]).collect()
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in mart.JOBS.fields])
    with pytest.raises(Exception, match="blank or not unique"):
        mart.append(spark, str(tmp_path / "m"), "jobs", full)
    good = spark.createDataFrame([("a", "x"), ("b", "x")], df.schema)
    assert mart.with_checked_keys(good, ["source_job_id"]).columns == good.columns and mart.with_checked_keys(good, ["source_job_id"]).count() == 2


def test_pickup_of_batches_over_three_runs(spark, tmp_path):
    """One batch a run: the newest landed file first, stages by name; files of other kinds don't count."""
    for i, n in enumerate(["w2.json", "w1.json", "w3.json", "notes.txt"]):
        (tmp_path / n).write_text("[]")
        os.utime(tmp_path / n, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    found, done = files.landed(spark, str(tmp_path)), []
    for want in ("w3", "w1", "w2", None):
        row = files.newest_pending(found, spark.createDataFrame([(x,) for x in done], "batch string")).first()
        assert (row["batch"] if row else None) == want
        done.append(want)
    stage, out = spark.createDataFrame([("b2",), ("b1",), ("b2",), (None,), (" ",), ("b3",)], "crawl_batch string"), []
    for want in ("b1", "b2", "b3", None):
        row = files.next_batch(stage, spark.createDataFrame([(x,) for x in out], "crawl_batch string")).first()
        assert (row["crawl_batch"] if row else None) == want
        out.append(want)


@pytest.mark.parametrize("text", ['{"title": "a", "link": "l"}', '"a"', "[1, 2", '[{"title": "a"}'])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "w1.json").write_text(text)
    with pytest.raises(Exception):
        files.read_json_batch(spark, str(tmp_path)).select("title").collect()


def test_arrays_of_postings(spark, tmp_path):
    (tmp_path / "w1.json").write_text("\n " + json.dumps([{"title": "a", "link": "l", "skills": ["x"], "other": 1}, {"title": None}]))
    (tmp_path / "w2.json").write_text("[]")
    (tmp_path / "w3.json").write_text("")
    got = sorted(map(tuple, files.read_json_batch(spark, str(tmp_path)).select("crawl_batch", "title", "skills").collect()), key=str)
    assert got == [("w1", "a", ["x"]), ("w1", None, None)]


def test_layers_keep_names_of_digits(spark, tmp_path):
    df = spark.createDataFrame([(1, "007"), (2, "12")], "k int, crawl_batch string")
    files.write_layer(df, str(tmp_path), "silver")
    assert sorted(r["crawl_batch"] for r in files.read_layer(spark, str(tmp_path), "silver").collect()) == ["007", "12"]
    with pytest.raises(ValueError):
        files.shared_folder(FakeCluster())


class FakeCluster:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_postings_are_moved_before_they_are_rows_of_skills(spark, tmp_path):
    """One move of a Gold batch, below the rows of skills and their dedup; the first batch of a table is written in the pass that makes it."""
    from hirelake.operators import mart

    gold = spark.createDataFrame([("1", ["sql", " sql", "c", ""], "b"), ("1", ["sql"], "b"), ("", ["x"], "b"), ("2", ["sql"], "b")], "source_job_id string, skills_canonical array<string>, crawl_batch string")
    rows = mart.job_skills_table(gold)
    assert sorted((r["source_job_id"], r["skill"]) for r in rows.collect()) == [("1", "c"), ("1", "sql"), ("2", "sql")]
    plan = mart.with_checked_keys(rows, ["source_job_id", "skill"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    for _ in range(2):
        mart.append(spark, str(tmp_path), "job_skills", rows)
        assert mart.read_table(spark, str(tmp_path), "job_skills").count() == 3
