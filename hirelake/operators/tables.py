"""Table-to-table operators: conforming, keep-first dedup, funnel, profiles, mart and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_existing(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def ensure_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[df[n] if n in df.columns else F.lit("").alias(n) for n in names])


def replace_columns(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """df with derived columns at its end, in their order, in place of those of an earlier run; a run of it again changes nothing."""
    kept = [df[c] for c in df.columns if c not in derived]
    return df.select(*kept, *[c.alias(n) for n, c in derived.items()])


def renamed(df: DataFrame, names: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """The columns of `order`, some under a new name; where both names are there, the old name's column is taken."""
    old = {new: n for n, new in names.items() if n in df.columns}
    require_columns(df, [old.get(n, n) for n in order])
    return df.select(*[df[old.get(n, n)].alias(n) for n in order])


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in a stated order, for previews and leading samples."""
    return df.orderBy(*order).limit(n)


def conform(df: DataFrame, columns: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Standard string columns, each from the first of its candidates that exists."""
    require_columns(df, required)
    return df.select(*[F.coalesce(first_existing(df, names).cast("string"), F.lit("")).alias(n) for n, names in columns.items()])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose keys existing doesn't have; existing rows win."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def unprocessed(batches: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return batches.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def filter_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, rows_before, rows_after, dropped) of filters applied one after the other, in one pass."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, cond) in enumerate(steps):
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n{i + 1}"))
    rows = [F.struct(F.lit(name).alias("step"), F.col(f"n{i}").alias("rows_before"), F.col(f"n{i + 1}").alias("rows_after"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("dropped")) for i, (name, _) in enumerate(steps)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str, n: int, blank: str = "Unknown") -> DataFrame:
    c = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.groupBy(F.when(c == "", blank).otherwise(c).alias("value")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "value").limit(n)


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(c).alias("most"))


def missing_rates(df: DataFrame, present: Mapping[str, Column]) -> DataFrame:
    n = F.count(F.lit(1))
    cols = []
    for name, cond in present.items():
        missing = F.count_if(~F.coalesce(cond, F.lit(False)))
        cols += [missing.alias(f"no_{name}"), F.round(100 * missing / n, 2).alias(f"no_{name}_pct")]
    return df.agg(n.alias("n"), *cols)


def aligned(sides: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(side, n, missing): rows of each side, and keys of the first that it lacks."""
    first = next(iter(sides.values())).select(key).distinct()
    out = None
    for name, df in sides.items():
        lacks = first.join(df.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        row = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(lacks).select(F.lit(name).alias("side"), "n", "missing")
        out = row if out is None else out.unionByName(row)
    return out


def mart_job_skills(jobs: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per job and skill, with the job's attributes; blank keys go."""
    rows = jobs.select("source_job_id", F.explode("skills").alias("skill"), *attributes).withColumn("skill", F.trim("skill"))
    return keep_first(rows.where((F.col("source_job_id") != "") & (F.col("skill") != "")), ["source_job_id", "skill"], [F.col(a) for a in attributes])


def sample_seeded(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows that any engine picks alike."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def check_aligned(sides: Mapping[str, DataFrame], key: str) -> None:
    """An error unless every side has as many rows as the first and all of its keys."""
    rows = aligned(sides, key).collect()
    if bad := [r["side"] for r in rows if r["n"] != rows[0]["n"] or r["missing"]]:
        raise ValueError(f"sides that don't match: {bad}")


def strip_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names})


def coerce_int(c: Column) -> Column:
    """What isn't a number is 0."""
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("int")


def validity_flags(title: Column, skills: Column, location: Column) -> dict[str, Column]:
    has = {"has_title": F.length(F.trim(title)) > 0, "has_skills": F.coalesce(F.size(skills), F.lit(0)) > 0, "has_location": F.length(F.trim(location)) > 0}
    return has | {"is_valid_for_gold": has["has_title"] & has["has_skills"]}


def mart_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n) of the mart's tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def mark_batches(ledger: DataFrame, batches: DataFrame, key: str, at: Column) -> DataFrame:
    """The ledger (key, processed_at) with the batches that it doesn't have yet; conflicts are ignored."""
    new = insert_if_absent(batches.select(key).where(F.col(key).isNotNull()).distinct(), ledger, [key])
    return ledger.select(key, "processed_at").unionByName(new.select(key, at.alias("processed_at")))


def choose_config(results: DataFrame, least_recall: float) -> DataFrame:
    """One row of results (name, recall, ms): the fastest with enough recall, else the best recall, the fastest of these."""
    enough = F.col("recall") >= least_recall
    return results.orderBy(enough.desc(), F.when(~enough, -F.col("recall")).otherwise(0.0), "ms", "name").limit(1)
