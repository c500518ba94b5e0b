"""The job view: the given tables read as postings, with skills, companies and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the historical source ends; the columns that order an order's lines.
CUT_OFF = "1998-01-01"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, first, names): the part of each order's first line, and the names of all its lines in order. Lines that agree in number and part
    have equal parts, so the columns of LINE_ORDER after these two can't change either, and aren't moved."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER[:2]).join(part, "l_partkey")
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER[:2], "p_name", "p_brand", "p_type"))).alias("lines"))
    return lines.select("o_orderkey", F.try_element_at("lines", F.lit(1)).alias("first"), F.transform("lines", lambda x: x["p_name"]).alias("names"))


def job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # Lines, which are the most bytes, come last: they are moved to their order and no further.
    people = people.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").join(order_lines(spark, sf_dir), "o_orderkey", "left")
    first = F.col("first")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("job_link"),
        F.coalesce(F.concat_ws(" ", first["p_type"], first["p_name"]), F.lit("")).alias("title"),
        F.coalesce(F.array_distinct("names"), F.array().cast("array<string>")).alias("skills"),
        F.coalesce("c_name", F.lit("")).alias("company"),
        F.coalesce(F.concat("n_name", F.lit(", "), "r_name"), F.lit("")).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM").alias("batch"),
        F.when(F.col("o_orderdate") < F.lit(CUT_OFF).cast("timestamp"), "historical").otherwise("incremental").alias("source"),
        F.coalesce(F.concat_ws(" ", first["p_brand"], first["p_type"]), F.lit("")).alias("role"),
    )


#: The same view in SQL: a WITH list that ends in `job`.
JOB_SQL = f"""ol AS (
  SELECT l_orderkey AS o_orderkey, list(p_name ORDER BY {", ".join(LINE_ORDER)}, p_name, p_brand, p_type) AS names,
         first(p_type ORDER BY {", ".join(LINE_ORDER)}, p_name, p_brand, p_type) AS p_type, first(p_name ORDER BY {", ".join(LINE_ORDER)}, p_name, p_brand, p_type) AS p_name,
         first(p_brand ORDER BY {", ".join(LINE_ORDER)}, p_name, p_brand, p_type) AS p_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
job AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS job_link, concat_ws(' ', p_type, p_name) AS title,
         coalesce(list_filter(names, lambda x, i: list_position(names, x) = i), []) AS skills, coalesce(c_name, '') AS company,
         coalesce(n_name || ', ' || r_name, '') AS location, strftime(o_orderdate, '%Y-%m') AS batch,
         CASE WHEN o_orderdate < TIMESTAMP '{CUT_OFF}' THEN 'historical' ELSE 'incremental' END AS source, concat_ws(' ', p_brand, p_type) AS role
  FROM orders o LEFT JOIN ol USING (o_orderkey) LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
