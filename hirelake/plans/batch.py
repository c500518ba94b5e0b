"""Queries of the incremental source's cleaning, the Silver and Gold views, the mart's ledger and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import batch, rules, text
from hirelake.operators import classify, tables
from hirelake.plans.jobs import job_view, read
from hirelake.plans.queries import _sql_case, _sql_list, _sql_map, _sql_title, query


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _marked():
    return F.concat(F.lit("Urgent hiring \u2013 "), "title", F.lit(" (Outsourcing)/HCM office |  "), "source", F.lit(" (Contract) \u2014 "))


_title = _collapsed("replace(translate('Urgent hiring \u2013 ' || title || ' (Outsourcing)/HCM office |  ' || source || ' (Contract) \u2014 ', '\u2013\u2014|', '-- '), '/', ' / ')")
for _p in rules.BATCH_TITLE_NOISE:
    _title = f"regexp_replace({_title}, '(?i){_p}', '', 'g')"
_title = f"trim({_collapsed(_title)}, '{rules.TITLE_ENDS}')"


@query(f"WITH job SELECT job_link, {_title} AS title_clean, {_collapsed('company')} AS company_clean, {_collapsed('location')} AS location_clean FROM job")
def clean_title_cs(spark, d):
    jobs = job_view(spark, d)
    return jobs.select("job_link", batch.clean_job_title(_marked()).alias("title_clean"), batch.clean_place(F.col("company")).alias("company_clean"), batch.clean_place(F.col("location")).alias("location_clean"))


# Spellings that join each posting's skills, so that the tables meet them.
SPELLED = [" power bi", "Nodejs", "none", "Aws  Cloud", "sql", "SQL", "Excel"]
NAMED = ["5+ years of it", "c", "powerbi", "Node js", "CI-CD Pipelines", "rAg", "big data", "GAAP"]
_clean = f"list_filter(list_transform(list_transform(list_concat(skills, {_sql_list(SPELLED)}), lambda s: CASE WHEN lower(trim(s)) IN ('nan', 'none', 'null') THEN '' ELSE {_collapsed('s')} END), lambda s: coalesce({_sql_map(rules.SKILL_SPELLINGS)}[s], s)), lambda s: s <> '')"
_noise = " OR ".join(f"regexp_matches(lower(s), '{p}')" for p in rules.SKILL_NOISE)
_canonical = f"list_transform(list_filter(list_concat(skills, {_sql_list(NAMED)}), lambda s: length(s) > 1 AND NOT ({_noise})), lambda s: coalesce({_sql_map(rules.SKILL_ALIASES_BATCH)}[lower(s)], CASE WHEN regexp_matches(s, '[#+./-]') THEN s ELSE {_sql_title('s')} END))"
_once = "list_filter(l, lambda x, i: list_position(l, x) = i)"


@query(f"WITH job, c AS (SELECT job_link, {_clean} AS l FROM job) SELECT job_link, {_once} AS skills_clean FROM c")
def clean_skills_cs(spark, d):
    more = F.concat("skills", F.array(*map(F.lit, SPELLED)))
    return job_view(spark, d).select("job_link", batch.clean_skills_list(more).alias("skills_clean"))


@query(f"WITH job, c AS (SELECT job_link, {_canonical} AS l FROM job) SELECT job_link, {_once} AS skills_canonical FROM c")
def canonical_skills_cs(spark, d):
    more = F.concat("skills", F.array(*map(F.lit, NAMED)))
    return job_view(spark, d).select("job_link", batch.canonicalize_skills(more).alias("skills_canonical"))


# What postings are called, dealt by the order's number in front of the view's own titles.
CALLED = ["Data analyst", "Node.js developer", "Chief accountant", "Key account lead", "SEO writer", "HR recruiter", "Registered nurse", "Tutor", "Warehouse clerk", "Customer success agent", "CAD drafter", "IP associate", "Hotel cashier", "SMT operator", "Gardener"]
_called = f"{_sql_list(CALLED)}[1 + CAST(job_link AS BIGINT) % {len(CALLED)}]"
_whole = f"lower(concat_ws(' ', {_called}, title, array_to_string(skills, ' '), company))"


def _with_call():
    call = F.element_at(text.literal_list(CALLED), (F.col("job_link").cast("long") % len(CALLED) + 1).cast("int"))
    return F.concat_ws(" ", call, "title")


@query(f"WITH job, w AS (SELECT job_link, {_whole} AS w FROM job), g AS (SELECT job_link, {_sql_case('w', rules.BATCH_GROUPS, rules.UNKNOWN)} AS g FROM w) SELECT job_link, g AS occupation_group, coalesce({_sql_map(rules.FAMILY_BATCH)}[g], '{rules.UNKNOWN}') AS family FROM g")
def classify_batch(spark, d):
    jobs = job_view(spark, d)
    group = batch.occupation_group(batch.classification_text(_with_call(), F.col("skills"), F.col("company")))
    return jobs.select("job_link", group.alias("occupation_group")).withColumn("family", classify.occupation_family(F.col("occupation_group"), rules.FAMILY_BATCH))


@query("""WITH job, v AS (SELECT count(*) FILTER (trim(title) <> '' AND len(skills) > 0) AS n_valid FROM job), s AS (SELECT count(DISTINCT skill) AS n_skills FROM (SELECT unnest(skills) AS skill FROM job)) SELECT n_valid, n_skills FROM v, s""")
def gold_counts(spark, d):
    jobs = job_view(spark, d)
    valid = tables.validity_flags(F.col("title"), F.col("skills"), F.col("location"))["is_valid_for_gold"]
    # One row per skill set or skill on either side of the aggregate, no join of the two counts.
    rows = jobs.select(F.when(valid, 1).otherwise(0).alias("valid"), F.lit(None).cast("string").alias("skill")).unionByName(jobs.select(F.lit(0).alias("valid"), F.explode("skills").alias("skill")))
    return rows.agg(F.sum("valid").cast("long").alias("n_valid"), F.count_distinct("skill").alias("n_skills"))


def _mart(spark, d):
    jobs = job_view(spark, d).withColumnRenamed("job_link", "source_job_id")
    return {"jobs": jobs.where("source_job_id <> ''"), "job_skills": tables.mart_job_skills(jobs, ["company"]), "batches": jobs.select("batch").where("batch is not null").distinct()}


@query("""WITH job SELECT 'jobs' AS table_name, count(*) AS n FROM job WHERE job_link <> '' UNION ALL SELECT 'job_skills', count(*) FROM (SELECT DISTINCT job_link, trim(skill) FROM (SELECT job_link, unnest(skills) AS skill FROM job) WHERE trim(skill) <> '') UNION ALL SELECT 'batches', count(DISTINCT batch) FROM job""")
def mart_counts(spark, d):
    return tables.mart_counts(_mart(spark, d))


@query("""WITH job, o AS (SELECT DISTINCT batch FROM job WHERE source = 'historical') SELECT batch, TIMESTAMP '2024-01-01' AS processed_at FROM o UNION ALL SELECT DISTINCT batch, TIMESTAMP '2024-01-02' FROM job WHERE batch NOT IN (SELECT batch FROM o)""")
def batch_ledger(spark, d):
    jobs = job_view(spark, d)
    done = jobs.where("source = 'historical' and batch is not null").select("batch").distinct().withColumn("processed_at", F.lit("2024-01-01").cast("timestamp"))
    return tables.mark_batches(done, jobs, "batch", F.lit("2024-01-02").cast("timestamp"))


@query("""WITH job, s AS (SELECT DISTINCT job_link AS source_job_id, trim(skill) AS skill, source, batch FROM (SELECT job_link, source, batch, unnest(skills) AS skill FROM job)) SELECT source_job_id, skill, source FROM s WHERE skill <> '' AND (source = 'historical' OR batch >= '1998-06')""")
def mart_append_skills(spark, d):
    """Job skills of a new batch, inserted where (source_job_id, skill) isn't there yet."""
    rows = tables.mart_job_skills(job_view(spark, d).withColumnRenamed("job_link", "source_job_id"), ["source", "batch"])
    old, new = rows.where("source = 'historical'"), rows.where("source = 'historical' or batch >= '1998-06'")
    return old.unionByName(tables.insert_if_absent(new, old, ["source_job_id", "skill"])).select("source_job_id", "skill", "source")


_profile = f"list_transform(list_filter(list_transform(string_split('sql, Power  BI,' || lower(c_mktsegment) || ',SQL, ,nodejs', ','), lambda s: {_collapsed('s')}), lambda s: s <> ''), lambda s: coalesce({_sql_map(rules.PROFILE_ALIASES)}[lower(s)], s))"


@query(f"WITH c AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE {_collapsed('c_name')} END AS job_title, {_profile} AS l FROM customer) SELECT user_id, job_title, {_once} AS current_skills FROM c")
def normalize_profile(spark, d):
    people = read(spark, d, "customer")
    raw = F.split(F.concat(F.lit("sql, Power  BI,"), F.lower("c_mktsegment"), F.lit(",SQL, ,nodejs")), ",")
    title = F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    return people.select(F.col("c_custkey").alias("user_id"), batch.profile_field(title).alias("job_title"), batch.profile_skills(raw).alias("current_skills"))
