"""Queries of the occupation rules and of the whole Silver and Gold builds, with what postings are called dealt over the job view."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from hirelake.functions import batch, rules, taxonomy, text
from hirelake.operators import classify, mart, silver
from hirelake.plans.jobs import job_view
from hirelake.plans.queries import _place, _spelled_location, _sql_case, _sql_list, _sql_map, _sql_title, query
from hirelake.sources.files import shared_folder
from hirelake.streaming.ingest import stream_mart as stream_mart_at


def _words(patterns) -> list[str]:
    """What each pattern is looking for, as plain text."""
    return [re.sub(r"\\b|\\", "", p) for rules_ in patterns.values() for p in (r if isinstance(r, str) else r[0] for r in rules_)]


def _once_each(words) -> list[str]:
    return list(dict.fromkeys(words))


#: What postings are called and ask for, by the order's number: every title pattern, keyword and generic title of both sources has postings.
CALLED = _once_each([*[w for ws in taxonomy.TITLE_KEYWORDS.values() for w in ws], *_words({"AI": taxonomy.GROUP_PATTERNS["AI / Machine Learning"]}), *_words(taxonomy.TITLE_PATTERNS), *rules.GENERIC_TITLES, ""])
ASKED = _once_each([*[w for ws in taxonomy.SKILL_KEYWORDS.values() for w in ws], *[w for ws in taxonomy.GROUP_SKILLS.values() for w in ws], *taxonomy.SKILL_ALIASES, "5+ years of it", "c"])
CALLED_BATCH = _once_each(["Data analyst", "Node.js developer", "Chief accountant", "Key account lead", "Tutor", "Gardener", "Customer success agent", *_words(taxonomy.TITLE_PATTERNS_BATCH)])
ASKED_BATCH = [" power bi", "Nodejs", "none", "Aws  Cloud", "sql", "SQL", "Excel", "5+ years of it", "c", "powerbi", "Node js", "CI-CD Pipelines", "rAg", "big data", "GAAP"]


def _pick(words: list[str], n):
    return F.element_at(text.literal_list(words), (n % len(words) + 1).cast("int"))


def _sql_pick(words: list[str], n: str) -> str:
    return f"{_sql_list(words)}[1 + ({n}) % {len(words)}]"


def historical_posts(spark, d):
    """The job view as raw postings of the historical source. A generic or blank title stands alone."""
    n = F.col("job_link").cast("long")
    call = _pick(CALLED, n)
    title = F.when(call.isin([*rules.GENERIC_TITLES, ""]), call).otherwise(F.concat_ws(" ", call, "title"))
    asked = F.concat(F.array(_pick(ASKED, n * 3), _pick(ASKED, n * 5 + 1), _pick(ASKED, n * 7 + 2)), "skills")
    return job_view(spark, d).select("source", title.alias("title"), "company", _spelled_location().alias("location"), F.col("job_link").alias("link"), F.array_join(asked, ", ").alias("skills"))


def incremental_posts(spark, d):
    """The job view as raw postings of the incremental source, with its recruiting words."""
    n = F.col("job_link").cast("long")
    title = F.concat(F.lit("Urgent hiring – "), _pick(CALLED_BATCH, n), F.lit(" "), "title", F.lit(" (Outsourcing)/HCM office |  "), "source", F.lit(" (Contract) — "))
    asked = F.concat("skills", F.array(_pick(ASKED_BATCH, n), _pick(ASKED_BATCH, n * 7 + 3)))
    return job_view(spark, d).select("source", title.alias("title"), "company", _spelled_location().alias("location"), F.col("job_link").alias("link"), asked.alias("skills"), F.col("batch").alias("crawl_batch"))


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_unique = "list_filter(l, lambda x, i: list_position(l, x) = i)"
_alone = f"{_sql_list([*rules.GENERIC_TITLES, ''])}"
_call = _sql_pick(CALLED, "CAST(job_link AS BIGINT)")
_asked = f"list_concat([{_sql_pick(ASKED, 'CAST(job_link AS BIGINT) * 3')}, {_sql_pick(ASKED, 'CAST(job_link AS BIGINT) * 5 + 1')}, {_sql_pick(ASKED, 'CAST(job_link AS BIGINT) * 7 + 2')}], skills)"
_noise = "trim(regexp_replace(lower(raw_title), '\\s+', ' ', 'g'))"
for _p in rules.TITLE_NOISE:
    _noise = f"regexp_replace({_noise}, '{_p}', ' ', 'g')"


def _sql_first(group: str, title: str, patterns) -> str:
    """The canonical title and function group, as a struct, of the first pattern of the group."""
    whens = " ".join(f"WHEN {group} = '{g}' AND regexp_matches({title}, '{p}') THEN {{'t': '{t}', 'f': '{f}'}}" for g, rs in patterns.items() for p, t, f in rs)
    return f"CASE {whens} END"


def _sql_best(title: str, skills: str, weights: tuple[str, str], hits: dict, words: dict) -> str:
    """The best group with its score, the earliest among equals."""
    out = []
    for i, g in enumerate(hits):
        skill = f"least(len(list_filter({_sql_list(words[g])}, lambda k: contains({skills}, k))) / 3.0::DOUBLE, 1.0)"
        out.append(f"{{'score': ({weights[0]})::DOUBLE * (CASE WHEN {hits[g]} THEN 1.0 ELSE 0.0 END)::DOUBLE + ({weights[1]})::DOUBLE * {skill}, 'o': {-i}, 'g': '{g}'}}")
    return "list_sort([" + ", ".join(out) + "], 'DESC')[1]"


_generic = f"list_contains({_sql_list(rules.GENERIC_TITLES)}, t)"
_weights = (f"CASE WHEN {_generic} THEN 0.25 ELSE 0.70 END", f"1::DOUBLE - (CASE WHEN {_generic} THEN 0.25 ELSE 0.70 END)::DOUBLE")
_title_hits = {g: f"len(list_filter({_sql_list(ws)}, lambda k: contains(t, k))) > 0" for g, ws in taxonomy.TITLE_KEYWORDS.items()}
_group_hits = {g: f"regexp_matches(lower(job_title_canonical), '{'|'.join(ps)}')" for g, ps in taxonomy.GROUP_PATTERNS.items()}
_skill_noise = " OR ".join(f"regexp_matches(s, '{p}')" for p in rules.SKILL_NOISE)

HISTORICAL_SQL = f"""po AS (SELECT job_link, company, CASE WHEN list_contains({_alone}, {_call}) THEN {_call} ELSE concat_ws(' ', {_call}, title) END AS raw_title, array_to_string({_asked}, ', ') AS raw_skills FROM job),
pt AS (SELECT job_link, company, trim(regexp_replace(regexp_replace({_noise}, '[^a-z0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
  list_filter(list_transform(regexp_split_to_array(lower(raw_skills), '[,;|]\\s*'), lambda s: trim(regexp_replace(regexp_replace(s, '[^a-z0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM po),
pc AS (SELECT job_link, company, array_to_string(list_transform(string_split(t, ' '), lambda w: coalesce({_sql_map(rules.TITLE_ALIASES)}[w], w)), ' ') AS t, {_unique} AS skills_basic_clean FROM pt),
pb AS (SELECT *, array_to_string(skills_basic_clean, ' ') AS st, FROM pc),
pp AS MATERIALIZED (SELECT *, {_sql_best('t', 'st', _weights, _title_hits, taxonomy.SKILL_KEYWORDS)} AS b FROM pb),
pg AS (SELECT *, CASE WHEN b.score = 0 THEN '{rules.UNKNOWN}' ELSE b.g END AS pg, round(b.score, 4) AS pc, b.score = 0 OR b.score < 0.65 AS review FROM pp),
ph AS MATERIALIZED (SELECT *, {_sql_first('pg', 't', taxonomy.TITLE_PATTERNS)} AS hit,
  list_transform(list_filter(skills_basic_clean, lambda s: length(s) > 1 AND len(string_split(s, ' ')) <= 7 AND NOT ({_skill_noise})), lambda s: coalesce({_sql_map(taxonomy.SKILL_ALIASES)}[s], CASE WHEN regexp_matches(s, '[#+./]') THEN s ELSE {_sql_title('s')} END)) AS l FROM pg),
pk AS (SELECT *, coalesce(hit.t, {_sql_title('t')}) AS job_title_canonical, coalesce(hit.f, 'Other') AS function_group, {_unique} AS skills_canonical FROM ph),
pl AS (SELECT *, lower(array_to_string(skills_canonical, ' ')) AS ct FROM pk),
pf AS MATERIALIZED (SELECT *, {_sql_best('job_title_canonical', 'ct', ('0.75', '0.25'), _group_hits, taxonomy.GROUP_SKILLS)} AS f FROM pl),
hs AS MATERIALIZED (SELECT *, CASE WHEN f.score > 0 THEN f.g ELSE pg END AS fg, CASE WHEN f.score > 0 THEN f.score WHEN pg <> '{rules.UNKNOWN}' THEN pc ELSE 0 END AS sure,
  CASE WHEN f.score > 0 THEN 'final_title_skill_rule' WHEN pg <> '{rules.UNKNOWN}' THEN 'keep_preliminary' ELSE 'no_match' END AS method FROM pf)"""
_H = f"WITH job, {HISTORICAL_SQL}"


def _preliminary(spark, d):
    rows = historical_posts(spark, d).select("link", text.basic_clean_title(F.col("title")).alias("t"), text.split_basic_skills(F.col("skills")).alias("s"))
    return rows.select(F.col("link").alias("job_link"), "t", classify.classify_preliminary(F.col("t"), F.col("s"), taxonomy.TITLE_KEYWORDS, taxonomy.SKILL_KEYWORDS, rules.GENERIC_TITLES).alias("c"))


@query(_H + """ SELECT job_link, pg AS "group", pc AS confidence, CASE WHEN b.score = 0 THEN 'no_match' ELSE 'title_skill_rule' END AS method, review AS needs_review FROM pg""")
def classify_prelim_score(spark, d):
    return _preliminary(spark, d).select("job_link", "c.*")


@query(f"""{_H} SELECT job_link, {_sql_case("lower(concat_ws(' ', t, st, company))", rules.BATCH_GROUPS, rules.UNKNOWN)} AS "group" FROM pb""")
def classify_prelim_cascade(spark, d):
    """The incremental source's cascade over the historical source's postings."""
    rows = historical_posts(spark, d)
    whole = batch.classification_text(text.basic_clean_title(F.col("title")), text.split_basic_skills(F.col("skills")), F.col("company"))
    return rows.select(F.col("link").alias("job_link"), classify.classify_cascade(whole, rules.BATCH_GROUPS).alias("group"))


@query(f"""{_H} SELECT job_link, fg AS "group", coalesce({_sql_map(rules.FAMILY_HISTORICAL)}[fg], '{rules.UNKNOWN}') AS family, round(sure, 4) AS confidence, method, sure < 0.65 AS needs_review FROM hs""")
def classify_final(spark, d):
    rows = silver.historical_silver(historical_posts(spark, d))
    return rows.select("job_link", F.col("occupation_group_final").alias("group"), F.col("occupation_family_final").alias("family"), F.col("occupation_confidence_final").alias("confidence"), F.col("classification_method_final").alias("method"), F.col("needs_review_final").alias("needs_review"))


@query(f"{_H} SELECT coalesce({_sql_map(rules.FAMILY_HISTORICAL)}[fg], '{rules.UNKNOWN}') AS family, count(*) AS n FROM hs GROUP BY 1")
def group_family(spark, d):
    return silver.historical_silver(historical_posts(spark, d)).groupBy(F.col("occupation_family_final").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT job_link, t AS title, pc AS confidence FROM pg WHERE review")
def audit_low_confidence(spark, d):
    return _preliminary(spark, d).where("c.needs_review").select("job_link", F.col("t").alias("title"), "c.confidence")


@query(_H + " SELECT job_title_canonical AS title, count(*) AS n FROM hs WHERE function_group = 'Other' GROUP BY 1")
def audit_unmapped_titles(spark, d):
    rows = silver.historical_silver(historical_posts(spark, d)).where("function_group = 'Other'")
    return rows.groupBy(F.col("job_title_canonical").alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_H}, s AS (SELECT unnest(skills_basic_clean) AS skill FROM pb) SELECT skill, count(*) AS n FROM s WHERE NOT list_contains({_sql_list(taxonomy.SKILL_ALIASES)}, skill) GROUP BY skill")
def audit_unmapped(spark, d):
    known = spark.createDataFrame([(k,) for k in taxonomy.SKILL_ALIASES], "skill string")
    skills = historical_posts(spark, d).select(F.explode(text.split_basic_skills(F.col("skills"))).alias("skill"))
    return skills.join(F.broadcast(known), "skill", "left_anti").groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT job_link, pg AS occupation_group, job_title_canonical, function_group FROM hs")
def canonical_title(spark, d):
    return silver.historical_silver(historical_posts(spark, d)).select("job_link", F.col("occupation_group_preliminary").alias("occupation_group"), "job_title_canonical", "function_group")


@query(_H + " SELECT job_link, skills_canonical FROM hs")
def canonical_skills(spark, d):
    rows = historical_posts(spark, d)
    return rows.select(F.col("link").alias("job_link"), text.canonicalize_skills(text.split_basic_skills(F.col("skills")), taxonomy.SKILL_ALIASES).alias("skills_canonical"))


_sql_rules = ", ".join(f"('{g}', {i}, '{p}', '{t}', '{f}')" for g, rs in taxonomy.TITLE_PATTERNS.items() for i, (p, t, f) in enumerate(rs))


@query(f"""{_H}, ru AS (SELECT * FROM (VALUES {_sql_rules}) AS r(g, rank, pattern, canonical, function_group)),
mt AS (SELECT job_link, g, min(rank) AS rank FROM pg JOIN ru ON pg = g AND regexp_matches(t, pattern) GROUP BY 1, 2), hc AS (SELECT g, rank, count(*) AS n FROM mt GROUP BY 1, 2)
SELECT ru.g AS "group", CAST(ru.rank AS INTEGER) AS rank, pattern, canonical, function_group, coalesce(n, 0) AS n FROM ru LEFT JOIN hc USING (g, rank)""")
def rule_hits(spark, d):
    """The title rules as a table, with the postings that each of them names."""
    rules_ = classify.title_rules(spark, taxonomy.TITLE_PATTERNS)
    rows = _preliminary(spark, d).select(F.col("c.group").alias("group"), "t").groupBy("group", "t").agg(F.count(F.lit(1)).alias("postings"))
    hits = classify.first_hits(rows, rules_, "group", "t").join(rows, ["group", "t"]).groupBy("group", "rank").agg(F.sum("postings").alias("n"))
    return rules_.join(hits, ["group", "rank"], "left").fillna(0, ["n"])


_title = _collapsed(f"replace(translate('Urgent hiring – ' || {_sql_pick(CALLED_BATCH, 'CAST(job_link AS BIGINT)')} || ' ' || title || ' (Outsourcing)/HCM office |  ' || source || ' (Contract) — ', '–—|', '-- '), '/', ' / ')")
for _p in rules.BATCH_TITLE_NOISE:
    _title = f"regexp_replace({_title}, '(?i){_p}', '', 'g')"
_title = f"trim({_collapsed(_title)}, '{rules.TITLE_ENDS}')"
_raw_title = f"trim('Urgent hiring – ' || {_sql_pick(CALLED_BATCH, 'CAST(job_link AS BIGINT)')} || ' ' || title || ' (Outsourcing)/HCM office |  ' || source || ' (Contract) — ')"
_basic = f"list_filter(list_transform(list_transform(list_concat(skills, [{_sql_pick(ASKED_BATCH, 'CAST(job_link AS BIGINT)')}, {_sql_pick(ASKED_BATCH, 'CAST(job_link AS BIGINT) * 7 + 3')}]), lambda s: CASE WHEN lower(trim(s)) IN ('nan', 'none', 'null') THEN '' ELSE {_collapsed('s')} END), lambda s: coalesce({_sql_map(rules.SKILL_SPELLINGS)}[s], s)), lambda s: s <> '')"
_batch_noise = " OR ".join(f"regexp_matches(lower(s), '{p}')" for p in rules.SKILL_NOISE)
_canonical = f"list_transform(list_filter(sb, lambda s: length(s) > 1 AND len(string_split(s, ' ')) <= 8 AND NOT ({_batch_noise})), lambda s: coalesce({_sql_map(rules.SKILL_ALIASES_BATCH)}[lower(s)], CASE WHEN regexp_matches(s, '[#+./-]') THEN s ELSE {_sql_title('s')} END))"
_find = lambda p: f"{_sql_map(rules.COUNTRIES_BATCH)}[lower({p})]"
_city = lambda p: f"coalesce({_sql_map(rules.CITIES_BATCH)}[lower({p})], {_sql_title(p)})"

SILVER_SQL = f"""{_place}, lb AS (SELECT job_link, CASE WHEN lower(trim(r)) IN ('', 'nan', 'none', 'null') THEN '' ELSE {_collapsed('r')} END AS place FROM raw),
lq AS (SELECT job_link, place, list_filter(list_transform(string_split(replace(translate(place, '|;', ',,'), ' - ', ','), ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM lb),
la AS (SELECT job_link, place, parts, len(parts) AS n, coalesce(list_position(list_transform(parts, lambda p: {_find("p")} IS NOT NULL), true), 0) AS pos FROM lq),
lk AS (SELECT job_link, place, CASE WHEN n = 0 THEN 'Unknown' WHEN n = 1 THEN coalesce({_find("parts[1]")}, 'Unknown') WHEN pos > 0 THEN {_find("parts[pos]")} ELSE {_sql_title("parts[-1]")} END AS country_clean,
  CASE WHEN n = 0 OR (n = 1 AND pos > 0) THEN 'Unknown' ELSE {_city("parts[CASE WHEN n = 1 OR pos = 0 THEN 1 WHEN pos = 1 THEN 2 ELSE pos - 1 END]")} END AS city_clean FROM la),
sa AS (SELECT job_link, source, batch, md5(trim(lower(concat_ws('|', job_link, {_raw_title}, company)))) AS source_job_id, {_collapsed('company')} AS company_clean, {_title} AS title_clean, {_basic} AS l FROM job),
sk AS (SELECT *, {_unique} AS sb FROM sa),
sg AS (SELECT * EXCLUDE (l), {_sql_case("lower(concat_ws(' ', title_clean, array_to_string(sb, ' '), company_clean))", rules.BATCH_GROUPS, rules.UNKNOWN)} AS g, {_canonical} AS l FROM sk),
si AS (SELECT *, {_unique} AS skills_canonical, {_sql_first('g', 'lower(title_clean)', taxonomy.TITLE_PATTERNS_BATCH)} AS hit FROM sg),
sv AS (SELECT source, source_job_id, job_link, job_link AS job_url, company_clean, title_clean AS job_title_basic_clean, place AS location_basic_clean, sb AS skills_basic_clean, batch AS crawl_batch, g AS occupation_group_preliminary,
  coalesce(hit.t, {_sql_title('title_clean')}) AS job_title_canonical, coalesce(hit.f, 'Other') AS function_group, {_sql_case('lower(title_clean)', rules.SENIORITY_BATCH, 'Not specified')} AS seniority, skills_canonical, city_clean, country_clean,
  CASE WHEN city_clean = 'Unknown' AND country_clean = 'Unknown' THEN 'Unknown' ELSE concat_ws(', ', city_clean, country_clean) END AS location_final, g AS occupation_group_final, coalesce({_sql_map(rules.FAMILY_BATCH)}[g], '{rules.UNKNOWN}') AS occupation_family_final,
  CAST(len(skills_canonical) AS INTEGER) AS skills_count_final, title_clean <> '' AS has_title, len(skills_canonical) > 0 AS has_skills, place <> '' AS has_location FROM si JOIN lk USING (job_link)),
gd AS (SELECT source, source_job_id, job_link, job_url, company_clean AS company, job_title_canonical, occupation_group_final, occupation_family_final, seniority, city_clean, country_clean, location_final, skills_canonical, skills_count_final,
  'Job title: ' || job_title_canonical || '.' AS title_text, 'Required skills: ' || array_to_string(skills_canonical, ', ') || '.' AS skills_text, crawl_batch,
  'Job title: ' || job_title_canonical || '. Location: ' || location_final || '. Required skills: ' || array_to_string(skills_canonical, ', ') || '.' AS full_text FROM sv WHERE job_title_canonical <> '' AND skills_count_final > 0)"""
_S = f"WITH job, {SILVER_SQL}"


@query(f"{_S} SELECT *, has_title AND has_skills AS is_valid_for_gold FROM sv")
def silver_job_view(spark, d):
    """Every step of the incremental source's Silver build over all postings: cleaned, classified, with canonical titles, function groups, cities, countries
    and families."""
    return silver.incremental_silver(incremental_posts(spark, d))


@query(_S + " SELECT job_link, g AS occupation_group, coalesce(hit.t, " + _sql_title("title_clean") + ") AS job_title_canonical, coalesce(hit.f, 'Other') AS function_group FROM si")
def canonical_title_cs(spark, d):
    return silver.incremental_silver(incremental_posts(spark, d)).select("job_link", F.col("occupation_group_preliminary").alias("occupation_group"), "job_title_canonical", "function_group")


@query(_S + " SELECT * FROM gd")
def gold_build(spark, d):
    """The Gold layer of all postings read as incremental ones: 18 columns."""
    return silver.gold(silver.incremental_silver(incremental_posts(spark, d)))


@query(_S + " SELECT * EXCLUDE (title_text, skills_text, full_text) FROM gd")
def gold_metadata(spark, d):
    """What the vectors' rows stand for: the Gold layer's 14 columns and the batch."""
    return silver.gold(silver.incremental_silver(incremental_posts(spark, d))).select(*silver.METADATA)


@query(_S + """, js AS (SELECT source_job_id, unnest(skills_canonical) AS skill, job_title_canonical, company, occupation_group_final, occupation_family_final, seniority, city_clean, country_clean, location_final, crawl_batch FROM gd)
SELECT DISTINCT source_job_id, trim(skill) AS skill, job_title_canonical, company, occupation_group_final, occupation_family_final, seniority, city_clean, country_clean, location_final, crawl_batch FROM js WHERE trim(skill) <> ''""")
def stream_mart_skills(spark, d):
    """The mart's skills with all 11 columns, after the stream."""
    return mart.read_table(spark, streamed_mart(spark, d), "job_skills")


@query(_S + " SELECT source_job_id, source, company, job_title_canonical, occupation_group_final, occupation_family_final, seniority, city_clean, country_clean, location_final, skills_count_final, crawl_batch, job_url, job_link FROM gd")
def stream_mart(spark, d):
    """The mart's postings with all 14 columns, after the stream."""
    return mart.read_table(spark, streamed_mart(spark, d), "jobs")


@query(_S + " SELECT DISTINCT crawl_batch, TIMESTAMP '2024-01-02' AS processed_at FROM gd")
def stream_ledger(spark, d):
    """The mart's ledger, after the stream: every batch of postings once."""
    return mart.read_table(spark, streamed_mart(spark, d), "batches")


def streamed_mart(spark, d) -> str:
    """Lands the postings as one file a batch in a new shared folder, and streams them through Silver and Gold into a mart there."""
    root = f"{shared_folder(spark)}/_marts/{uuid.uuid4().hex}"
    incremental_posts(spark, d).repartition("crawl_batch").write.partitionBy("crawl_batch").parquet(f"{root}/landing")
    stream_mart_at(spark, f"{root}/landing", root, F.lit("2024-01-02").cast("timestamp"))
    return f"{root}/mart"
