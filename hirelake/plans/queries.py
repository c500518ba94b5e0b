"""The library's queries over the given tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import location, rules, text
from hirelake.operators import cellstore, tables, textmodel, vectors
from hirelake.plans.jobs import JOB_SQL, job_view, read
from hirelake.sources.files import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; its SQL may start from the job view."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("WITH job", f"WITH {JOB_SQL}")
        return f

    return put


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_map(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _sql_case(column: str, ruleset, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{g}'" for g, p in ruleset) + f" ELSE '{default}' END"


MARK = "concat('Sr. ', title, ' (Remote) - Full-Time Dev / ', source)"


@query(f"""WITH job SELECT job_link, title AS job_title_raw, company, array_to_string(skills, ', ') AS skills_raw, location AS location_raw, '' AS description_raw, source FROM job""")
def conform_left_join_dedup(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    jobs = job_view(spark, d)
    joined = jobs.join(orders.select(F.col("o_orderkey").cast("string").alias("job_link"), "o_orderdate"), "job_link", "left").withColumn("skills_raw", F.array_join("skills", ", "))
    columns = {"job_link": ["job_link"], "job_title_raw": ["job_title", "title"], "company": ["company", "company_name"], "skills_raw": ["job_skills", "skills_raw"], "location_raw": ["job_location", "location"], "description_raw": ["job_summary", "description"], "source": ["source"]}
    return tables.keep_first(tables.conform(joined, columns, ["job_link"]), ["job_link"], [F.col("job_title_raw"), F.col("company")])


def _marked(spark, d):
    return job_view(spark, d).withColumn("raw", F.concat(F.lit("Sr. "), "title", F.lit(" (Remote) - Full-Time Dev / "), "source"))


_noise = "trim(regexp_replace(lower(" + MARK + "), '\\s+', ' ', 'g'))"
for _w in rules.TITLE_NOISE:
    _noise = f"regexp_replace({_noise}, '{_w}', ' ', 'g')"


@query(f"""WITH job, c AS (SELECT job_link, trim(regexp_replace(regexp_replace({_noise}, '[^a-z0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM job)
SELECT job_link, array_to_string(list_transform(string_split(t, ' '), lambda w: coalesce({_sql_map(rules.TITLE_ALIASES)}[w], w)), ' ') AS title_clean FROM c""")
def clean_title(spark, d):
    return _marked(spark, d).select("job_link", text.basic_clean_title(F.col("raw")).alias("title_clean"))


@query("""WITH job, p AS (SELECT job_link, list_filter(list_transform(regexp_split_to_array(lower(concat(array_to_string(skills, '; '), ' | C#,', company)), '[,;|]\\s*'),
  lambda s: trim(regexp_replace(regexp_replace(s, '[^a-z0-9+#./\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM job)
SELECT job_link, list_filter(l, lambda x, i: list_position(l, x) = i) AS skills_clean FROM p""")
def split_skills(spark, d):
    raw = F.concat(F.array_join("skills", "; "), F.lit(" | C#,"), F.col("company"))
    return job_view(spark, d).select("job_link", text.split_basic_skills(raw).alias("skills_clean"))


@query("""WITH job, p AS (SELECT job_link, CASE CAST(job_link AS BIGINT) % 4 WHEN 0 THEN list_transform(skills, lambda s, i: CASE WHEN i % 2 = 0 THEN s || chr(39) || 's, "new"' ELSE s || ', too' END)
  WHEN 1 THEN list_concat(skills, ['1', '2.5']) WHEN 2 THEN skills ELSE [] END AS l FROM job)
SELECT job_link, l AS parsed, len(l) AS n FROM p""")
def parse_skills_literal(spark, d):
    """Each posting's skills written as a list with both quotes, as a tuple with numbers, between commas, or as a null token."""
    single, double = (lambda s: F.concat(F.lit("'"), s, F.lit("\\'s, \"new\"'"))), (lambda s: F.concat(F.lit('"'), s, F.lit(', too"')))
    items = F.array_join(F.transform("skills", lambda s, i: F.when(i % 2 == 1, single(s)).otherwise(double(s))), ", ")
    quoted = F.array_join(F.transform("skills", lambda s: F.concat(F.lit("'"), s, F.lit("', "))), "")
    n = F.col("job_link").cast("long") % 4
    written = F.when(n == 0, F.concat(F.lit("["), items, F.lit("]"))).when(n == 1, F.concat(F.lit("("), quoted, F.lit("1, 2.5)"))).when(n == 2, F.array_join("skills", ", ")).otherwise(" NaN ")
    parsed = text.parse_skills(written)
    return job_view(spark, d).select("job_link", parsed.alias("parsed"), F.size(parsed).cast("long").alias("n"))


@query("""WITH job SELECT job_link, replace(trim(regexp_replace(lower(concat(location, ' | ', company)), '\\s+', ' ', 'g')), '|', ',') AS location_clean FROM job""")
def location_basic(spark, d):
    return job_view(spark, d).select("job_link", text.basic_clean_location(F.concat("location", F.lit(" | "), "company")).alias("location_clean"))


@query("""WITH job SELECT job_link, md5(trim(lower(concat_ws('|', job_link, title, company)))) AS source_job_id FROM job""")
def job_id_md5(spark, d):
    return job_view(spark, d).select("job_link", text.make_source_job_id(F.col("job_link"), F.col("title"), F.col("company")).alias("source_job_id"))


_levels = "['Intern', 'Entry level', 'Lead', 'VP', 'Expert', 'Country Manager', 'Owner']"


@query(f"""WITH job, t AS (SELECT job_link, lower(concat({_levels}[1 + CAST(job_link AS BIGINT) % 7], ' ', title)) AS t FROM job)
SELECT job_link, {_sql_case("t", rules.SENIORITY, "Not specified")} AS seniority, {_sql_case("t", rules.SENIORITY_BATCH, "Not specified")} AS seniority_batch FROM t""")
def seniority(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in ("Intern", "Entry level", "Lead", "VP", "Expert", "Country Manager", "Owner")]), (F.col("job_link").cast("long") % 7 + 1).cast("int"))
    t = F.concat(level, F.lit(" "), "title")
    return job_view(spark, d).select("job_link", text.extract_seniority(t).alias("seniority"), text.extract_seniority(t, batch=True).alias("seniority_batch"))


def _sql_title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda w: upper(w[1]) || w[2:]), '')"


#: What the postings' own places are spelled with: a word that says nothing, a separator, a country or state, all by the company's number.
PLACE_PREFIXES = ["", *rules.LOCATION_NOISE]
PLACE_SEPARATORS = [", ", "; ", " | ", " - ", ",, "]
PLACE_NAMES = [*sorted({**rules.COUNTRIES, **rules.COUNTRIES_BATCH}), *sorted(rules.CITIES_BATCH), *rules.STATE_CODES, *rules.STATE_NAMES, "", "none", "nan", "o'fallon"]


def _spelled_location():
    """The view's location as a posting may spell it: with a country, city or state before or after it, or that alone."""
    n = F.coalesce(F.regexp_extract("company", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    pick = lambda values: F.element_at(text.literal_list(values), (n % len(values) + 1).cast("int"))
    sep, name = pick(PLACE_SEPARATORS), pick(PLACE_NAMES)
    place = F.when(n % 3 == 0, F.concat("location", sep, name)).when(n % 3 == 1, F.concat(name, sep, "location")).otherwise(name)
    return F.concat(pick(PLACE_PREFIXES), F.lit(" "), place)


def _sql_pick(values: list[str]) -> str:
    return f"{_sql_list(values)}[1 + n % {len(values)}]"


_place = f"""num AS (SELECT job_link, location, coalesce(try_cast(regexp_extract(company, '(\\d+)$', 1) AS BIGINT), 0) AS n FROM job),
raw AS (SELECT job_link, concat({_sql_pick(PLACE_PREFIXES)}, ' ', CASE n % 3 WHEN 0 THEN concat(location, {_sql_pick(PLACE_SEPARATORS)}, {_sql_pick(PLACE_NAMES)})
  WHEN 1 THEN concat({_sql_pick(PLACE_NAMES)}, {_sql_pick(PLACE_SEPARATORS)}, location) ELSE {_sql_pick(PLACE_NAMES)} END) AS r FROM num)"""
_quiet = "translate(trim(regexp_replace(lower(r), '\\s+', ' ', 'g')), '|;', ',,')"
for _w in rules.LOCATION_NOISE:
    _quiet = f"replace({_quiet}, '{_w}', '')"
_country = f"coalesce({_sql_map(rules.COUNTRIES)}[replace(p, '.', '')], CASE WHEN list_contains({_sql_list([*rules.STATE_CODES, *rules.STATE_NAMES])}, replace(p, '.', '')) THEN 'United States' END)"


@query(f"""WITH job, {_place}, q AS (SELECT job_link, list_filter(list_transform(string_split(trim({_quiet}, ' ,-/'), ','), lambda p: trim(p, ' ,-/')), lambda p: p <> '') AS parts FROM raw),
c AS (SELECT job_link, parts, list_transform(parts, lambda p: {_country}) AS found FROM q),
k AS (SELECT job_link, coalesce({_sql_title(f"list_filter(parts, lambda p, i: found[i] IS NULL AND p NOT IN ('', 'nan', 'none', 'null'))[1]")}, '') AS city_clean, coalesce(list_filter(list_reverse(found), lambda x: x IS NOT NULL)[1], '') AS country_clean FROM c)
SELECT *, CASE WHEN city_clean || country_clean = '' THEN 'Unknown' ELSE array_to_string(list_filter([city_clean, country_clean], lambda x: x <> ''), ', ') END AS location_final FROM k""")
def location_us(spark, d):
    return job_view(spark, d).select("job_link", location.clean_city_country(_spelled_location()).alias("x")).select("job_link", "x.*")


_find = lambda p: f"{_sql_map(rules.COUNTRIES_BATCH)}[lower({p})]"
_city = lambda p: f"coalesce({_sql_map(rules.CITIES_BATCH)}[lower({p})], {_sql_title(p)})"


@query(f"""WITH job, {_place}, t AS (SELECT job_link, CASE WHEN lower(trim(r)) IN ('', 'nan', 'none', 'null') THEN '' ELSE trim(r) END AS t FROM raw),
q AS (SELECT job_link, list_filter(list_transform(string_split(replace(translate(t, '|;', ',,'), ' - ', ','), ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM t),
a AS (SELECT job_link, parts, len(parts) AS n, coalesce(list_position(list_transform(parts, lambda p: {_find("p")} IS NOT NULL), true), 0) AS pos FROM q),
k AS (SELECT job_link, CASE WHEN n = 0 THEN 'Unknown' WHEN n = 1 THEN coalesce({_find("parts[1]")}, 'Unknown') WHEN pos > 0 THEN {_find("parts[pos]")} ELSE {_sql_title("parts[-1]")} END AS country_clean,
  CASE WHEN n = 0 OR (n = 1 AND pos > 0) THEN 'Unknown' ELSE {_city("parts[CASE WHEN n = 1 OR pos = 0 THEN 1 WHEN pos = 1 THEN 2 ELSE pos - 1 END]")} END AS city_clean FROM a)
SELECT *, CASE WHEN city_clean = 'Unknown' AND country_clean = 'Unknown' THEN 'Unknown' ELSE concat_ws(', ', city_clean, country_clean) END AS location_final FROM k""")
def location_vn(spark, d):
    return job_view(spark, d).select("job_link", location.clean_location_batch(_spelled_location()).alias("x")).select("job_link", "x.*")


@query("""WITH job SELECT job_link, concat('Job title: ', CASE WHEN trim(title) = '' THEN 'Not specified' ELSE trim(title) END, '.') AS title_text,
concat('Required skills: ', CASE WHEN len(skills) > 0 THEN array_to_string(skills, ', ') ELSE 'Not specified' END, '.') AS skills_text,
concat('Job title: ', CASE WHEN trim(title) = '' THEN 'Not specified' ELSE trim(title) END, '. Location: ', CASE WHEN trim(location) = '' THEN 'Unknown' ELSE trim(location) END, '. Required skills: ',
 CASE WHEN len(skills) > 0 THEN array_to_string(skills, ', ') ELSE 'Not specified' END, '.') AS full_text, len(skills) AS skills_count_final
FROM job WHERE trim(title) <> '' AND len(skills) > 0""")
def gold_texts(spark, d):
    rows = job_view(spark, d).where((F.trim("title") != "") & (F.size("skills") > 0))
    return rows.select("job_link", text.title_text(F.col("title")).alias("title_text"), text.skills_text(F.col("skills")).alias("skills_text"), text.full_text(F.col("title"), F.col("location"), F.col("skills")).alias("full_text"), F.size("skills").cast("long").alias("skills_count_final"))


@query("""WITH job, n AS (SELECT count(*) AS n0, count(*) FILTER (title <> '') AS n1, count(*) FILTER (title <> '' AND len(skills) > 0) AS n2, count(*) FILTER (title <> '' AND len(skills) > 0 AND source = 'historical') AS n3 FROM job)
SELECT 'has_title' AS step, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS dropped FROM n UNION ALL SELECT 'has_skills', n1, n2, n1 - n2 FROM n UNION ALL SELECT 'historical', n2, n3, n2 - n3 FROM n""")
def gold_funnel(spark, d):
    return tables.filter_funnel(job_view(spark, d), [("has_title", F.col("title") != ""), ("has_skills", F.size("skills") > 0), ("historical", F.col("source") == "historical")])


@query("""WITH job SELECT CASE WHEN trim(location) = '' THEN 'Unknown' ELSE trim(location) END AS value, count(*) AS n FROM job GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def value_counts_top(spark, d):
    return tables.value_counts(job_view(spark, d), "location", 10)


@query("""WITH job SELECT count(*) AS n, avg(len(skills)) AS mean, stddev_samp(len(skills)) AS std, CAST(min(len(skills)) AS DOUBLE) AS least, quantile_cont(len(skills), 0.25) AS q25, quantile_cont(len(skills), 0.5) AS q50, quantile_cont(len(skills), 0.75) AS q75, CAST(max(len(skills)) AS DOUBLE) AS most FROM job""")
def describe_counts(spark, d):
    return tables.describe(job_view(spark, d).select(F.size("skills").alias("c")), "c")


@query("""WITH job SELECT count(*) AS n, count(*) FILTER (title = '') AS no_title, round(100.0 * count(*) FILTER (title = '') / count(*), 2) AS no_title_pct, count(*) FILTER (len(skills) = 0) AS no_skills, round(100.0 * count(*) FILTER (len(skills) = 0) / count(*), 2) AS no_skills_pct,
count(*) FILTER (location = '') AS no_location, round(100.0 * count(*) FILTER (location = '') / count(*), 2) AS no_location_pct FROM job""")
def missing_rates(spark, d):
    return tables.missing_rates(job_view(spark, d), {"title": F.col("title") != "", "skills": F.size("skills") > 0, "location": F.col("location") != ""})


@query("""WITH job, s AS (SELECT unnest(skills) AS skill, job_link AS source_job_id, company, location FROM job) SELECT DISTINCT source_job_id, trim(skill) AS skill, company, location FROM s WHERE trim(skill) <> ''""")
def mart_job_skills(spark, d):
    return tables.mart_job_skills(job_view(spark, d).withColumnRenamed("job_link", "source_job_id"), ["company", "location"])


@query("""WITH job SELECT job_link AS source_job_id, title, company, location, CAST(len(skills) AS INTEGER) AS skills_count_final FROM job WHERE job_link <> ''""")
def mart_jobs(spark, d):
    rows = job_view(spark, d).select(F.col("job_link").alias("source_job_id"), "title", "company", "location", F.size("skills").alias("skills_count_final"))
    return tables.keep_first(rows.where("source_job_id <> ''"), ["source_job_id"], [F.col("title"), F.col("company")])


@query("""WITH job SELECT job_link AS source_job_id, source, batch FROM job WHERE source = 'historical' OR batch >= '1998-06'""")
def mart_append_new(spark, d):
    jobs = job_view(spark, d).select(F.col("job_link").alias("source_job_id"), "source", "batch")
    old, new = jobs.where("source = 'historical'"), jobs.where("source = 'historical' or batch >= '1998-06'")
    return old.unionByName(tables.insert_if_absent(new, old, ["source_job_id"]))


@query("""WITH job SELECT DISTINCT batch FROM job WHERE source = 'incremental'""")
def unprocessed_batches(spark, d):
    jobs = job_view(spark, d)
    return tables.unprocessed(jobs, jobs.where("source = 'historical'"), "batch").where("batch is not null")


@query("""WITH job SELECT job_link, title, company, NULL::VARCHAR AS batch FROM job WHERE source = 'historical' UNION ALL SELECT job_link, title, company, batch FROM job WHERE source = 'incremental'""")
def append_union(spark, d):
    jobs = job_view(spark, d)
    return jobs.where("source = 'historical'").select("job_link", "title", "company").unionByName(jobs.where("source = 'incremental'").select("job_link", "title", "company", "batch"), allowMissingColumns=True)


@query("""SELECT 'full' AS side, count(*) AS n, 0::BIGINT AS missing FROM embeddings UNION ALL SELECT 'even', count(*) FILTER (label % 2 = 0), count(*) FILTER (label % 2 <> 0) FROM embeddings""")
def aligned_counts(spark, d):
    e = read(spark, d, "embeddings")
    return tables.aligned({"full": e, "even": e.where("label % 2 = 0")}, "vec_id")


_model = """rc AS (SELECT role, count(*) AS job_count FROM job WHERE trim(role) <> '' AND len(skills) > 0 GROUP BY role HAVING count(*) >= 3),
ex AS (SELECT j.role, unnest(skills) AS skill FROM job j SEMI JOIN rc ON j.role = rc.role WHERE len(skills) > 0),
cn AS (SELECT role, skill, count(*) AS cnt FROM ex WHERE trim(skill) <> '' GROUP BY 1, 2)"""
_matrix = """, dfs AS (SELECT skill, count(DISTINCT role) AS df FROM cn GROUP BY 1),
mx AS (SELECT cn.role, cn.skill, cnt / job_count * (ln(((SELECT count(*) FROM rc) + 1) / (df + 1)) + 1) AS score, cnt / job_count AS tf, ln(((SELECT count(*) FROM rc) + 1) / (df + 1)) + 1 AS idf, job_count FROM cn JOIN rc USING (role) JOIN dfs USING (skill))"""
_docs = """, dc AS (SELECT role, concat_ws(' ', role, role, string_agg(array_to_string(list_transform(range(cnt), lambda i: skill), ' '), ' ' ORDER BY skill)) AS document FROM cn GROUP BY role)"""
_w = lambda src, key: f"""SELECT {key}, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM (SELECT {key}, regexp_extract_all(lower({src[1]}), '\\b(\\w\\w+)\\b') AS w FROM {src[0]})"""
_terms = f""", tt AS ({_w(("dc", "document"), "role")}), tf AS (SELECT role, term, count(*) AS tf FROM (SELECT role, unnest(t) AS term FROM tt) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM dc)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM dc)),
rw AS (SELECT role, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)), tw AS (SELECT role, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY role)) AS w FROM rw)"""


def _skill_model(spark, d):
    return textmodel.role_skill_counts(job_view(spark, d).select("role", "skills"))


@query(f"WITH job, {_model} SELECT role, skill, cnt FROM cn")
def role_skill_counts(spark, d):
    return _skill_model(spark, d)[0]


@query(f"WITH job, {_model}{_docs} SELECT role, document FROM dc")
def role_documents(spark, d):
    return textmodel.role_documents(_skill_model(spark, d)[0])


@query(f"WITH job, {_model}{_matrix} SELECT role, skill, score, tf, idf, job_count FROM mx")
def skill_tfidf(spark, d):
    return textmodel.skill_tfidf(*_skill_model(spark, d))


@query(f"WITH job, {_model}{_docs}{_terms} SELECT role, term, w FROM tw")
def tfidf_terms(spark, d):
    return textmodel.fit_tfidf(textmodel.role_documents(_skill_model(spark, d)[0]))[0]


@query(f"""WITH job, {_model}{_matrix}, dc AS (SELECT role, concat_ws(' ', role, role, string_agg(array_to_string(list_transform(range(cnt), lambda i: skill), ' '), ' ' ORDER BY round(score, 9) DESC, skill)) AS document FROM cn JOIN mx USING (role, skill) GROUP BY role)
{_terms}, sj AS (SELECT role, CAST(sum(cnt) AS BIGINT) AS job_count FROM cn GROUP BY role) SELECT role, term, w, job_count FROM tw JOIN sj USING (role)""")
def tfidf_rebuild(spark, d):
    """The model saved as its matrix and fitted again from that alone."""
    folder = f"{shared_folder(spark)}/_models/{uuid.uuid4().hex}"
    textmodel.save_matrix(textmodel.matrix(*_skill_model(spark, d)), folder)
    weights, _, roles = textmodel.rebuild(textmodel.load_matrix(spark, folder))
    return weights.join(roles, "role").select("role", "term", "w", "job_count")


_near = """, qs AS (SELECT j.company, min(CAST(job_link AS BIGINT)) AS user_id FROM job j GROUP BY company),
qd AS (SELECT user_id, concat_ws(' ', role, array_to_string(skills, ' ')) AS text, skills FROM qs JOIN job ON job_link = CAST(user_id AS VARCHAR))"""
_query = _near + f""", qt AS ({_w(("qd", "text"), "user_id")}), qf AS (SELECT user_id, term, count(*) AS tf FROM (SELECT user_id, unnest(t) AS term FROM qt) GROUP BY 1, 2),
qr AS (SELECT user_id, term, (1 + ln(tf)) * idf AS raw FROM qf JOIN idf USING (term)), qw AS (SELECT user_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY user_id)) AS w FROM qr),
sm AS (SELECT user_id, role, sum(qw.w * tw.w) AS sim FROM qw JOIN tw USING (term) GROUP BY 1, 2),
nr AS (SELECT user_id, role, sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, role) AS rk FROM sm) WHERE rk <= 10 AND sim >= 0.1)"""


def _profiles(spark, d):
    """One query per company: the role and skills of its first order."""
    jobs = job_view(spark, d)
    first = jobs.groupBy("company").agg(F.min(F.col("job_link").cast("long")).alias("user_id"))
    return first.select("user_id", F.col("user_id").cast("string").alias("job_link")).join(jobs, "job_link").select("user_id", F.concat_ws(" ", "role", F.array_join("skills", " ")).alias("text"), "skills")


def _nearest(spark, d):
    counts, roles = map(stored, _skill_model(spark, d))
    weights, idf = textmodel.fit_tfidf(stored(textmodel.role_documents(counts)))
    profiles = stored(_profiles(spark, d))
    return textmodel.similar_roles(weights, idf, profiles.select("user_id", "text"), "user_id"), counts, roles, profiles


@query(f"WITH job, {_model}{_docs}{_terms}{_query} SELECT user_id, role, sim FROM nr")
def similar_roles(spark, d):
    return _nearest(spark, d)[0]


# Weights of skills by level over the part words of the given tables, beside the domain's own.
LOCAL_WEIGHTS = {"senior": {"hot gear": 1.5, "cold plate": 1.4, "large rod": 1.2}, "junior": {"small ring": 1.2, "blue bolt": 1.1}}
_weights = [(level, skill, w) for table in (rules.LEVEL_WEIGHTS, LOCAL_WEIGHTS) for level, ws in table.items() for skill, w in ws.items()]
_sql_weights = ", ".join(f"('{level}', '{skill}', {w}::DOUBLE)" for level, skill, w in _weights)


@query(f"""WITH job, {_model}{_matrix}{_docs}{_terms}{_query}, ow AS (SELECT user_id, unnest(skills) AS skill FROM qd), lw AS (SELECT * FROM (VALUES {_sql_weights}) AS t(level, skill, weight)),
ag AS (SELECT user_id, skill, sum(tf * sim) * any_value(idf) AS score, max(tf) AS tf, any_value(idf) AS idf, CAST(sum(job_count) AS BIGINT) AS job_count FROM nr JOIN mx USING (role) ANTI JOIN ow USING (user_id, skill) GROUP BY 1, 2),
wg AS (SELECT user_id, ag.skill, score * coalesce(weight, 1.0) AS score, tf, idf, job_count FROM ag LEFT JOIN lw ON lw.skill = ag.skill AND lw.level = CASE WHEN user_id % 2 = 0 THEN 'senior' ELSE 'junior' END)
SELECT user_id, skill, score, tf, idf, job_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, skill) AS rk FROM wg) WHERE rk <= 10""")
def tfidf_query(spark, d):
    near, counts, roles, profiles = _nearest(spark, d)
    matrix = textmodel.skill_tfidf(counts, roles)
    owned = profiles.select("user_id", F.explode("skills").alias("skill"))
    users = profiles.select("user_id", F.when(F.col("user_id") % 2 == 0, "senior").otherwise("junior").alias("level"))
    weights = spark.createDataFrame(_weights, "level string, skill string, weight double")
    return textmodel.recommend_skills(near, matrix, owned, "user_id", 10, (users, weights))


@query(f"""WITH job, {_model}{_matrix}{_docs}{_terms}{_query}, br AS (SELECT user_id, role FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, role) AS rk FROM nr) WHERE rk = 1)
SELECT user_id, role, skill, score FROM (SELECT user_id, role, skill, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, skill) AS rk FROM br JOIN mx USING (role)) WHERE rk <= 5""")
def nearest_role_skills(spark, d):
    near, counts, roles, _ = _nearest(spark, d)
    return textmodel.role_skills(near, textmodel.skill_tfidf(counts, roles), "user_id", 5)


@query(f"WITH job, {_model} SELECT role FROM rc ORDER BY role")
def role_list(spark, d):
    return _skill_model(spark, d)[1].select("role").orderBy("role")


@query(f"WITH job, {_model}{_matrix} SELECT role, skill, score FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY round(score, 9) DESC, skill) AS rk FROM mx) WHERE rk <= 5")
def role_skills(spark, d):
    from pyspark.sql import Window

    matrix = textmodel.skill_tfidf(*_skill_model(spark, d))
    w = Window.partitionBy("role").orderBy(F.desc(F.round("score", 9)), "skill")
    return matrix.withColumn("rk", F.row_number().over(w)).where("rk <= 5").select("role", "skill", "score")


@query("""WITH job, t AS (SELECT job_link, unnest(list_filter(string_split(trim(regexp_replace(lower(concat(title, ' ', location)), '[^a-z0-9+#.]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM job),
c AS (SELECT job_link, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS bucket, count(*) AS n FROM t GROUP BY 1, 2)
SELECT job_link, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY job_link)) AS value FROM c""")
def hash_encode(spark, d):
    return vectors.encode_hashed(job_view(spark, d).select("job_link", F.concat("title", F.lit(" "), "location").alias("t")), "job_link", "t")


_dot = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i]))"
_vec = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"
_top = lambda n: f"""WITH {_vec}, s AS (SELECT q.vec_id AS query_id, x.vec_id AS item_id, round({_dot}, 9) AS score FROM v q, v x WHERE q.vec_id % 20 = 0)
SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM s) WHERE rk <= {n}"""  # noqa: E731


def _search(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")
    return e.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vec"), e.select("item_id", "vec")


@query(_top(10))
def topk_exact(spark, d):
    return vectors.top_k(*_search(spark, d), 10)


# Cells of the search, and how many of them a query probes.
CELLS = {"nlist": 256, "nprobe": 112}
#: (cells, probes) that choose_config measures.
SWEPT = [(64, 16), (64, 48), (256, 112), (256, 160)]


def cell_store(spark, d, nlist: int) -> str:
    """The given vectors in a new store of cells, in the shared folder."""
    root = f"{shared_folder(spark)}/_cells/{uuid.uuid4().hex}"
    e = _stored_vectors(spark, d)
    cellstore.train_centres(e, nlist, root)
    cellstore.append_vectors(root, e, e.select("source", "id", F.lit("all").alias("crawl_batch")), ["full"])
    return root


def _stored_vectors(spark, d):
    return read(spark, d, "embeddings").select(F.lit("embeddings").alias("source"), F.col("vec_id").alias("id"), F.lit("full").alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query(_top(10))
def ivf_search(spark, d):
    """By cells, and beyond them where the bounds ask for it: exact."""
    root = cell_store(spark, d, CELLS["nlist"])
    return cellstore.search(spark, root, _search(spark, d)[0], "full", 10, CELLS["nprobe"], exact=True).drop("met")


@query()
def recall_at_k(spark, d):
    """Of the search that meets its probed cells only, with the share of all pairs that it meets."""
    queries, items = _search(spark, d)
    found = cellstore.search(spark, cell_store(spark, d, CELLS["nlist"]), queries, "full", 10, CELLS["nprobe"]).persist()
    n = items.agg(F.count(F.lit(1)).alias("n"))
    met = found.groupBy("query_id").agg(F.max("met").alias("met")).agg(F.avg("met").alias("met"))
    return vectors.recall_at_k(found, vectors.top_k(queries, items, 10), 10).crossJoin(met.crossJoin(n)).select("recall", (F.col("met") / F.col("n")).alias("met_share"))


@query()
def choose_config(spark, d):
    """The fastest of measured (cells, probes) with a recall of 0.97 or more, else the one with the best recall."""
    root = f"{shared_folder(spark)}/_cells/{uuid.uuid4().hex}"
    measured = cellstore.sweep(root, _stored_vectors(spark, d), _search(spark, d)[0], 10, SWEPT)
    return tables.choose_config(measured, 0.97)


KINDS = list(rules.KIND_WEIGHTS)
#: How many items of each source a search for one kind of vector returns: twice as many as are kept.
NEAREST = {source: 2 * limit for source, limit in rules.SOURCE_LIMITS.items()}


def _pool(spark, d):
    """(pool, jobs, profiles): what three searches per source find, by title, by skills and by all of it, for every profile: each customer whose key is divisible
    by 20, with the order of that number. Texts with the same words are searched once, and scores need no text, so a pool is cut before it meets the jobs."""
    jobs = job_view(spark, d).select(F.col("job_link").cast("long").alias("item_id"), "source", "title", "skills", "location")
    people = read(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("item_id"))
    # What scores compare is made once per job, not once per candidate.
    compared = {"t_tokens": text.tokens(F.col("title")), "s_keys": text.skill_keys(F.col("skills")), "place": text.normalize_token(F.col("location")), "p_tokens": text.tokens(F.col("location"))}
    packed = stored(jobs.select("*", *[c.alias(n) for n, c in compared.items()]))
    skills = F.array_join("skills", " ")
    texts = [t.alias(f"{kind}_text") for kind, t in {"title": F.col("title"), "skills": skills, "full": F.concat_ws(" ", "title", skills, "location")}.items()]
    asked = stored(packed.join(people, "item_id", "left_semi"))
    found = vectors.top_k_texts(asked.select(F.col("item_id").alias("query_id"), *texts), packed.select("item_id", "source", *texts), KINDS, NEAREST)
    profiles = asked.select(F.col("item_id").alias("query_id"), F.col("skills").alias("q_skills"), *[F.col(n).alias(f"q_{n}") for n in compared])
    # A profile's candidates stay together from here on: merging and cutting move them once.
    pool = vectors.merge_kinds(found.repartition("query_id", "source")).withColumn("semantic", vectors.semantic())
    return pool, packed.select("item_id", "skills", *compared), profiles


#: The most profiles that are broadcast to their candidates.
MOST_PROFILES = 100_000


def _candidates(pool, jobs, profiles):
    """The scores of a pool, with the jobs' skills."""
    few = profiles.count() <= MOST_PROFILES
    rows = pool.join(jobs, "item_id").join(F.broadcast(profiles) if few else profiles, "query_id")
    scores = rows.select(
        "query_id", "source", "item_id", "title_score", "skills_score", "full_score", "skills",
        text.set_similarity(F.col("q_t_tokens"), F.col("t_tokens")).alias("fuzzy_title"),
        text.set_overlap(F.col("q_s_keys"), F.col("s_keys")).alias("overlap"),
        text.place_score(F.col("q_place"), F.col("place"), F.col("q_p_tokens"), F.col("p_tokens")).alias("place"),
    )
    return vectors.rerank(scores)


def _capped(spark, d):
    pool, jobs, profiles = _pool(spark, d)
    return vectors.cap_by_source(pool, rules.SOURCE_LIMITS), jobs, profiles


_toks = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9+#.]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_cand = f"""WITH job, pf AS (SELECT CAST(c_custkey AS BIGINT) AS query_id, title AS q_title, skills AS q_skills, location AS q_place FROM customer JOIN job ON CAST(c_custkey AS VARCHAR) = job_link WHERE c_custkey % 20 = 0),
jb AS (SELECT CAST(job_link AS BIGINT) AS id, source, title, skills, array_to_string(skills, ' ') AS st, location FROM job),
kd AS (SELECT id, source, 'title' AS kind, title AS t FROM jb UNION ALL SELECT id, source, 'skills', st FROM jb UNION ALL SELECT id, source, 'full', concat_ws(' ', title, st, location) FROM jb),
tk AS (SELECT id, source, kind, unnest(list_filter(string_split(trim(regexp_replace(lower(t), '[^a-z0-9+#.]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM kd),
en AS (SELECT id, source, kind, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n FROM tk GROUP BY ALL),
ev AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY id, kind)) AS v FROM en),
eq AS MATERIALIZED (SELECT id, kind, b, v FROM ev WHERE id IN (SELECT query_id FROM pf)),
sr AS (SELECT q.id AS query_id, x.source, x.id AS item_id, x.kind, round(sum(q.v * x.v), 9) AS score FROM eq q JOIN ev x ON q.kind = x.kind AND q.b = x.b GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, kind ORDER BY score DESC, item_id) AS rk FROM sr) WHERE rk <= CASE source WHEN 'historical' THEN 600 ELSE 100 END),
mg AS (SELECT query_id, source, item_id, coalesce(max(score) FILTER (kind = 'title'), 0) AS st, coalesce(max(score) FILTER (kind = 'skills'), 0) AS ss, coalesce(max(score) FILTER (kind = 'full'), 0) AS sf FROM tp GROUP BY ALL),
tt AS (SELECT mg.*, jb.skills, jb.location, q_place, q_skills, {_toks('q_title')} AS a, {_toks('jb.title')} AS c FROM mg JOIN jb ON jb.id = mg.item_id JOIN pf USING (query_id)),
sc AS (SELECT *, CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE greatest(len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), len(list_intersect(a, c)) / len(a)) END AS t,
 CASE WHEN len(q_skills) = 0 OR len(skills) = 0 THEN 0.0 ELSE len(list_intersect(q_skills, skills)) / len(q_skills) END AS s, string_split(replace(lower(q_place), ',', ''), ' ') AS u, string_split(replace(lower(location), ',', ''), ' ') AS l FROM tt),
sd AS (SELECT *, list_filter(list_transform(u, lambda x: trim(regexp_replace(x, '[^a-z0-9+#.]+', ' ', 'g'))), lambda x: x <> '') AS ut, trim(regexp_replace(lower(q_place), '[^a-z0-9+#.]+', ' ', 'g')) AS un, trim(regexp_replace(lower(location), '[^a-z0-9+#.]+', ' ', 'g')) AS jn FROM sc),
se AS (SELECT *, list_distinct(string_split(un, ' ')) AS x, list_distinct(string_split(jn, ' ')) AS y FROM sd),
pl AS (SELECT *, CASE WHEN un = '' OR jn = '' THEN 0.0 WHEN un = jn THEN 1.0 WHEN contains(un, jn) OR contains(jn, un) THEN 0.8 ELSE least(0.6::DOUBLE, len(list_intersect(x, y)) / len(x)) END AS p FROM se),
rr AS (SELECT query_id, source, item_id, skills, st * 0.3::DOUBLE + ss * 0.3::DOUBLE + sf * 0.4::DOUBLE AS semantic, t, s, p FROM pl),
bs AS (SELECT *, semantic * 0.45::DOUBLE + t * 0.20::DOUBLE + s * 0.25::DOUBLE + p * 0.10::DOUBLE AS base FROM rr),
fn AS (SELECT *, base * CASE source WHEN 'historical' THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END AS final FROM bs)"""


@query(_cand + " SELECT query_id, source, item_id, semantic, base, final FROM fn")
def rerank(spark, d):
    """Every candidate, the best of each profile first."""
    return _candidates(*_pool(spark, d)).select("query_id", "source", "item_id", "semantic", "base", "final").orderBy("query_id", F.desc(F.round("final", 9)), "item_id")


_cut = ", cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(semantic, 9) DESC, item_id) AS rk FROM fn) WHERE rk <= CASE source WHEN 'historical' THEN 300 ELSE 50 END)"


@query(_cand + _cut + " SELECT query_id, source, item_id, semantic FROM cp")
def cap_by_source(spark, d):
    return _capped(spark, d)[0].select("query_id", "source", "item_id", "semantic")


@query(_cand + _cut + " SELECT query_id, item_id, final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, item_id) AS r2 FROM cp) WHERE r2 <= 10")
def recommend_batch(spark, d):
    from pyspark.sql import Window

    pool = _candidates(*_capped(spark, d))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 9)), "item_id")
    return pool.withColumn("r2", F.row_number().over(w)).where("r2 <= 10").select("query_id", "item_id", "final")


@query(_cand + _cut + """, ex AS (SELECT query_id, source, base, unnest(skills) AS skill FROM cp), ow AS (SELECT query_id, unnest(q_skills) AS skill FROM pf),
ag AS (SELECT query_id, skill, sum(base * CASE source WHEN 'historical' THEN 0.40::DOUBLE ELSE 0.60::DOUBLE END) AS recommend_score, count(*) AS job_count, count(*) FILTER (source = 'historical') AS historical_count, count(*) FILTER (source = 'incremental') AS incremental_count FROM ex ANTI JOIN ow USING (query_id, skill) GROUP BY 1, 2)
SELECT query_id, skill, recommend_score, job_count, historical_count, incremental_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(recommend_score, 9) DESC, job_count DESC, skill) AS rk FROM ag) WHERE rk <= 10""")
def missing_skills(spark, d):
    """Over the whole pool of 300 and 50 candidates, not only the best ten."""
    pool, jobs, profiles = _capped(spark, d)
    owned = profiles.select("query_id", F.explode("q_skills").alias("skill")).withColumn("key", text.normalize_token(F.col("skill")))
    return vectors.missing_skills(_candidates(pool, jobs, profiles), owned, 10)


@query("""WITH v0 AS (SELECT vec_id, label % 2 AS par, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, par, sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))) AS a, sqrt(list_sum(list_transform(e[17:32], lambda x: x * x))) AS b, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS c, e FROM v0),
k AS (SELECT vec_id, par, 'title' AS kind, list_transform(e[1:16], lambda x: x / a) AS v FROM n UNION ALL SELECT vec_id, par, 'skills', list_transform(e[17:32], lambda x: x / b) FROM n UNION ALL SELECT vec_id, par, 'full', list_transform(e, lambda x: x / c) FROM n),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS item_id, x.par, q.kind, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])), 9) AS score FROM k q JOIN k x ON q.kind = x.kind WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, par, kind ORDER BY score DESC, item_id) AS rk FROM s) WHERE rk <= CASE par WHEN 0 THEN 600 ELSE 100 END)
SELECT query_id, CASE par WHEN 0 THEN 'historical' ELSE 'incremental' END AS source, item_id, greatest(coalesce(max(score) FILTER (kind = 'title'), 0), 0) AS title_score, greatest(coalesce(max(score) FILTER (kind = 'skills'), 0), 0) AS skills_score, greatest(coalesce(max(score) FILTER (kind = 'full'), 0), 0) AS full_score FROM t GROUP BY 1, 2, 3""")
def multi_kind_candidates(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "historical").otherwise("incremental").alias("source"), "embedding")
    parts = {"title": F.slice("embedding", 1, 16), "skills": F.slice("embedding", 17, 16), "full": F.col("embedding")}
    rows = e.select(F.col("vec_id").alias("item_id"), "source", *[vectors.l2_normalize(p).alias(f"{kind}_vec") for kind, p in parts.items()])
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), *[f"{kind}_vec" for kind in KINDS])
    return vectors.merge_kinds(vectors.top_k_kinds(asked, rows, KINDS, NEAREST))


@query("""SELECT event_id, event_id % 5 < 3 AS readable, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
coalesce(CASE WHEN event_id % 5 < 3 THEN json_extract_string(props, '$.title') END, 'Unknown') AS job_title FROM events""")
def profile_json(spark, d):
    """Answers as models give them: bare, padded, in prose; and those without an object of their own: a list around it, two objects."""
    n, props = F.col("event_id") % 5, F.col("props")
    answer = F.when(n == 0, props).when(n == 1, F.concat(F.lit("\n "), props, F.lit("\n"))).when(n == 2, F.concat(F.lit("Here it is: "), props, F.lit(" Done.")))
    answer = answer.when(n == 3, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.concat(props, F.lit(" or "), props))
    got = text.profile_from_json(answer, "k long, title string")
    return read(spark, d, "events").select("event_id", got.isNotNull().alias("readable"), got["k"].alias("k"), text.or_default(got["title"], "Unknown").alias("job_title"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS squeezed FROM documents""")
def squeeze_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.squeeze_text(F.col("text"), None).alias("squeezed"))


@query("""WITH job SELECT job_link, coalesce(nullif(trim(location), ''), nullif(trim(job_link), ''), 'No link') AS link, least(CAST(trunc(100 * ((CAST(job_link AS BIGINT) % 131) / 100.0::DOUBLE)) AS INTEGER), 100) AS pct,
CASE WHEN CAST(job_link AS BIGINT) % 131 >= 70 THEN 'high' WHEN CAST(job_link AS BIGINT) % 131 >= 40 THEN 'medium' ELSE 'low' END AS band FROM job""")
def display_fields(spark, d):
    score = (F.col("job_link").cast("long") % 131) / 100
    return job_view(spark, d).select("job_link", text.first_non_blank(F.col("location"), F.col("job_link"), default="No link").alias("link"), text.score_percent(score).alias("pct"), text.score_band(score).alias("band"))


@query("""SELECT c_custkey, c_name FROM customer ORDER BY md5('42' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 30""")
def sample_seeded(spark, d):
    return tables.sample_seeded(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 30, "42")
