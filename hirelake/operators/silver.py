"""Whole Silver and Gold builds of both sources, as compositions of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions import batch, location, rules, taxonomy, text
from hirelake.operators import classify, tables

#: Columns of the Gold layer, of its metadata, and of the mart, in their order.
GOLD = ["source", "source_job_id", "job_link", "job_url", "company", "job_title_canonical", "occupation_group_final", "occupation_family_final", "seniority", "city_clean", "country_clean", "location_final", "skills_canonical", "skills_count_final", "title_text", "skills_text", "full_text", "crawl_batch"]
METADATA = [*GOLD[:14], "crawl_batch"]


def incremental_silver(raw: DataFrame) -> DataFrame:
    """raw (source, title, company, location, link, skills array, crawl_batch) through every step of the incremental source: conformed, once per batch and id, cleaned,
    classified, canonical, located, flagged."""
    plain = raw.select("source", "crawl_batch", *[F.trim(text.text_or_blank(F.col(c))).alias(c) for c in ("title", "company", "location", "link")], F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "").alias("skills"))
    rows = plain.select(
        "source",
        text.make_source_job_id(F.col("link"), F.col("title"), F.col("company")).alias("source_job_id"),
        F.col("link").alias("job_link"),
        F.col("link").alias("job_url"),
        batch.clean_place(F.col("company")).alias("company_clean"),
        batch.clean_job_title(F.col("title")).alias("job_title_basic_clean"),
        batch.clean_place(F.col("location")).alias("location_basic_clean"),
        batch.clean_skills_list(F.col("skills")).alias("skills_basic_clean"),
        "crawl_batch",
    )
    # Within a batch the first of those with one id stays.
    rows = tables.keep_first(rows, ["crawl_batch", "source_job_id"], [F.col(c) for c in ("company_clean", "location_basic_clean", "skills_basic_clean", "job_title_basic_clean", "job_link", "source")])
    rows = rows.withColumn("occupation_group_preliminary", batch.occupation_group(batch.classification_text(F.col("job_title_basic_clean"), F.col("skills_basic_clean"), F.col("company_clean"))))
    rows = classify.canonical_titles(rows, taxonomy.TITLE_PATTERNS_BATCH, "occupation_group_preliminary", "job_title_basic_clean")
    rows = rows.withColumns(
        {
            "seniority": text.extract_seniority(F.col("job_title_basic_clean"), batch=True),
            "skills_canonical": batch.canonicalize_skills(F.col("skills_basic_clean")),
            "_place": location.clean_location_batch(F.col("location_basic_clean")),
            "occupation_group_final": text.or_default(F.col("occupation_group_preliminary"), rules.UNKNOWN),
        }
    )
    rows = rows.select("*", "_place.*").drop("_place")
    rows = rows.withColumn("occupation_family_final", classify.occupation_family(F.col("occupation_group_final"), rules.FAMILY_BATCH)).withColumn("skills_count_final", F.size("skills_canonical"))
    return rows.withColumns(tables.validity_flags(F.col("job_title_canonical"), F.col("skills_canonical"), F.col("location_basic_clean")))


def historical_silver(raw: DataFrame) -> DataFrame:
    """raw (source, title, company, location, link, skills string) through every step of the historical source."""
    rows = raw.select(
        "source",
        F.col("link").alias("source_job_id"),
        F.col("link").alias("job_link"),
        F.col("link").alias("job_url"),
        F.trim(text.text_or_blank(F.col("company"))).alias("company"),
        text.basic_clean_title(F.col("title")).alias("job_title_basic_clean"),
        text.split_basic_skills(F.col("skills")).alias("skills_basic_clean"),
        location.clean_city_country(F.col("location")).alias("_place"),
    ).select("*", "_place.*").drop("_place")
    rows = rows.withColumn("_p", classify.classify_preliminary(F.col("job_title_basic_clean"), F.col("skills_basic_clean"), taxonomy.TITLE_KEYWORDS, taxonomy.SKILL_KEYWORDS, rules.GENERIC_TITLES))
    rows = rows.select("*", F.col("_p.group").alias("occupation_group_preliminary"), F.col("_p.confidence").alias("occupation_confidence_preliminary"), F.col("_p.needs_review").alias("needs_review_preliminary")).drop("_p")
    rows = classify.canonical_titles(rows, taxonomy.TITLE_PATTERNS, "occupation_group_preliminary", "job_title_basic_clean")
    rows = rows.withColumn("seniority", text.extract_seniority(F.col("job_title_basic_clean"))).withColumn("skills_canonical", text.canonicalize_skills(F.col("skills_basic_clean"), taxonomy.SKILL_ALIASES))
    final = classify.classify_final(F.col("job_title_canonical"), F.col("skills_canonical"), F.col("occupation_group_preliminary"), F.col("occupation_confidence_preliminary"), taxonomy.GROUP_PATTERNS, taxonomy.GROUP_SKILLS, rules.FAMILY_HISTORICAL)
    rows = rows.withColumn("_f", final).select("*", F.col("_f.group").alias("occupation_group_final"), F.col("_f.family").alias("occupation_family_final"), F.col("_f.confidence").alias("occupation_confidence_final"), F.col("_f.method").alias("classification_method_final"), F.col("_f.needs_review").alias("needs_review_final")).drop("_f")
    return rows.withColumn("skills_count_final", F.size("skills_canonical"))


def gold(silver: DataFrame) -> DataFrame:
    """The Gold layer of either source: rows with a title and a skill, stripped texts, default places, the texts to encode, in the fixed order of
    columns; columns that a source doesn't have are blank."""
    rows = silver.withColumnRenamed("company_clean", "company") if "company" not in silver.columns else silver
    wanted = [c for c in GOLD if not c.endswith("_text") and c != "skills_count_final"]
    rows = tables.ensure_columns(rows, wanted)
    rows = tables.strip_text(rows, [c for c in wanted if c not in ("skills_canonical", "location_final")])
    rows = rows.withColumn("location_final", text.or_default(F.col("location_final"), "Unknown")).withColumn("skills_count_final", F.coalesce(F.size("skills_canonical"), F.lit(0)))
    # As one value that is kept or not: a condition by itself would be moved to where titles and skills are made, which would be made for it once more.
    kept = F.filter(F.array(F.struct(*rows.columns)), lambda r: (r["job_title_canonical"] != "") & (r["skills_count_final"] > 0))
    rows = rows.select(F.inline(kept))
    title, place, skills = F.col("job_title_canonical"), F.col("location_final"), F.col("skills_canonical")
    return rows.withColumns({"title_text": text.title_text(title), "skills_text": text.skills_text(skills), "full_text": text.full_text(title, place, skills)}).select(*GOLD)
