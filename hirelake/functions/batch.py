"""Cleaning of the incremental source's postings and of profiles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import rules, text


def clean_job_title(c: Column) -> Column:
    """Dashes and separators made alike, recruiting and office words out in their order, the case kept."""
    t = F.replace(F.translate(text.null_token_to_blank(c), "\u2013\u2014|", "-- "), F.lit("/"), F.lit(" / "))
    t = text.collapse(t)
    for pattern in rules.BATCH_TITLE_NOISE:
        t = F.regexp_replace(t, "(?i)" + pattern, "")
    return F.btrim(text.collapse(t), F.lit(rules.TITLE_ENDS))


def clean_place(c: Column) -> Column:
    """A company or a location: null tokens to blank, white space to one space."""
    return text.collapse(text.null_token_to_blank(c))


def clean_skill(c: Column) -> Column:
    return text.alias(clean_place(c), rules.SKILL_SPELLINGS)


def clean_skills_list(skills: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(skills, clean_skill), lambda s: s != ""))


def canonicalize_skills(skills: Column) -> Column:
    """Noise out (up to eight words), aliases by the lower-cased name, technical names in their own case."""
    kept = F.filter(F.transform(skills, clean_place), lambda s: ~text.is_noise_skill(s, most_words=8))
    return F.array_distinct(F.transform(kept, lambda s: text.canonicalize_skill(s, rules.SKILL_ALIASES_BATCH, keep_case=True, marks="[#+./-]")))


def classification_text(title: Column, skills: Column, company: Column) -> Column:
    return F.lower(F.concat_ws(" ", text.text_or_blank(title), F.array_join(skills, " "), text.text_or_blank(company)))


def occupation_group(whole: Column) -> Column:
    return text.first_rule(whole, rules.BATCH_GROUPS, rules.UNKNOWN)


def profile_skills(skills: Column) -> Column:
    """A profile's skills: white space to one space, aliases by the lower-cased name, the first of each kept."""
    plain = F.filter(F.transform(skills, lambda s: text.collapse(text.text_or_blank(s))), lambda s: s != "")
    return F.array_distinct(F.transform(plain, lambda s: text.alias(F.lower(s), rules.PROFILE_ALIASES, s)))


def profile_field(c: Column) -> Column:
    return text.or_default(text.collapse(text.text_or_blank(c)), "Unknown")
