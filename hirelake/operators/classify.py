"""Occupation groups from keyword and pattern rules. Rule lists are parameters, compiled to literals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.rules import UNKNOWN
from hirelake.functions.text import first_rule, literal_list, literal_map, title_case


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it. Scores of many keywords are large expressions; written out at every use they
    would take longer to plan than to run."""
    return F.transform(F.array(value), f)[0]


def title_score(title: Column, keywords: Sequence[str]) -> Column:
    return F.when(F.exists(literal_list(keywords), lambda k: F.contains(title, k)), 1.0).otherwise(0.0)


def joined_skills(skills: Column) -> Column:
    return F.lower(F.array_join(skills, " "))


def skill_score(joined: Column, keywords: Sequence[str]) -> Column:
    """A third for each keyword that the joined skills hold, 1 at most."""
    return F.least(F.size(F.filter(literal_list(keywords), lambda k: F.contains(joined, k))) / 3.0, F.lit(1.0))


def best_group(scores: Sequence[tuple[str, Column]]) -> Column:
    """struct(score, order, group) of the highest score, the earliest group among equals."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("group")) for i, (g, s) in enumerate(scores)]))


def classify_preliminary(title: Column, skills: Column, title_rules: Mapping[str, Sequence[str]], skill_rules: Mapping[str, Sequence[str]], generic: Sequence[str], least: float = 0.65) -> Column:
    """struct(group, confidence, method, needs_review); a generic title counts less than the skills."""
    weight = F.when(F.trim(title).isin(list(generic)), 0.25).otherwise(0.70)
    best = bound(F.struct(title.alias("t"), joined_skills(skills).alias("s"), weight.alias("w")), lambda x: best_group([(g, x["w"] * title_score(x["t"], title_rules[g]) + (1 - x["w"]) * skill_score(x["s"], skill_rules.get(g, ()))) for g in title_rules]))

    def told(b: Column) -> Column:
        none = b["score"] == 0
        return F.struct(F.when(none, UNKNOWN).otherwise(b["group"]).alias("group"), F.round(b["score"], 4).alias("confidence"), F.when(none, "no_match").otherwise("title_skill_rule").alias("method"), (none | (b["score"] < least)).alias("needs_review"))

    return bound(best, told)


def classify_cascade(text: Column, ruleset: Sequence[tuple[str, str]]) -> Column:
    return first_rule(F.lower(text), ruleset, UNKNOWN)


def classify_final(title: Column, skills: Column, preliminary: Column, confidence: Column, patterns: Mapping[str, Sequence[str]], skill_rules: Mapping[str, Sequence[str]], families: Mapping[str, str], least: float = 0.65) -> Column:
    """struct(group, family, confidence, method, needs_review): patterns on the title and skills; without any hit a
    known preliminary group stays."""
    best = bound(F.struct(F.lower(title).alias("t"), joined_skills(skills).alias("s")), lambda x: best_group([(g, F.when(x["t"].rlike("|".join(p)), 0.75).otherwise(0.0) + 0.25 * skill_score(x["s"], skill_rules.get(g, ()))) for g, p in patterns.items()]))

    def told(x: Column) -> Column:
        hit, known = x["b"]["score"] > 0, x["p"] != UNKNOWN
        group = F.when(hit, x["b"]["group"]).when(known, x["p"]).otherwise(UNKNOWN)
        sure = F.when(hit, x["b"]["score"]).when(known, x["c"]).otherwise(0.0)
        method = F.when(hit, "final_title_skill_rule").when(known, "keep_preliminary").otherwise("no_match")
        return F.struct(group.alias("group"), occupation_family(group, families).alias("family"), F.round(sure, 4).alias("confidence"), method.alias("method"), (sure < least).alias("needs_review"))

    return bound(F.struct(best.alias("b"), preliminary.alias("p"), confidence.alias("c")), told)


def occupation_family(group: Column, families: Mapping[str, str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(families), F.when(F.trim(group) == "", UNKNOWN).otherwise(group)), F.lit(UNKNOWN))


RULE = "group string, rank int, pattern string, canonical string, function_group string"


def title_rules(spark: SparkSession, patterns: Mapping[str, Sequence[tuple[str, str, str]]]) -> DataFrame:
    """The title patterns as a table: (group, rank, pattern, canonical, function_group), ranked within their group."""
    return spark.createDataFrame([(g, i, *rule) for g, rules in patterns.items() for i, rule in enumerate(rules)], RULE)


#: The most rows of a rule table, which is broadcast.
MOST_RULES = 10_000


def first_hits(rows: DataFrame, rules: DataFrame, group: str, text: str) -> DataFrame:
    """(group, text, rank, canonical, function_group): for each distinct pair of rows, the lowest-ranked rule of its group whose pattern is found. Patterns
    meet distinct texts only, inside a broadcast join; more rules than MOST_RULES are an error."""
    few = rules.limit(MOST_RULES + 1)
    if few.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    keys = rows.select(group, text).distinct()
    rule = few.select(F.col("group").alias("_group"), F.col("pattern").alias("_pattern"), F.struct("rank", "canonical", "function_group").alias("_rule"))
    met = keys.join(F.broadcast(rule), (keys[group] == F.col("_group")) & F.regexp_like(keys[text], F.col("_pattern")))
    return met.groupBy(group, text).agg(F.min("_rule").alias("_rule")).select(group, text, "_rule.*")


def canonical_titles(rows: DataFrame, patterns: Mapping[str, Sequence[tuple[str, str, str]]], group: str, title: str) -> DataFrame:
    """rows with job_title_canonical and function_group: those of the first pattern of the row's group that its lower-cased title meets, else the
    title itself in title case and Other; a blank title stays blank. The patterns are literals, so a row meets them where it is: none is moved or made twice."""

    def hit(x: Column) -> Column:
        out = None
        for g, rules in patterns.items():
            first = None
            for pattern, canonical, function_group in rules:
                told = F.struct(F.lit(canonical).alias("canonical"), F.lit(function_group).alias("function_group"))
                first = (F if first is None else first).when(x["l"].rlike(pattern), told)
            if first is not None:
                out = (F if out is None else out).when(x["g"] == g, first)
        own = F.struct(title_case(x["t"]).alias("canonical"), F.lit("Other").alias("function_group"))
        return own if out is None else F.coalesce(out, own)

    plain = F.trim(F.coalesce(title, F.lit("")))
    told = rows.withColumn("_hit", bound(F.struct(F.col(group).alias("g"), plain.alias("t"), F.lower(plain).alias("l")), hit))
    return told.select(*rows.columns, F.col("_hit.canonical").alias("job_title_canonical"), F.col("_hit.function_group").alias("function_group"))
