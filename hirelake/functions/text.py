"""Text, list and similarity functions, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import rules

NULL_TOKENS = ["", "nan", "none", "null"]


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text_basic(c: Column) -> Column:
    """Null to blank, lower case, runs of white space to one space."""
    return collapse(F.lower(text_or_blank(c)))


def null_token_to_blank(c: Column) -> Column:
    t = F.trim(text_or_blank(c))
    return F.when(F.lower(t).isin(NULL_TOKENS), "").otherwise(t)


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_list(values: Iterable[str]) -> Column:
    """An array of strings. Written as one SQL literal, as a call for each string takes longer than the query."""
    return F.expr(f"array({', '.join(map(sql_string, values))})").cast("array<string>")


def literal_map(values: Mapping[str, str]) -> Column:
    return F.expr(f"map({', '.join(sql_string(x) for kv in values.items() for x in kv)})")


def alias(c: Column, values: Mapping[str, str], otherwise: Column | None = None) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), c), c if otherwise is None else otherwise)


def basic_clean_title(c: Column) -> Column:
    """Basic cleaning, noise words out one after the other, letters that technical titles need, aliases by word."""
    t = clean_text_basic(c)
    for pattern in rules.TITLE_NOISE:
        t = F.regexp_replace(t, pattern, " ")
    t = collapse(F.regexp_replace(t, r"[^a-z0-9+#./\-\s]", " "))
    return F.array_join(F.transform(F.split(t, " "), lambda w: alias(w, rules.TITLE_ALIASES)), " ")


def split_basic_skills(c: Column) -> Column:
    parts = F.transform(F.split(F.lower(text_or_blank(c)), r"[,;|]\s*"), lambda s: collapse(F.regexp_replace(s, r"[^a-z0-9+#./\-\s]", " ")))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


# Items of a list literal: strings in either quotes, with escapes, and plain constants; and a whole list, tuple or set of them.
_SINGLE, _DOUBLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ITEM = rf"(?s:{_SINGLE}|{_DOUBLE}|[-+]?\d++(?:\.\d*+)?|None|True|False)"
_SOME = rf"\s*+{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+,?\s*+"
LITERAL = rf"^(?:\[(?:{_SOME}|\s*+)\]|\((?:{_SOME}|\s*+)\)|\{{{_SOME}\}})$"


def is_list_literal(t: Column) -> Column:
    """Whether a stripped text is a list, tuple or set of constants. A single constant in parentheses is none, as it has no comma."""
    return t.rlike(LITERAL) & ~t.rlike(rf"^\(\s*+{_ITEM}\s*+\)$")


def _unescaped(item: Column) -> Column:
    """What a quoted string says; other constants are their own text."""
    inner = F.regexp_replace(item, r"(?s)^(['\"])(.*)\1$", "$2")
    plain = F.regexp_replace(F.replace(inner, F.lit("\\\\"), F.lit("\u0000")), r"\\n", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\\t", "\t"), r"\\(['\"])", "$1")
    return F.when(item.rlike(r"^['\"]"), F.replace(plain, F.lit("\u0000"), F.lit("\\"))).otherwise(item)


def list_items(t: Column) -> Column:
    """The items of a list literal as texts, in order."""
    return F.transform(F.regexp_extract_all(t, F.lit(f"({_ITEM})"), 1), _unescaped)


def _kept(items: Column, clean: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(items, clean), lambda s: s != "")


def parse_skills(c: Column, by_comma: bool = True, lower: bool = False) -> Column:
    """The skills that a text spells: the items of a list literal, else, with `by_comma`, what stands between its commas, else the text itself; a null token or an
    empty list gives none. Items are stripped; blank ones go. With `by_comma` white space in a literal's items becomes one space, and `lower` lower-cases all."""
    t = F.trim(text_or_blank(c))
    case = F.lower if lower else (lambda x: x)
    item = (lambda s: case(collapse(s))) if by_comma else (lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b")))
    plain = _kept(F.split(t, ","), lambda s: case(F.trim(s))) if by_comma else F.array(t)
    none = F.lower(t).isin([*NULL_TOKENS, "[]"])
    return F.when(none, F.array().cast("array<string>")).when(is_list_literal(t), _kept(list_items(t), item)).otherwise(plain)


def skill_list(skills: Column) -> Column:
    """An array of skills, its items as texts, stripped, blank and null ones gone; null is an empty list."""
    return F.coalesce(F.filter(F.transform(skills.cast("array<string>"), lambda s: F.trim(text_or_blank(s))), lambda s: s != ""), F.array().cast("array<string>"))


def narrow_skills(c: Column) -> Column:
    """The narrow variant: only a list literal counts as a list, its items stay as they are; anything else that isn't null is one skill."""
    t = F.trim(c.cast("string"))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(is_list_literal(t) & t.startswith("["), list_items(t)).when(is_list_literal(t), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def basic_clean_location(c: Column) -> Column:
    return F.replace(clean_text_basic(c), F.lit("|"), F.lit(","))


def make_source_job_id(link: Column, title: Column, company: Column) -> Column:
    return F.md5(F.trim(F.lower(F.concat_ws("|", text_or_blank(link), text_or_blank(title), text_or_blank(company)))).cast("binary"))


def title_case(c: Column) -> Column:
    """A capital after every character that isn't a letter."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def first_rule(c: Column, ruleset: Iterable[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found."""
    out = None
    for label, pattern in ruleset:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def extract_seniority(title: Column, batch: bool = False) -> Column:
    return first_rule(F.lower(text_or_blank(title)), rules.SENIORITY_BATCH if batch else rules.SENIORITY, "Not specified")


def is_noise_skill(s: Column, most_words: int = 7) -> Column:
    t = F.lower(s)
    noise = (F.length(t) <= 1) | (F.size(F.split(t, r"\s+")) > most_words) | t.isin(NULL_TOKENS)
    for p in rules.SKILL_NOISE:
        noise = noise | t.rlike(p)
    return noise


def canonicalize_skill(s: Column, aliases: Mapping[str, str], keep_case: bool = False, marks: str = "[#+./]") -> Column:
    t = F.lower(F.trim(s))
    return alias(t, aliases, F.when(t.rlike(marks), F.trim(s) if keep_case else t).otherwise(title_case(t)))


def canonicalize_skills(skills: Column, aliases: Mapping[str, str]) -> Column:
    kept = F.filter(skills, lambda s: ~is_noise_skill(s))
    return F.array_distinct(F.transform(kept, lambda s: canonicalize_skill(s, aliases)))


def skills_to_text(skills: Column) -> Column:
    return F.when(F.coalesce(F.size(skills), F.lit(0)) > 0, F.array_join(skills, ", ")).otherwise("Not specified")


def or_default(c: Column, default: str) -> Column:
    t = F.trim(text_or_blank(c))
    return F.when(t == "", default).otherwise(t)


def title_text(title: Column) -> Column:
    return F.concat(F.lit("Job title: "), or_default(title, "Not specified"), F.lit("."))


def skills_text(skills: Column) -> Column:
    return F.concat(F.lit("Required skills: "), skills_to_text(skills), F.lit("."))


def full_text(title: Column, location: Column, skills: Column) -> Column:
    return F.concat(title_text(title), F.lit(" Location: "), or_default(location, "Unknown"), F.lit(". "), skills_text(skills))


def normalize_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_blank(c)), r"[^a-z0-9+#.]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalize_token(c), " ")), lambda t: t != "")


def set_similarity(x: Column, y: Column) -> Column:
    """The larger of Jaccard and the share of x that y has, of two lists without repeats."""
    both = F.size(F.array_intersect(x, y))
    score = F.greatest(both / (F.size(x) + F.size(y) - both), both / F.size(x))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(score)


def text_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and the share of a's tokens that b has."""
    return set_similarity(tokens(a), tokens(b))


def skill_keys(skills: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(skills, normalize_token), lambda s: s != ""))


def set_overlap(x: Column, y: Column) -> Column:
    """The share of x that y has."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def skill_overlap(user: Column, job: Column) -> Column:
    return set_overlap(skill_keys(user), skill_keys(job))


def place_score(u: Column, j: Column, x: Column, y: Column) -> Column:
    """Of two places' normalized texts and their tokens."""
    share = F.least(F.lit(0.6), F.size(F.array_intersect(x, y)) / F.size(x))
    return F.when((u == "") | (j == "") | (j == "unknown"), 0.0).when(u == j, 1.0).when(F.contains(u, j) | F.contains(j, u), 0.8).otherwise(share)


def location_score(user: Column, job: Column) -> Column:
    return place_score(normalize_token(user), normalize_token(job), tokens(user), tokens(job))


def safe_score(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def score_percent(c: Column) -> Column:
    return F.least((safe_score(c) * 100).cast("int"), F.lit(100))


def score_band(c: Column) -> Column:
    return F.when(score_percent(c) >= 70, "high").when(score_percent(c) >= 40, "medium").otherwise("low")


def profile_from_json(c: Column, fields: str) -> Column:
    """What a model answered, as a struct of `fields`: the whole text if it is one JSON object, else its outermost block in braces. Null where
    neither is an object."""
    whole = F.btrim(text_or_blank(c), F.lit(" \t\n\r"))
    block = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(json_kind(whole) == "object", F.from_json(whole, fields)).when((json_kind(whole) == "") & (json_kind(block) == "object"), F.from_json(block, fields))


def json_kind(c: Column) -> Column:
    """object, array or value for one JSON value and nothing after it, blank for anything else, objects that repeat a key among it."""
    # In brackets and in braces: what follows a value would close one of them early, be a second element, or be an error.
    item, field = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    one = F.try_variant_get(item, "$[0]", "variant").isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull() & field.isNotNull()
    start = F.left(F.btrim(c, F.lit(" \t\n\r")), F.lit(1))
    return F.when(~F.coalesce(one, F.lit(False)), "").when(start == "{", "object").when(start == "[", "array").otherwise("value")


def first_non_blank(*cols: Column, default: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(default))


def squeeze_text(c: Column, most: int | None = 12_000) -> Column:
    """Three newlines or more to two, runs of blanks to one, stripped; at most `most` characters, all for None."""
    t = F.regexp_replace(F.regexp_replace(text_or_blank(c), r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    t = F.btrim(t, F.lit(" \t\n\r"))
    return t if most is None else F.substring(t, 1, most)
