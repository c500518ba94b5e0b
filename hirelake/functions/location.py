"""City and country from free-text locations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import rules
from hirelake.functions.text import NULL_TOKENS, clean_text_basic, literal_map, null_token_to_blank, text_or_blank, title_case


def location_parts(c: Column) -> Column:
    t = F.translate(clean_text_basic(c), "|;", ",,")
    for word in rules.LOCATION_NOISE:
        t = F.replace(t, F.lit(word), F.lit(""))
    parts = F.split(F.btrim(t, F.lit(" ,-/")), ",")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ,-/"))), lambda p: p != "")


def country_of(part: Column) -> Column:
    """A part's country, null if it names none; states name the United States."""
    p = F.replace(part, F.lit("."), F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(rules.COUNTRIES), p), F.when(p.isin([*rules.STATE_CODES, *rules.STATE_NAMES]), "United States"))


def clean_city_country(c: Column) -> Column:
    """struct(city_clean, country_clean, location_final): the country from the right, the city from the left."""
    parts = location_parts(c)
    country = F.coalesce(F.try_element_at(F.array_compact(F.transform(F.reverse(parts), country_of)), F.lit(1)), F.lit(""))
    city = F.coalesce(title_case(F.try_element_at(F.filter(parts, lambda p: country_of(p).isNull() & ~p.isin(NULL_TOKENS)), F.lit(1))), F.lit(""))
    return located(city, country)


def located(city: Column, country: Column) -> Column:
    both = F.array_join(F.filter(F.array(city, country), lambda x: x != ""), ", ")
    return F.struct(city.alias("city_clean"), country.alias("country_clean"), F.when(both == "", "Unknown").otherwise(both).alias("location_final"))


def clean_location_batch(c: Column) -> Column:
    """The incremental variant: the first country from the left, the city just before it; without a country
    the first part is the city and the last the country."""
    t = F.replace(F.translate(null_token_to_blank(c), "|;", ",,"), F.lit(" - "), F.lit(","))
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
    find = lambda p: F.try_element_at(literal_map(rules.COUNTRIES_BATCH), F.lower(p))
    city_name = lambda p: F.coalesce(F.try_element_at(literal_map(rules.CITIES_BATCH), F.lower(p)), title_case(p))
    flags = F.transform(parts, lambda p: find(p).isNotNull())
    at = F.array_position(flags, F.lit(True)).cast("int")
    n, one = F.size(parts), F.try_element_at(parts, F.lit(1))
    country = F.when(n == 0, "Unknown").when(n == 1, F.coalesce(find(one), F.lit("Unknown"))).when(at > 0, find(F.try_element_at(parts, at))).otherwise(title_case(F.try_element_at(parts, F.lit(-1))))
    city = F.when((n == 0) | ((n == 1) & (at > 0)), "Unknown").when((n == 1) | (at != 1), city_name(F.when(at > 1, F.try_element_at(parts, at - 1)).otherwise(one))).otherwise(city_name(F.try_element_at(parts, F.lit(2))))
    whole = F.when((city == "Unknown") & (country == "Unknown"), "Unknown").otherwise(F.concat_ws(", ", city, country))
    return F.struct(city.alias("city_clean"), country.alias("country_clean"), whole.alias("location_final"))


def default_location(c: Column) -> Column:
    t = F.trim(text_or_blank(c))
    return F.when(t == "", "Unknown").otherwise(t)
