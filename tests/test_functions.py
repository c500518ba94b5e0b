import pytest
from pyspark.sql import functions as F

from hirelake.functions import location, text


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "made,expected",
    [
        (lambda: text.basic_clean_title(F.lit("Sr. Dev (Remote) - C++ / .NET")), "sr. developer - c++ / .net"),
        (lambda: text.split_basic_skills(F.lit("Node.js, SQL; sql|C#")), ["node.js", "sql", "c#"]),
        (lambda: text.make_source_job_id(F.lit("link"), F.lit("title"), F.lit("co")), "20e0a59869f14330aa52557341e19a89"),
        (lambda: text.title_case(F.lit("o'neil c-level node.js")), "O'Neil C-Level Node.Js"),
        (lambda: text.extract_seniority(F.lit("lead intern")), "Intern"),
        (lambda: text.is_noise_skill(F.lit("5+ years java")), True),
        (lambda: text.is_noise_skill(F.lit("c")), True),
        (lambda: text.is_noise_skill(F.lit("sql")), False),
        (lambda: text.canonicalize_skills(F.array(*map(F.lit, ["excel", "ms excel", "r&d", "go/rust"])), {"excel": "Microsoft Excel", "ms excel": "Microsoft Excel"}), ["Microsoft Excel", "R&D", "go/rust"]),
        (lambda: text.text_similarity(F.lit("Data Analyst"), F.lit("Senior Data Analyst")), 1.0),
        (lambda: text.skill_overlap(F.array(F.lit("SQL"), F.lit("Excel")), F.array(F.lit("sql"), F.lit("Python"))), 0.5),
        (lambda: text.location_score(F.lit("Hanoi, Vietnam"), F.lit("Vietnam")), 0.8),
        (lambda: text.location_score(F.lit("Hanoi, Vietnam"), F.lit("Da Nang, Vietnam")), 0.5),
        (lambda: text.parse_skills(F.lit("['a', 'b', 'a']")), ["a", "b", "a"]),
        (lambda: text.parse_skills(F.lit("nan")), []),
        (lambda: text.safe_score(F.lit("x")), 0.0),
        (lambda: text.squeeze_text(F.lit(" a  b\n\n\n\nc ")), "a b\n\nc"),
    ],
)
def test_text(spark, made, expected):
    assert value(spark, made()) == expected


@pytest.mark.parametrize("place,expected", [
    ("Remote, Austin, TX", ("Austin", "United States", "Austin, United States")), (None, ("", "", "Unknown")), ("", ("", "", "Unknown")), ("Paris", ("Paris", "", "Paris")),
    ("Hybrid | London; U.K.", ("London", "United Kingdom", "London, United Kingdom")), ("o'fallon, mo", ("O'Fallon", "United States", "O'Fallon, United States")),
    ("Anywhere - Toronto, Canada", ("Toronto", "Canada", "Toronto, Canada")), ("none, Germany", ("", "Germany", "Germany")),
])
def test_city_country(spark, place, expected):
    assert tuple(value(spark, location.clean_city_country(F.lit(place).cast("string")))) == expected


@pytest.mark.parametrize("place,expected", [("HCM", ("Ho Chi Minh", "Unknown", "Ho Chi Minh, Unknown")), ("District 1, HCMC, Vietnam", ("Ho Chi Minh", "Vietnam", "Ho Chi Minh, Vietnam")),
    ("Vietnam", ("Unknown", "Vietnam", "Unknown, Vietnam")), ("Hanoi - Vietnam", ("Hanoi", "Vietnam", "Hanoi, Vietnam")), ("", ("Unknown", "Unknown", "Unknown")), ("nan", ("Unknown", "Unknown", "Unknown")),
    ("Da Nang, Somewhere", ("Da Nang", "Somewhere", "Da Nang, Somewhere")), ("Germany, Berlin", ("Berlin", "Germany", "Berlin, Germany")),
])
def test_location_batch(spark, place, expected):
    assert tuple(value(spark, location.clean_location_batch(F.lit(place)))) == expected


@pytest.mark.parametrize("t,base,comma", [
    ("""["it's", 'b']""", ["it's", "b"], ["it's", "b"]), ("""('a', "say \\"hi\\"",)""", ["a", 'say "hi"'], ["a", 'say "hi"']), ("['a, b', 'c']", ["a, b", "c"], ["a, b", "c"]),
    ("{'x'}", ["x"], ["x"]), ("{'x', 'y'}", ["x", "y"], ["x", "y"]), ("[]", [], []), ("nan", [], []), (" None ", [], []), ("", [], []), (None, [], []), ("()", [], []), ("[1, 2.5, None]", ["1", "2.5", "None"], ["1", "2.5", "None"]),
    ("['a', ' ', 'b  c']", ["a", "b  c"], ["a", "b c"]), ("['a'", ["['a'"], ["['a'"]), ("a, b,, c", ["a, b,, c"], ["a", "b", "c"]), ("SQL", ["SQL"], ["SQL"]), ("('a')", ["('a')"], ["('a')"]), ("['a' 'b']x", ["['a' 'b']x"], ["['a' 'b']x"]),
    (r"['back\\slash', 'it\'s']", ["back\\slash", "it's"], ["back\\slash", "it's"]), ("[a, b]", ["[a, b]"], ["[a", "b]"]),
])
def test_list_literals(spark, t, base, comma):
    """Every form of the skills column; what is expected follows the language's own literals."""
    c = F.lit(t).cast("string")
    assert value(spark, text.parse_skills(c, by_comma=False)) == base
    assert value(spark, text.parse_skills(c)) == comma
    assert value(spark, text.parse_skills(c, lower=True)) == [x.lower() for x in comma]


def test_literals_like_the_languages_own(spark):
    """Random lists and tuples, written out and read back."""
    import ast
    import random

    rng = random.Random(1)
    made = []
    for _ in range(300):
        items = ["".join(rng.choice("ab,'\"[]() \\") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 4))]
        made.append(repr(items if rng.random() < 0.5 else tuple(items)))
    df = spark.createDataFrame([(t,) for t in made], "t string").select("t", text.parse_skills(F.col("t"), by_comma=False).alias("p"))
    for r in df.collect():
        assert r["p"] == [s for x in ast.literal_eval(r["t"]) if (s := x.strip())], r["t"]


def test_skill_lists_and_the_narrow_variant(spark):
    assert value(spark, text.skill_list(F.array(F.lit(" a "), F.lit(None), F.lit(" "), F.lit("b")))) == ["a", "b"]
    assert value(spark, text.skill_list(F.lit(None).cast("array<string>"))) == [] and value(spark, text.skill_list(F.array(F.lit(1), F.lit(2)))) == ["1", "2"]
    for t, want in (("['a', ' b']", ["a", " b"]), ("('a', 'b')", []), ("a, b", ["a, b"]), ("", [""]), (None, [])):
        assert value(spark, text.narrow_skills(F.lit(t).cast("string"))) == want


def test_score_bands(spark):
    assert [value(spark, text.score_band(F.lit(x))) for x in (0.7, 0.699, 0.4, 0.39, None)] == ["high", "medium", "medium", "low", "low"]


def test_profiles_from_answers(spark):
    cases = {
        '{"k": 1, "title": "a"}': (1, "a"),
        ' {"k":1}\n': (1, None),
        '\n\t{"k":3}': (3, None),
        'Here: {"k":2,"title":"x } y"} as asked': (2, "x } y"),
        '{"k": {"a": 1}} t': (None, None),
        "{} ,null": (None, None),
        '{"k":1}]': (1, None),
        '{"k":1}} {': None,
        '{"k":1}] {"k":2}': None,
        '{"k":1} or {"k":2}': None,
        '{"k":1},{"k":2}': None,
        '[{"k":1}]': None,
        '{"k":1,}': None,
        "3": None,
        "null": None,
        "nothing": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(x,) for x in cases], "c string").select("c", text.profile_from_json(F.col("c"), "k long, title string").alias("p"))
    assert {r["c"]: r["p"] and tuple(r["p"]) for r in df.collect()} == cases
    kinds = spark.createDataFrame([(x,) for x in ('{"a":1}', "[1]", "2", "null", '"{"', "{", '{"a":1}}', '{"a":1}]', "1,2", "")], "c string").select(text.json_kind(F.col("c")))
    assert [r[0] for r in kinds.collect()] == ["object", "array", "value", "value", "value", "", "", "", "", ""]
