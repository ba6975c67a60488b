"""Expected values of single functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import enrich as E
from sievework.functions import score as S
from sievework.functions import tables as W
from sievework.functions import text as X
from sievework.schema import POSTING, conform, valid_rows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,period,lo,hi",
    [("100000-120000 EUR", "yearly", 96000, 115200), ("8000 USD", "monthly", 84480, 84480), ("50 GBP", "hourly", 116480, 116480), ("none", None, None, None), (None, None, None, None)],
)
def test_pay(spark, text, period, lo, hi):
    p = E.parse_pay(F.lit(text).cast("string"))
    got = one(spark, F.struct(E.annual_chf(p["lo"], p["currency"], F.lit(period).cast("string")), E.annual_chf(p["hi"], p["currency"], F.lit(period).cast("string"))))
    assert tuple(got) == (lo, hi)


def test_pay_columns(spark):
    rows = [("50000 EUR", "GBP", "yearly", None, None), (None, None, None, 90000, 110000)]
    df = spark.createDataFrame(rows, "salary_original string, salary_currency string, salary_period string, salary_min_chf int, salary_max_chf int")
    assert [tuple(r) for r in E.with_pay(df).select("salary_min_chf", "salary_max_chf").collect()] == [(56000, 56000), (90000, 110000)]


def test_fuzzy_hash(spark):
    base = one(spark, X.fuzzy_hash(F.lit("Python Developer"), F.lit("Acme")))
    for t, c in (("PYTHON developer", "acme"), ("Senior Python Developer", "Acme"), ("Python Developer (m/f/d)", "Acme"), ("Python Developer", "Acme AG")):
        assert one(spark, X.fuzzy_hash(F.lit(t), F.lit(c))) == base
    assert one(spark, X.normal_title(F.lit("Käufer/Verkäufer"))) == "käufer verkäufer"


def test_region(spark):
    names = {"zurich": "ZH", "ge": "GE", "geneva": "GE", "uri": "UR"}
    got = [one(spark, X.region_code(F.lit(t).cast("string"), names)) for t in ("8001 Zurich, Switzerland", "ge", "Berlin", None, "security")]
    assert got == ["ZH", "GE", None, None, "UR"]


def test_strings(spark):
    assert one(spark, X.strip_html(F.lit("<p>a <b>b</b>\n c</p>"))) == "a b c"
    assert one(spark, X.strip_html(F.lit(None).cast("string"))) == ""
    assert one(spark, X.url_identity(F.lit(""), F.lit(None).cast("string"), F.lit("s"), F.lit("h"))) == "s"
    assert one(spark, X.merge_tags(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("C")))) == ["A", "b", "C"]
    assert one(spark, X.regex_terms(F.lit("Python and python, Go"), ["python", r"\bgo\b"])) == ["Go", "Python"]
    assert one(spark, X.ngrams(F.array(F.lit("a"), F.lit("b")), 3)) == []
    assert one(spark, X.escape_markup(F.lit("<a&b>"))) == "&lt;a&amp;b&gt;"
    assert one(spark, X.escape_calendar(F.lit("a;b,c\n"))) == "a\\;b\\,c\\n"


def test_rules(spark):
    assert one(spark, E.seniority(F.lit(None).cast("string"), F.lit("International Buyer"))) == "intern"
    assert one(spark, E.seniority(F.lit("lead"), F.lit("Junior"))) == "lead"
    rules = {"A": ["translator"], "F": ["ngo"], "H": ["teacher"]}
    got = [one(spark, E.category(F.lit(t), F.array().cast("array<string>"), rules)) for t in ("Django Developer", "Translator and Teacher", "NGO officer")]
    assert got == ["otros", "A", "F"]
    titles = ("Softwareentwickler Zürich", "Développeur", "Sviluppatore però", "Cook", "Asesor económico", "Rôle", "Rôle ô", "Engineer/Developer", "Mitarbeiter*innen", "Krankenpfleger**", "œuvre")
    assert [one(spark, E.title_language(F.lit(t))) for t in titles] == ["de", "fr", "it", None, "it", None, None, None, "de", "de", "fr"]


def test_title_language_guesses(spark):
    cases = [("en", "en", 0.7, "en"), ("en", "en", 0.69, None), ("en", "es", 0.9, "es"), ("en", "nl", 0.99, None), ("de", "nl", 0.35, "nl"), ("de", "nl", 0.34, None), (None, "pt", 0.5, "pt"), ("EN", "nl", 0.99, None)]
    df = spark.createDataFrame(cases, "known string, lang string, prob double, want string")
    got = df.select("want", E.title_language(F.lit("Cook"), F.col("known"), F.struct("lang", "prob")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_rounded_as_stored(spark):
    values = [0.0, 2.675, 0.125, 0.375, 1.005, 0.005, 0.015, 2.5, 1e-9, 123456.785, 1e9 + 0.125, 0.994999, 0.995, 99.995] + [round(0.7 * a / 100 + 0.3 * b, 9) for a in range(1, 400, 7) for b in (0, 1, 5)]
    values += [0.7 * a / 100 + 0.3 * b for a in range(1, 900) for b in range(4)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["r"] for r in df.select(S.rounded(F.col("v")).alias("r")).collect()] == [round(v, 2) for v in values]


def test_profile_text(spark):
    skills = F.array(F.lit("a"), F.lit("b"))
    none = F.lit(None).cast("string")
    assert one(spark, X.profile_text(F.lit("T"), F.lit("cv\ntext"), skills)) == "T cv\ntext a b"
    assert one(spark, X.profile_text(F.lit(""), F.lit("x" * 900), F.array().cast("array<string>"))) == "x" * 900
    assert one(spark, X.profile_text(F.lit("T"), F.lit(""), skills)) is None and one(spark, X.profile_text(none, none, skills)) is None


def test_word_tables(spark):
    assert len(set(W.SKILLS)) == len(W.SKILLS) == 99 and len(W.CANTONS) == 70 and set(map(len, W.CANTONS.values())) == {2}
    assert one(spark, X.dictionary_terms(F.lit("AGILE teams use Scrum and a CRM in English"), W.SKILLS)) == ["english", "crm", "agile", "scrum"]
    assert one(spark, X.region_code(F.lit("Basel-Landschaft"), W.CANTONS)) == "BL" and one(spark, X.region_code(F.lit("4001 Basel-Stadt CH"), W.CANTONS)) == "BS"
    assert one(spark, X.regex_terms(F.lit("CELTA and tesol, L&D; SEN"), W.CV_PATTERNS)) == ["CELTA", "L&D", "SEN", "tesol"]


def test_scores(spark):
    n = F.lit(None).cast("int")
    pay = lambda *v: one(spark, S.pay_score(*[n if x is None else F.lit(x) for x in v]))
    assert pay(80000, 100000, 90000, 120000) == 1.0 and pay(None, None, 1, 2) == 0.5 and pay(1, 2, None, None) == 0.5
    loc = lambda w, x: one(spark, S.location_score(F.array(*map(F.lit, w)).cast("array<string>"), F.lit(x).cast("string")))
    assert [loc(["Zurich"], "Zurich, Switzerland"), loc(["Zurich"], None), loc(["Zurich"], "Geneva"), loc([], "x")] == [1.0, 0.3, 0.0, 0.5]
    assert [one(spark, S.recency_score(F.lit(d))) for d in (0, 60)] == [1.0, 0.1]
    weights = F.create_map(*[x for k in S.DEFAULT_WEIGHTS for x in (F.lit(k), F.lit(1.0 if k == "embedding" else 0.0))])
    assert one(spark, S.final_score({"embedding": F.lit(0.5)}, weights)) == 50.0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, S.days_old(F.lit(datetime(2024, 1, 3, 1)), F.lit(datetime(2024, 1, 1, 2)))) == 1


@pytest.mark.parametrize(
    "tier,days,text,policy,want",
    [("A", 30, "", None, 30), ("B", 30, "", None, 15), ("C", 30, "", None, 0), ("C", 0, "", None, 15), ("C", 3, "", None, 10), ("C", 30, "start immediately", None, 20), ("C", 30, "Deadline: 2024-01-31", None, 10), ("A", 0, "urgent, apply by 1.2.2024", None, 75), ("A", 30, "", "portal_only", 20), (None, 0, "urgent", None, 0)],
)
def test_urgency(spark, tier, days, text, policy, want):
    assert one(spark, S.urgency(F.lit(tier).cast("string"), F.lit(days), F.lit(text), F.lit(policy).cast("string"))) == want


def test_budget(spark):
    pages = lambda avg, boot: one(spark, S.page_budget(F.lit(float(avg)), F.lit(20), F.lit(boot), 10))
    assert [pages(3, True), pages(45, True), pages(500, True), pages(3, False)] == [2, 4, 10, 10]
    runs = lambda streak, gap: one(spark, S.should_run(F.lit(streak), F.lit(gap), 6.0))
    assert [runs(3, 6.0), runs(3, 12.0), runs(2, 0.0)] == [False, True, True]


def test_conform(spark):
    df = spark.createDataFrame([("h", "s", "t", "c", "u", 1), ("h", "s", " ", "c", "u", 2)], "hash string, source string, title string, company string, url string, odd int")
    good, bad = valid_rows(conform(df))
    assert good.columns == POSTING.names and good.count() == 1 and bad.count() == 1


def test_clean_cv(spark):
    raw = 'Ready! "C++" [x=1] 5\u20ac \u041f\u0440\u0438? \tÄ\u0142\n\n\n\nend  '
    got = spark.createDataFrame([(raw,), (None,), (" \n ",)], "t string").select(X.clean_cv(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == ['Ready! "C++" [x=1] 5 ? Ä\u0142\n\nend', None, ""]
