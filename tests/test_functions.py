"""Scalar rules against tables of expected values."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import grounding, naming, qualifiers, text, units

# The forms of the labels are fixed by the rule; the years are ours.
PERIODS = {
    "FY19": "2019",
    "FY2011-12": "2012",
    "2017-18": "2018",
    "FY'07": "2007",
    "year ended June 30, 2015": "2015",
    "June 30, 2014": "2014",
    "Q1 FY18": "2018Q1F",
    "Q2 FY2011-12": "2012Q2F",
    "2016Q3": "2016Q3C",
    "FY2019/20": "2020",
    "H2 FY13": "2013H2F",
    "six months ended September 30, 2010": "2010PARTIAL",
    "2003-07-31": "2007",
    "1899-00": "1899",
    "FY88": "2088",
    "Q2FY17": "2017",
    "4100 boxes": "4100",
    "none stated": None,
    "": None,
    None: None,
}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def mapped(spark, values, f, kind="string"):
    return [r.x for r in column(spark, values, kind).select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_periods(spark):
    assert mapped(spark, list(PERIODS), qualifiers.normalise_period) == list(PERIODS.values())


def test_keys(spark):
    given_keys = ["as of", "as_of", "as_of_date", "As Of", "reporting period", "Fiscal Year", "  ", "basis", None]
    assert mapped(spark, given_keys, qualifiers.normalise_key) == ["as_of"] * 4 + ["period", "period", "", "basis", None]


def test_units(spark):
    rows = column(spark, ["₹ million", "Rupees in millions", "37 Cr", "crores", None, "", "% of votes", "2.6 Mn Tons", "us$"]).select("i", units.parse_unit(F.col("v")).alias("u")).orderBy("i").collect()
    assert [r.u.dimension for r in rows] == ["currency", "currency", "count", "magnitude", "unknown", "unknown", "ratio", "mass", "currency"]
    assert [r.u.magnitude for r in rows][:4] == [1e6, 1e6, 1e7, 1e7]
    assert [r.u.currency for r in rows][:2] == ["INR", "INR"] and rows[-1].u.currency == "USD" and rows[-1].u.residual == "us"


@pytest.mark.parametrize(("value", "magnitude", "want"), [(20417.63, 1e6, 5000.0), (2042.0, 1e7, 5e6), (5170.0, 1.0, 5.0), (0.0, 10.0, 5.0), (7.4, 1.0, 0.05), (-2.9, 1.0, 0.05), (300.0, 1.0, 50.0)])
def test_tolerance(spark, value, magnitude, want):
    assert spark.range(1).select(units.precision_tolerance(F.lit(value), F.lit(magnitude)).alias("t")).first().t == pytest.approx(want, rel=1e-12)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=20), st.integers(0, 4))
def test_tolerance_is_half_of_the_last_place(spark, numbers, places):
    values = [int(f"{n}7"[-9:]) / 10**places for n in numbers]  # the last digit is a 7, so it is printed
    found = mapped(spark, values, lambda v: units.precision_tolerance(v, F.lit(1.0)), "double")
    assert found == pytest.approx([0.5 * 10.0**-places] * len(values), rel=1e-9)


def test_comparable(spark):
    pairs = [("₹ million", 20417.63, "Cr", 2042.0, True), ("Mn Tons", 3.1, "₹ Cr", 2042.0, False), ("%", 4.8, "₹ Cr", 2042.0, False), (None, 1.0, "%", 1.0, True), ("$", 1.0, "€", 1.0, False)]
    frame = spark.createDataFrame(pairs, "ua string, va double, ub string, vb double, want boolean")
    a, b = units.normalise(F.col("va"), F.col("ua")), units.normalise(F.col("vb"), F.col("ub"))
    got = frame.select("want", a.alias("a"), b.alias("b")).select("want", units.comparable(F.col("a"), F.col("b")).alias("got"), (F.abs(F.col("a.value") - F.col("b.value")) <= F.col("a.tolerance") + F.col("b.tolerance")).alias("near")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert got[0].near
    assert spark.range(1).select(units.normalise(F.lit(None).cast("double"), F.lit("Cr")).alias("n")).first().n is None


def test_unit_class(spark):
    assert mapped(spark, ["%", "₹ Cr", "'000 Tons", "crore", None, "kg", "5 kg", "hours"], units.unit_class) == ["ratio", "currency", "mass", "other", "unknown", "other", "mass", "currency"]


def test_shown(spark):
    assert mapped(spark, [7654321.5, 2042.0, 0.75, 3000.0, None], units.shown, "double") == ["7,654,321.5", "2,042", "0.75", "3,000", "—"]


@pytest.mark.parametrize(
    ("value", "told", "cited", "issues"),
    [
        (None, "May 02, 2016", "the bridge opened on May 12, 2016 to all", 1),
        (None, "May 12, 2016", "the bridge opened on May 12, 2016 to all", 0),
        (None, "May 02, 2016", "the bridge is open", 0),
        (31250.75, None, "Sales of timber 31,250.75 29,004.10 20,417.63", 0),
        (31250.76, None, "Sales of timber 31,250.75 29,004.10 20,417.63", 1),
        (2042.0, None, "Sales of timber 31,250.75", 1),
        (-415.25, None, "Deficit of the year (415.25)", 0),
        (-2730.0, None, "Shortfall Rs. (2,730 Cr)", 0),
        (-8.6, None, "Growth of the herd (8.6%)", 0),
        (-5.0, None, "-5", 1),
        (1.0, None, None, 1),
    ],
)
def test_grounding(spark, value, told, cited, issues):
    pairs = F.array(F.struct(F.lit("effective_date").alias("key"), F.lit(told).alias("value"))) if told else F.lit(None).cast("array<struct<key:string,value:string>>")
    found = spark.range(1).select(grounding.grounding_issues(F.lit(value).cast("double"), pairs, F.lit(cited).cast("string")).alias("x")).first().x
    assert len(found) == issues and all(x.endswith(grounding.UNSUPPORTED) for x in found)


def test_verdict_id_is_the_pair(spark):
    space = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
    names = [("a", "b"), ("b", "a"), ("é", "x|y"), ("", "z")] + [(f"f{i}", f"g{i * 7}") for i in range(40)]
    frame = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, a string, b string")
    got = [r.v for r in frame.select("i", naming.verdict_id(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [str(uuid.uuid5(space, "|".join([*sorted(n, key=str.encode), "cmp"]))) for n in names]
    assert got[0] == got[1]


def test_text(spark):
    assert mapped(spark, [" x\t", " a b ", None], text.stripped) == ["x", "a b", None]
    assert mapped(spark, ["ÀB", "àb"], lambda c: text.matches_like(c, "àB")) == [False, True]
    assert mapped(spark, ["Ms. Oak Lantern", "Lantern Oak Ltd", ""], naming.content_tokens) == [["lantern", "oak"], ["lantern", "oak"], []]


def test_figures_are_rounded_from_their_exact_value(spark):
    said = ["47554385225", "72915475505", "72915475515", "1234567.8905", "123456789.25", "123456789.05", "1.0000000005", "9.9999999995", "99999999995", "12345678905" + "0" * 30, "0." + "0" * 20 + "12345678905", "0." + "0" * 322 + "5", "0." + "0" * 309 + "12345678905", "9" * 400, "1" + "0" * 308, "3.5"]
    want = sorted({f"{x:.9e}" for t in said for x in (float(t), -float(t))})
    found = spark.createDataFrame([(f"({t})",) for t in said], "text string").select(grounding.numbers_in(F.col("text")).alias("n")).collect()
    assert sorted({n for r in found for n in r.n}) == want
