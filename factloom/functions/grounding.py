"""Grounding: whether the literals of a claim stand in the text it cites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

UNSUPPORTED = "not in cited blocks"
NUMBER = r"(\p{Nd}[\p{Nd},]*\.?\p{Nd}*)"
#: Accounts print negative figures in parentheses.
NEGATIVE = r"\((?U:\s*)(\p{Nd}[\p{Nd},]*\.?\p{Nd}*)(?U:\s*)[^)\p{Nd}]{0,8}\)"
# The pattern defines what counts as a date.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DATE = rf"(?iU)(\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b)"


#: The smallest double that has all its bits.
NORMAL = 2.2250738585072014e-308
LIMB = 10**9


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(m: Column, e: Column) -> Column:
    """All digits of m * 2**e, or of m * 5**-e where e is negative (m * 2**e less the point), as text."""
    long, div = lambda n: F.lit(n).cast("long"), lambda x, y: F.call_function("div", x, y)

    def factors(n: Column, base: int, most: int) -> Column:
        return F.concat(F.array_repeat(long(base**most), div(n, F.lit(most)).cast("int")), F.array(F.pow(F.lit(float(base)), n % most).cast("long")))

    def times(limbs: Column, factor: Column) -> Column:
        def of_limb(s: Column, limb: Column) -> Column:
            product = limb * factor + s["over"]
            return F.struct(div(product, long(LIMB)).alias("over"), F.concat(s["out"], F.array(product % LIMB)).alias("out"))

        none = F.struct(long(0).alias("over"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(limbs, none, of_limb, lambda s: F.concat(s["out"], F.array(s["over"])))

    steps = F.when(e < 0, factors(-e, 5, 12)).otherwise(factors(e, 2, 29))
    limbs = F.aggregate(steps, F.array(m % LIMB, div(m, long(LIMB))), times)  # nine digits each, the lowest first
    return F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), "^0+", "")


def _rounded(size: Column) -> Column:
    """A positive double at ten significant digits, from its exact value, ties to even."""

    def of_exponent(e: Column) -> Column:
        half = F.floor(-e / 2)  # two steps, as one power of two may be out of range
        m = (size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -e - half)).cast("long")
        return _bound(_digits(m, e), lambda d: of_digits(d, F.length(d) - 1 + F.least(e, F.lit(0))))

    def of_digits(d: Column, place: Column) -> Column:
        head, rest = F.substring(d, 1, 10).cast("long"), F.regexp_replace(F.substring(d, 11, 2_000), "0+$", "")
        up = (rest > "5") | ((rest == "5") & (head % 2 == 1))
        return _bound((head + up.cast("long")).cast("string"), lambda t: F.concat(F.substring(t, 1, 1), F.lit("."), F.substring(t, 2, 9), F.lit("e"), F.format_string("%+03d", place + F.length(t) - 10)))

    return _bound(F.floor(F.log2(size)).cast("int") - 54, of_exponent)


def canonical(number: Column) -> Column:
    """A number at ten significant digits, as text that is equal for equal numbers.

    What is rounded is the exact value, ties to even.  Spark's own format rounds the shortest form of a double, half up, which
    is another thing where that form has eleven digits, the last a 5, and where a double lacks bits.
    """
    size = F.abs(number)
    shortest = F.format_string("%.10e", size)
    open_ = (size < NORMAL) | ((F.substring(shortest, 12, 1) == "5") & (shortest.cast("double") == size))
    sign = F.when(number < 0, F.lit("-")).otherwise("")
    return (
        F.when(number == 0, F.lit("0"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(open_, F.concat(sign, _rounded(size)))
        .otherwise(F.format_string("%.9e", number))
    )


def _figures(text: Column, pattern: str) -> Column:
    bare = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.regexp_replace(t, ",", ""))
    return F.transform(bare, lambda t: t.try_cast("double"))


def numbers_in(text: Column) -> Column:
    """Canonical forms of the numbers of a text; of a figure in parentheses the negative one too."""
    plain = F.transform(_figures(text, NUMBER), canonical)
    negative = F.transform(_figures(text, NEGATIVE), lambda x: canonical(-x))
    return F.array_compact(F.array_union(plain, negative))


def dates_in(text: Column) -> Column:
    """The dates of a text in lower case, blanks and commas made one blank."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.lower(stripped(F.regexp_replace(d, r"(?U)[\s,]+", " ")))))


def grounding_issues(value: Column, qualifiers: Column, cited: Column) -> Column:
    """What the cited text doesn't support: the value, and dates in qualifiers where the text has dates at all.

    A value is written as Spark prints the double.
    """
    cited = F.coalesce(cited, F.lit(""))
    none = F.array().cast("array<string>")
    # The text is read once: what it holds is bound to the variable of a lambda over one element.
    held = F.array(F.struct(numbers_in(cited).alias("numbers"), dates_in(cited).alias("dates")))

    def of_text(held: Column) -> Column:
        bad_value = value.isNotNull() & ~F.array_contains(held["numbers"], canonical(value))
        of_value = F.when(bad_value, F.array(F.concat(F.lit("value "), value.cast("string"), F.lit(f" {UNSUPPORTED}")))).otherwise(none)

        def of_qualifier(q: Column) -> Column:
            missing = F.filter(dates_in(F.coalesce(q["value"], F.lit("None"))), lambda d: ~F.array_contains(held["dates"], d))
            return F.transform(missing, lambda _: F.concat(q["key"], F.lit("="), q["value"], F.lit(f" {UNSUPPORTED}")))

        of_dates = F.when(F.size(held["dates"]) > 0, F.flatten(F.transform(F.coalesce(qualifiers, F.array().cast("array<struct<key:string,value:string>>")), of_qualifier)))
        return F.concat(of_value, F.coalesce(of_dates, none))

    return F.get(F.transform(held, of_text), F.lit(0))


def inherited(issues: Column) -> Column:
    return F.coalesce(F.exists(issues, lambda x: x.contains(UNSUPPORTED)), F.lit(False))
