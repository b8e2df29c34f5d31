"""Units, magnitudes and what a printed number claims about its own precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup, stripped

# Magnitude words and currency signs.
MAGNITUDES = {
    "thousand": 1e3,
    "k": 1e3,
    "'000": 1e3,
    "000": 1e3,
    "lakh": 1e5,
    "lac": 1e5,
    "million": 1e6,
    "mn": 1e6,
    "mio": 1e6,
    "m": 1e6,
    "crore": 1e7,
    "cr": 1e7,
    "billion": 1e9,
    "bn": 1e9,
    "trillion": 1e12,
}
CURRENCIES = {
    "₹": "INR",
    "inr": "INR",
    "rs": "INR",
    "rupee": "INR",
    "rupees": "INR",
    "$": "USD",
    "usd": "USD",
    "us$": "USD",
    "€": "EUR",
    "eur": "EUR",
    "£": "GBP",
    "gbp": "GBP",
}
# Words of a unit that say nothing, and words of mass.
FILLERS = ("in", "of", "per", "s")
MASS_WORDS = ("ton", "tonne", "kg", "kilogram")

TOKEN = r"([\p{L}\p{Nl}\p{No}]+|[₹$€£]|'?\p{Nd}+)"
PARSED = "struct<currency:string,magnitude:double,residual:array<string>>"
#: Powers of ten as literals: computing them would differ in the last bit.
STEPS_DOWN = [float(f"1e-{k}") for k in range(0, 20)]
STEPS_UP = [float(f"1e{k}") for k in range(0, 20)]


def parse_unit(unit: Column) -> Column:
    """``currency, magnitude, dimension, residual`` of a unit string.

    The last currency counts, and the first magnitude; a null or empty unit is of
    ``unknown`` dimension, a percentage a ``ratio``.
    """
    low = F.lower(stripped(unit))
    start = F.struct(F.lit(None).cast("string").alias("currency"), F.lit(1.0).alias("magnitude"), F.array().cast("array<string>").alias("residual"))

    def step(acc: Column, token: Column) -> Column:
        singular = F.when(token.endswith("s") & (F.length(token) > 2), F.substring(token, 1, F.length(token) - 1)).otherwise(token)
        currency = F.coalesce(lookup(CURRENCIES, token), lookup(CURRENCIES, singular))
        magnitude = F.when(acc["magnitude"] == 1.0, F.coalesce(lookup(MAGNITUDES, token), lookup(MAGNITUDES, singular)))
        plain = currency.isNull() & magnitude.isNull() & ~token.isin(*FILLERS)
        return F.struct(
            F.coalesce(currency, acc["currency"]).alias("currency"),
            F.when(currency.isNull(), F.coalesce(magnitude, acc["magnitude"])).otherwise(acc["magnitude"]).alias("magnitude"),
            F.when(plain, F.concat(acc["residual"], F.array(token))).otherwise(acc["residual"]).alias("residual"),
        )

    def finish(acc: Column) -> Column:
        residual = F.array_join(acc["residual"], " ")
        mass = F.lit(False)
        for word in MASS_WORDS:
            mass = mass | residual.contains(word)
        dimension = F.when(acc["currency"].isNotNull(), "currency").when(mass, "mass").when(residual != "", "count").otherwise("magnitude")
        return F.struct(acc["currency"].alias("currency"), acc["magnitude"].alias("magnitude"), dimension.alias("dimension"), residual.alias("residual"))

    def fixed(dimension: str, residual: str) -> Column:
        return F.struct(F.lit(None).cast("string").alias("currency"), F.lit(1.0).alias("magnitude"), F.lit(dimension).alias("dimension"), F.lit(residual).alias("residual"))

    tokens = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(1))
    return (
        F.when(unit.isNull() | (unit == ""), fixed("unknown", ""))
        .when(low.contains("%") | low.contains("percent"), fixed("ratio", "%"))
        .otherwise(F.aggregate(tokens, start.cast(PARSED), step, finish))
    )


def precision_tolerance(value: Column, magnitude: Column) -> Column:
    """Half the place value of the last digit that a number shows at ten significant digits.

    Trailing zeros of a whole number claim nothing: 8140 stands for 8140 give or
    take 5.  The rule holds for all sizes of a number, also where a
    shortest-form printer would turn to an exponent.
    """
    shown = F.format_string("%.9e", F.abs(value))
    digits = F.length(F.regexp_replace(F.regexp_replace(F.split(shown, "e")[0], r"\.", ""), "0+$", ""))
    places = digits - 1 - F.split(shown, "e")[1].cast("int")
    down, up = F.array(*map(F.lit, STEPS_DOWN)), F.array(*map(F.lit, STEPS_UP))
    step = F.when(places >= 0, F.coalesce(F.get(down, places), F.pow(F.lit(10.0), -places))).otherwise(F.coalesce(F.get(up, -places), F.pow(F.lit(10.0), -places)))
    return F.when(value == 0, magnitude * 0.5).otherwise(F.lit(0.5) * step * magnitude)


def normalise(value: Column, unit: Column) -> Column:
    """``value`` in base units, its ``tolerance`` and the parsed unit; null for a null value."""
    parsed = parse_unit(unit)
    return F.when(
        value.isNotNull(),
        F.struct(
            (value * parsed["magnitude"]).alias("value"),
            precision_tolerance(value, parsed["magnitude"]).alias("tolerance"),
            parsed["currency"].alias("currency"),
            parsed["magnitude"].alias("magnitude"),
            parsed["dimension"].alias("dimension"),
            parsed["residual"].alias("residual"),
        ),
    )


def comparable(a: Column, b: Column) -> Column:
    """Whether two normalised values measure the same kind of thing; an unknown dimension is no claim."""
    soft = a["dimension"].isin("magnitude", "currency") & b["dimension"].isin("magnitude", "currency")
    same_money = a["currency"].isNull() | b["currency"].isNull() | (a["currency"] == b["currency"])
    return (a["dimension"] == "unknown") | (b["dimension"] == "unknown") | ((soft | (a["dimension"] == b["dimension"])) & same_money)


def shown(value: Column) -> Column:
    """A number for reading: two decimals at most, thousands apart; a dash for none."""
    text = F.format_number(value, 2)
    return F.coalesce(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), F.lit("—"))


def unit_class(unit: Column) -> Column:
    """The coarse class of a unit's wording, from substrings alone."""
    low = F.lower(unit)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    return (
        F.when(unit.isNull() | (unit == ""), "unknown")
        .when(has("%", "percent"), "ratio")
        .when(has("₹", "inr", "rupee", "rs", "usd", "$"), "currency")
        .when(has("ton", "tonne", " kg", "kilogram"), "mass")
        .otherwise("other")
    )
