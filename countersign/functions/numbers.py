"""Number expressions: lenient amount parsing and two-decimal money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the longest leading decimal number, after blanks of any kind.
LEADING_NUMBER = (
    r"^[\s\p{Zs}\u2028\u2029\uFEFF]*"
    r"([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
)

_CENTS = 100.0
# Veltkamp's constant 2**27 + 1: splits a double into two 26-bit halves.
_SPLITTER = 134217729.0
# From here on a double has at most six binary places: a hundred times its
# fraction, plus a half, is exact.
_FEW_PLACES = float(2**46)
# From half of here on a double is a whole multiple of 2**10 and is written by
# way of that multiple.
_BEYOND_LONG = float(2**63)
# Numbers from here on are written with an exponent.
_EXPONENT_FROM = 1e21


def leading_number(text: Column) -> Column:
    """The number that ``text`` starts with, as a double; 0 if there is none.

    ``12.90abc`` is 12.9, ``1,468.00`` is 1, ``$75`` is 0. Adding zero turns a
    negative zero into a plain one.
    """
    prefix = F.regexp_extract(text, LEADING_NUMBER, 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0)) + F.lit(0.0)


def money_text(amount: Column) -> Column:
    """``$`` and the amount with two decimals, no grouping.

    Rounds the exact binary value, a tie away from zero, so 1.005 gives
    ``$1.00`` (the double lies below 1.005) and 0.125 gives ``$0.13``. Below
    2**46 the product with 100 is taken together with its rounding error
    (Dekker), beyond it the fraction is rounded by itself; from 2**62 to 1e21
    it is written as a whole multiple of 2**10. The whole computation stays in generated code.

    From 1e21 the text has an exponent and the digits the JVM prints, which
    before Java 19 are not always the fewest possible.
    """
    size = F.abs(amount)
    product = size * F.lit(_CENTS)
    scaled = size * F.lit(_SPLITTER)
    high = scaled - (scaled - size)
    error = (high * F.lit(_CENTS) - product) + (size - high) * F.lit(_CENTS)
    whole = F.floor(product)
    rest = (product - whole.cast("double")) - F.lit(0.5)
    cents = whole + F.when(rest + error >= 0, F.lit(1)).otherwise(F.lit(0))
    exact = F.concat(
        F.floor(cents / F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((cents % F.lit(100)).cast("string"), 2, "0"),
    )
    floor = F.floor(F.least(size, F.lit(_BEYOND_LONG / 2)))
    part = F.floor((size - floor.cast("double")) * F.lit(_CENTS) + F.lit(0.5)).cast("bigint")
    units = floor + F.when(part == 100, F.lit(1)).otherwise(F.lit(0))
    wide = F.concat(
        units.cast("string"), F.lit("."), F.lpad((part % F.lit(100)).cast("string"), 2, "0")
    )
    # Such a double is a whole multiple of 2**10, and its quotient fits a bigint.
    steps = F.floor(F.least(size, F.lit(_EXPONENT_FROM)) / F.lit(1024.0)).cast("decimal(20,0)")
    huge = F.concat((steps * F.lit(1024).cast("decimal(4,0)")).cast("string"), F.lit(".00"))
    exponent = F.regexp_replace(size.cast("string"), r"(\.0)?E", "e+")
    digits = (
        F.when(size < F.lit(_FEW_PLACES), exact)
        .when(size < F.lit(_BEYOND_LONG / 2), wide)
        .when(size == F.lit(float("inf")), F.lit("Infinity"))
        .when(size >= F.lit(_EXPONENT_FROM), exponent)
        .otherwise(huge)
    )
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit("$"), sign, digits)
