"""Doubles as the shortest decimal text that reads back as the same double, in the form of ECMAScript."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the form: longest integer without an exponent, and most zeros behind the point before one.
PLAIN_DIGITS, PLAIN_ZEROS = 21, 6
#: Two decimals of so many digits are two doubles, from the smallest normal one on.
DISTINCT_DIGITS, SMALLEST_NORMAL = 15, 2.2250738585072014e-308


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(shown: Column) -> Column:
    """(d, n) of a positive double's text: its digits without zeros at the ends, and n with value 0.d * 10**n."""
    mantissa, power = F.split_part(shown, F.lit("E"), F.lit(1)), F.split_part(shown, F.lit("E"), F.lit(2))
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    row = F.replace(mantissa, F.lit("."), F.lit(""))
    kept = F.ltrim(row, F.lit("0"))
    n = F.length(whole) + F.when(power == "", 0).otherwise(power.try_cast("int")) - (F.length(row) - F.length(kept))
    return F.struct(F.rtrim(kept, F.lit("0")).alias("d"), n.alias("n"))


def _shortest(x: Column, d: Column, n: Column) -> Column:
    """Of the roundings of the digits to 1, 2, ... places, the first that is the same double; else the digits themselves.

    The JVM's own text always reads back as its double, but may be a digit or more too long. With few enough digits it
    is the only one, and nothing is tried.
    """

    def rounded(k: Column) -> Column:
        value, unit = d.cast("long"), F.rpad(F.lit("1"), F.length(d) - k + 1, F.lit("0")).cast("long")
        rest = value % unit
        down = F.call_function("div", value, unit)
        near = F.when((rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1)), F.array(down + 1, down)).otherwise(F.array(down, down + 1))
        text = F.transform(near, lambda c: c.cast("string"))
        return F.transform(text, lambda t: F.struct(t.alias("d"), (n - k + F.length(t)).alias("n"), F.concat(t, F.lit("E"), (n - k).cast("string")).try_cast("double").alias("x")))

    shorter = F.flatten(F.transform(F.sequence(F.lit(1), F.length(d) - 1), rounded))
    found = F.get(F.filter(shorter, lambda c: c["x"] == x), F.lit(0))
    found = let(found, lambda c: F.when(c.isNotNull(), F.struct(F.rtrim(c["d"], F.lit("0")).alias("d"), c["n"].alias("n"))))
    tried = (F.length(d) > DISTINCT_DIGITS) | ((F.length(d) > 1) & (x < SMALLEST_NORMAL))
    return F.when(tried, F.coalesce(found, F.struct(d.alias("d"), n.alias("n")))).otherwise(F.struct(d.alias("d"), n.alias("n")))


def _written(d: Column, n: Column) -> Column:
    size, zeros = F.length(d), lambda k: F.repeat(F.lit("0"), k)
    tail = F.when(size > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
    power = F.concat(F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string"))
    return (
        F.when((size <= n) & (n <= PLAIN_DIGITS), F.concat(d, zeros(n - size)))
        .when((n > 0) & (n <= PLAIN_DIGITS), F.concat(F.substr(d, F.lit(1), n), F.lit("."), F.substr(d, n + 1)))
        .when((n <= 0) & (n > -PLAIN_ZEROS), F.concat(F.lit("0."), zeros(-n), d))
        .otherwise(F.concat(F.substr(d, F.lit(1), F.lit(1)), tail, F.lit("e"), power))
    )


def number_text(x: Column) -> Column:
    """A double's text; either zero is ``0``, and what is not finite has none."""
    size = F.abs(x)
    # Whole numbers have their exact digits, which the JVM's text rounds.
    whole = (size >= 1) & (size < 2.0**63) & (size == F.floor(size))
    shown = F.when(whole, size.cast("long").cast("string")).otherwise(size.cast("string"))
    text = let(_digits(shown), lambda t: let(_shortest(size, t["d"], t["n"]), lambda s: _written(s["d"], s["n"])))
    signed = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(x == 0, "0").when(size < float("inf"), signed)
