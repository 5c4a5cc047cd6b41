"""Whole-number arithmetic, and numbers as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(value: Column, by: Column | int) -> Column:
    """Whole-number division, exact for every long; rounds toward zero."""
    divisor = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("div", value, divisor)


# Numbers as texts, rounded half to even from their exact binary values. Products are kept as a sum of two
# doubles without error: a factor is cut into two halves of at most 27 bits, whose products fit a double.


def _halves(x: Column) -> tuple[Column, Column]:
    scaled = x * F.lit(float((1 << 27) + 1))
    high = scaled - (scaled - x)
    return high, x - high


def _rounded(whole: Column, side: Column) -> Column:
    """``whole`` or the next number, by the sign of what is left over a half; the even one on ties."""
    return whole + F.when(side > 0, 1).when(side == 0, F.pmod(whole, F.lit(2))).otherwise(0)


def _sign(x: Column) -> Column:
    return F.when(x.cast("string").startswith("-"), "-").otherwise("")


def _special(x: Column, text: Column) -> Column:
    """``text``, or the words for what is no number; null stays null."""
    endless = F.abs(x) == F.lit(float("inf"))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(endless, F.concat(_sign(x), F.lit("inf"))).otherwise(text)


def with_fixed(rows: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Double columns as texts with 1 to 7 ``digits`` after the point. From 2^112 on, the digits after the
    17th are zeros. Steps are columns of their own, so that no expression is repeated."""

    def step(rows: DataFrame, made: str, of) -> DataFrame:
        return rows.withColumns({f"_{made}_{name}": of(lambda part, name=name: F.col(f"_{part}_{name}"), 10**n) for name, n in digits.items()})

    rows = rows.withColumns({f"_size_{name}": F.abs(F.col(name)) for name in digits})
    rows = step(rows, "whole", lambda at, _: F.floor(at("size")))
    rows = step(rows, "part", lambda at, _: F.when(at("size") < float(1 << 52), at("size") - at("whole").cast("double")).otherwise(0.0))
    rows = step(rows, "high", lambda at, scale: _halves(at("part"))[0])
    rows = step(rows, "base", lambda at, scale: F.floor(at("high") * float(scale)))
    rows = step(rows, "side", lambda at, scale: (at("high") * float(scale) - at("base").cast("double") - 0.5) + (at("part") - at("high")) * float(scale))
    rows = step(rows, "places", lambda at, _: _rounded(at("base"), at("side")))
    rows = step(rows, "upper", lambda at, _: F.floor(at("size") / float(1 << 50)))  # longs end at 2^63
    made = {}
    for name, n in digits.items():
        x, size, places, upper = (F.col(c) for c in (name, f"_size_{name}", f"_places_{name}", f"_upper_{name}"))
        carry = places == 10**n
        wide = upper.cast("decimal(19,0)") * F.lit(1 << 50).cast("decimal(17,0)")
        wide = wide + F.floor(size - upper.cast("double") * float(1 << 50)).cast("decimal(19,0)")
        whole = (F.col(f"_whole_{name}") + carry.cast("long")).cast("string")
        integer = F.when(size < float(1 << 62), whole).otherwise(wide.cast("string"))
        text = F.concat(_sign(x), integer, F.lit("."), F.lpad(F.when(carry, 0).otherwise(places).cast("string"), n, "0"))
        made[name] = _special(x, F.when(size < float(1 << 112), text).otherwise(F.format_string(f"%.{n}f", x)))
    steps = ("size", "whole", "part", "high", "base", "side", "places", "upper")
    return rows.withColumns(made).drop(*[f"_{part}_{name}" for part in steps for name in digits])


def with_scientific(rows: DataFrame, name: str, digits: int, to: str) -> DataFrame:
    """Add ``to``: the double ``name`` with one digit before the point, ``digits`` (1 to 3) after it, and an
    exponent. Beyond 1e-18 and 1e18 it is rounded half up from its shortest digits. Steps are columns of
    their own, so that no expression is repeated."""
    x, size = F.col(name), F.abs(F.col(name))
    ten = lambda power: F.concat(F.lit("1e"), power.cast("string")).cast("double")  # noqa: E731, exact up to 22
    inside = (size >= 1e-18) & (size < 1e18)
    guess = F.floor(F.log10(F.when(inside, size).otherwise(1.0)))
    rows = rows.withColumn("_size", F.when(inside, size).otherwise(1.0)).withColumn("_power", guess)
    power = F.col("_power") + (F.col("_size") >= ten(F.col("_power") + 1)).cast("long") - (F.col("_size") < ten(F.col("_power"))).cast("long")
    rows = rows.withColumn("_power", power)
    rows = rows.withColumn("_scale", ten(F.abs(F.lit(digits) - F.col("_power"))))
    x1, x2 = _halves(F.col("_size"))
    s1, s2 = _halves(F.col("_scale"))
    rows = rows.withColumns({"_x1": x1, "_x2": x2, "_s1": s1, "_s2": s2})
    product = F.col("_size") * F.col("_scale")
    error = ((F.col("_x1") * F.col("_s1") - product) + F.col("_x1") * F.col("_s2") + F.col("_x2") * F.col("_s1")) + F.col("_x2") * F.col("_s2")
    small = F.col("_power") <= digits
    rows = rows.withColumn("_q", F.floor(F.when(small, product).otherwise(F.col("_size") / F.col("_scale"))))
    below = (product - F.col("_q").cast("double") - 0.5) + error
    above = F.col("_size") - (F.col("_q").cast("double") + 0.5) * F.col("_scale")
    rows = rows.withColumn("_q", _rounded(F.col("_q"), F.when(small, below).otherwise(above)))
    over = F.col("_q") == 10 ** (digits + 1)
    rows = rows.withColumns({"_power": F.col("_power") + over.cast("long"), "_q": F.when(over, 10**digits).otherwise(F.col("_q"))})
    shown = F.when(size == 0, F.lit(0)).otherwise(F.col("_q")).cast("string")
    shown = F.lpad(shown, digits + 1, "0")
    mark = F.when(F.col("_power") < 0, "-").otherwise("+")
    exponent = F.concat(F.lit("e"), mark, F.lpad(F.abs("_power").cast("string"), 2, "0"))
    text = F.concat(_sign(x), F.substring(shown, 1, 1), F.lit("."), F.substring(shown, 2, digits), exponent)
    text = _special(x, F.when(inside | (size == 0), text).otherwise(F.format_string(f"%.{digits}e", x)))
    return rows.withColumn(to, text).drop("_size", "_power", "_scale", "_x1", "_x2", "_s1", "_s2", "_q")
