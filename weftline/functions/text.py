"""Text of numbers as the document formats have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.expressions import let


def _decimal(digits: Column, point: Column) -> Column:
    """0.DIGITS times ten to the power of point; null if that isn't a number."""
    return F.concat(F.lit("0."), digits, F.lit("E"), point.cast("string")).try_cast("double")


def _figures(digits: Column, point: Column) -> Column:
    return F.struct(F.rtrim(digits, F.lit("0")).alias("digits"), point.alias("point"))


def _written(size: Column) -> Column:
    """struct digits, point of a number that isn't negative, as the platform writes it: digits without zeros at either end, and the place of the point before them."""
    text = size.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    every = F.concat(whole, F.substring_index(mantissa, ".", -1))
    bare = F.ltrim(every, F.lit("0"))
    return _figures(bare, F.length(whole) + exponent - (F.length(every) - F.length(bare)))


def _shorter(size: Column, figures: Column) -> Column:
    """The figures with one digit less, if they still are the number; of two ways to round the nearer comes first."""
    digits, point = figures["digits"], figures["point"]
    less = F.substring(digits, F.lit(1), F.length(digits) - 1)
    more = (less.try_cast("bigint") + 1).cast("string")
    down, up = _figures(less, point), _figures(more, point + F.length(more) - F.length(less))
    fits = lambda s: _decimal(s["digits"], s["point"]) == size
    is_up = F.substring(digits, F.length(digits), F.lit(1)) >= "5"
    pair = F.struct(F.when(is_up, up).otherwise(down).alias("near"), F.when(is_up, down).otherwise(up).alias("far"))
    chosen = let(pair, lambda p: F.when(fits(p["near"]), p["near"]).when(fits(p["far"]), p["far"]).otherwise(figures))
    return F.when(F.length(digits) < 2, figures).otherwise(chosen)


def shortest(size: Column) -> Column:
    """struct digits, point: the fewest digits that are read back as this number, which is finite and not negative. Java before 19 may write one or two too many."""
    return let(let(_written(size), lambda f: _shorter(size, f)), lambda f: _shorter(size, f))


def plain_number(x: Column) -> Column:
    """Shortest plain decimal form, without exponent, that is read back as the same double: 10, 2.5, -3, -0, 0.000012.

    Of several shortest ones of 17 digits, as some large numbers have, it is the
    platform's. NaN and infinities are written as the platform writes them."""
    text = x.cast("string")

    def plain(f):
        digits, point, n = f["digits"], f["point"], F.length(f["digits"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        large = F.concat(digits, F.repeat(F.lit("0"), point - n))
        return F.when(n == 0, F.lit("0")).when(point <= 0, small).when(point >= n, large).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))

    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    # no two decimals of 15 digits or less are the same double, so a short one is the shortest
    as_it_is = ~F.contains(text, F.lit("E")) & (F.length(text) <= 16)
    return F.when(as_it_is, F.regexp_replace(text, r"\.0$", "")).otherwise(F.concat(sign, let(shortest(F.abs(x)), plain)))


def plain_position(point: Column) -> Column:
    return F.concat(plain_number(point.x), F.lit(","), plain_number(point.y))
