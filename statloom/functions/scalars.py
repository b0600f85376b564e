"""Column functions of the analytics: text normalisation, clocks, keys, safe arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(c: Column, width: int = 10) -> Column:
    """Zero-padded text id; longer ids aren't cut."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def squeezed(c: Column) -> Column:
    """Trimmed lower-case text with single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), "\\s+", " ")


def vocabulary(c: Column, words: dict[str, str], other: str = "other") -> Column:
    """A text's standard name from a fixed map, else `other`."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(F.try_element_at(table, squeezed(c)), F.lit(other))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), F.when(b != 0, b).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """The correlation of columns that are null in the same rows; null where either is constant, on which corr() fails; a constant's deviation, put
    together of parts, isn't always 0."""
    return F.when((F.max(a) > F.min(a)) & (F.max(b) > F.min(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def known_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stable(c: Column, digits: int = 6) -> Column:
    """A double rounded so that two engines' orders of summation don't show."""
    return F.round(c + F.lit(1e-9), digits)


def clock_seconds(clock: Column, period: Column) -> Column:
    """Seconds since the start from an ISO 8601 clock that counts a period down
    (periods 1 to 4: 720 s, later ones 300 s); an empty clock is 0."""
    minutes = F.coalesce(F.try_to_number(F.regexp_extract(clock, "PT(\\d+)M", 1), F.lit("999")).cast("double"), F.lit(0.0))
    seconds = F.coalesce(F.regexp_extract(clock, "(\\d+(?:\\.\\d+)?)S", 1).try_cast("double"), F.lit(0.0))
    length = F.when(period <= 4, 720.0).otherwise(300.0)
    before = F.least(period - 1, F.lit(4)) * 720.0 + F.greatest(period - 5, F.lit(0)) * 300.0
    return F.when(F.coalesce(clock, F.lit("")) == "", 0.0).otherwise(before + length - (minutes * 60 + seconds))


def right_closed_bin(value: Column, cuts: Column) -> Column:
    """How many cut points are at most the value."""
    return F.aggregate(cuts, F.lit(0), lambda n, cut: n + F.when(cut <= value, 1).otherwise(0))


def near_integer(c: Column) -> Column:
    """Whether a number is an integer within 1e-8 and 1e-5 of its size."""
    return F.abs(c - F.round(c)) <= 1e-8 + 1e-5 * F.abs(F.round(c))


def monday_block(day: Column, first: Column, days: int) -> Column:
    """The number of a date's block of `days` days, from the Monday of the first date."""
    return F.floor(F.datediff(day, F.date_trunc("week", first)) / days).cast("int")


def season_label(day: Column, first_month: int = 7) -> Column:
    """YYYY-YY of the season that a date belongs to."""
    start = F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of at most 26 bits."""
    high = let(x * 134217729.0, lambda t: t - (t - x))
    return high, x - high


def _product_sign(a: Column, b: Column, c: Column) -> Column:
    """The sign of a * b - c, exactly, where c is near the product: the product's rounding error is
    the sum of the halves' products."""

    def error(p: Column) -> Column:
        (ah, al), (bh, bl) = _halves(a), _halves(b)
        return F.signum((p - c) + (((ah * bh - p) + ah * bl + al * bh) + al * bl))

    return let(a * b, error)


def significant(c: Column, digits: int = 10) -> Column:
    """A double's text with so many significant digits, as C's printf writes %g: ties, by the
    double's exact value, go to the even digit; trailing zeros go; below 1e-4 and from 1e<digits> on with an
    exponent. Ties are exact from 1e-11 to 1e22; beyond, a tie of the shortest text goes up;
    below 2.3e-308, where doubles have fewer digits, the digits are those of the shortest text. Null stays null."""

    def text_of(digit: Column, exponent: Column) -> Column:
        cut = F.regexp_replace(digit, "0+$", "")
        kept = F.when(cut == "", "0").otherwise(cut)
        size = F.format_string("%02d", F.abs(exponent))
        science = F.concat(F.substring(kept, 1, 1), F.when(F.length(kept) > 1, F.concat(F.lit("."), kept.substr(F.lit(2), F.lit(digits)))).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), size)
        whole = digit.substr(F.lit(1), exponent + 1)
        rest = F.regexp_replace(digit.substr(exponent + 2, F.lit(digits)), "0+$", "")
        large = F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), kept)
        return F.when((exponent < -4) | (exponent >= digits), science).when(exponent >= 0, large).otherwise(small)

    def rounded(s: Column) -> Column:
        # the shortest text of the double: its digits, and the power of ten by which their number is multiplied
        mantissa, power = F.regexp_extract(s["text"], "^([0-9.]+)", 1), F.coalesce(F.regexp_extract(s["text"], "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        plain = F.regexp_replace(mantissa, "[.]", "")
        own = F.regexp_replace(F.regexp_replace(plain, "^0+", ""), "0+$", "")
        shift = power - F.length(F.regexp_extract(mantissa, "[.]([0-9]+)$", 1)) + F.length(F.regexp_extract(plain, "(0*)$", 1))
        up = F.struct(F.regexp_replace(F.regexp_extract(s["up"], "^([0-9.]+)", 1), "[.]", "").alias("digit"), F.regexp_extract(s["up"], "e([+-][0-9]+)$", 1).cast("int").alias("exponent"))

        def choose(r: Column) -> Column:
            tie = (F.length(r["own"]) == digits + 1) & r["own"].endswith("5")
            number, ten = r["own"].cast("double"), F.pow(F.lit(10.0), F.abs(r["shift"]).cast("double"))
            sign = F.when(r["shift"] < 0, _product_sign(s["a"], ten, number)).otherwise(-_product_sign(number, ten, s["a"]))
            even = F.substring(r["own"], digits, 1).cast("int") % 2 == 0
            down = tie & (F.abs(r["shift"]) <= 22) & ((sign < 0) | ((sign == 0) & even))
            lower = F.struct(F.substring(r["own"], 1, digits).alias("digit"), (r["shift"] + digits).alias("exponent"))
            return let(F.when(down, lower).otherwise(r["up"]), lambda d: text_of(d["digit"], d["exponent"]))

        return let(F.struct(own.alias("own"), shift.cast("int").alias("shift"), up.alias("up")), choose)

    def shown(x: Column) -> Column:
        a = F.abs(x)
        number = let(F.struct(a.alias("a"), F.format_string(f"%.{digits - 1}e", a).alias("up"), a.cast("string").alias("text")), rounded)
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        return F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0"))).otherwise(F.concat(sign, number))

    return F.when(c.isNotNull(), let(c.cast("double"), shown))
