"""Reading numbers out of text cells, and printing numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.fixed_values import PREFIX_NUMBER

SPACES = (
    " \t\n\r\u000b\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


_NUMBER_STARTS = tuple("0123456789+-.I")


def trimmed(col: Column) -> Column:
    """Text without leading and trailing Unicode space."""
    first, last = F.left(col, F.lit(1)), F.right(col, F.lit(1))
    # a text between two printable ASCII characters, as most are, stays as it is
    clean = first.between("!", "~") & last.between("!", "~")
    return F.when(clean, col).otherwise(F.btrim(col, F.lit(SPACES)))


def lenient_number(col: Column) -> Column:
    """The number a text starts with ('5-LOW' -> 5.0), NULL if there is none."""
    return leading_number(trimmed(col))


def leading_number(text: Column) -> Column:
    """lenient_number of a text that is already trimmed."""
    found = F.nullif(F.regexp_extract(text, PREFIX_NUMBER, 0), F.lit("")).try_cast("double")
    # most texts are decided by their first character, without the pattern
    return F.when(F.left(text, F.lit(1)).isin(*_NUMBER_STARTS), found)


def whole_number(text: Column) -> Column:
    """The number a trimmed text is as a whole, NULL otherwise."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def is_calendar(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """Trimmed text of a cell; NULL for a missing or empty one."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    if not isinstance(dtype, T.StringType):
        return col.cast("string")
    return F.nullif(trimmed(col), F.lit(""))


def cell_number(col: Column, dtype: T.DataType, mode: str = "lenient", text: Column | None = None) -> Column:
    """The numeric reading of a cell of any type; NULL where it is not a number.

    `text` is the cell's cell_text if that is at hand.
    """
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col.cast("double"))
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if mode == "lenient" and is_calendar(dtype):
        # the number an ISO date starts with
        return F.year(col).cast("double")
    text = cell_text(col, dtype) if text is None else text
    return leading_number(text) if mode == "lenient" else whole_number(text)


def number_text(col: Column) -> Column:
    """A double as text: plain decimals from 1e-6 up to 1e21, beyond that digits and an exponent.

    5.0 -> '5', 1.0E7 -> '10000000', 5.0E-4 -> '0.0005', 1.5E-7 -> '1.5e-7', 1.0E21 -> '1e+21'.
    """
    text = col.cast("string")
    # most numbers have no exponent: one look for it, and a whole number's ".0" is cut
    plain = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(col == 0, F.lit("0")).when(~text.contains("E"), plain).otherwise(_from_exponent(col, text))


def _from_exponent(col: Column, text: Column) -> Column:
    """The text of a number that Spark writes as digits and an exponent: d.dddE7."""
    sign, cut = F.when(col < 0, "-").otherwise(""), F.instr(text, "E")
    exponent = F.substring(text, cut + 1, F.length(text)).try_cast("int")
    mantissa = F.regexp_replace(F.ltrim(F.substring(text, F.lit(1), cut - 1), F.lit("-")), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    # the digits, d.ddd times ten to the exponent, with their point moved
    large = F.rpad(digits, exponent + 1, "0")
    large = F.when(F.length(digits) > exponent + 1, F.concat(F.left(digits, exponent + 1), F.lit("."), F.substr(digits, exponent + 2))).otherwise(large)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(mantissa, F.when(exponent > 0, "e+").otherwise("e"), exponent.cast("string"))
    size = F.abs(col)
    return (
        F.when((size >= 1e-6) & (size < 1), F.concat(sign, small))
        .when((size >= 1) & (size < 1e21), F.concat(sign, large))
        .otherwise(F.concat(sign, scientific))
    )
