"""Numeric text: strict casts and significant figures, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType, StringType

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def name(column: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def to_number(c: Column, kind: DataType) -> Column:
    """Double, or null for anything that is no plain number; NaN becomes null."""
    if isinstance(kind, StringType):
        return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    d = c.cast("double")
    return F.when(~F.isnan(d), d) if isinstance(kind, FractionalType) else d


def _without(c: Column, which: str) -> Column:
    """Text without any of these characters."""
    return F.translate(c, which, "")


def _led(c: Column, which: str) -> Column:
    """Text without these characters at its start."""
    return F.ltrim(c, F.lit(which))


def _plain_figures(c: Column) -> Column:
    """Of text and whole numbers."""
    mantissa = F.substring_index(F.lower(F.trim(c.cast("string"))), "e", 1)
    return F.greatest(F.lit(1), F.length(_led(_led(_without(mantissa, "."), "-"), "0")))


def _digits(text: Column, v: Column) -> Column:
    """Digits of the shortest text of a double v >= 0, given the JVM's text, which may have a digit or two
    more than needed (of numbers below 1e-307, whose text is short all the same, one more may count)."""
    mantissa = F.substring_index(text, "E", 1)
    whole = F.when(text.contains("E") & mantissa.endswith(".0"), F.substring(mantissa, 1, 1)).otherwise(mantissa)
    found = F.length(_led(_without(whole, "."), "0"))
    sure, out = F.length(text) < 18, F.least(found, F.lit(17))
    for places in (15, 14):  # the JVM's text isn't always the shortest one
        short = F.format_string(f"%.{places}e", v)
        fewer = F.length(F.rtrim(_without(F.substring_index(short, "e", 1), "."), F.lit("0")))
        out = F.when(short.try_cast("double") == v, fewer).otherwise(out)
    return F.when(sure, found).otherwise(out)


def _exponent(text: Column) -> Column:
    return F.when(text.contains("E"), F.substring_index(text, "E", -1).try_cast("int")).otherwise(F.lit(0))


def _double_figures(digits: Column, exponent: Column) -> Column:
    positional = (exponent >= 7) & (exponent < 16)
    return F.greatest(F.lit(1), F.when(positional & (digits - 1 <= exponent), exponent + 2).otherwise(digits))


def significant_figures(c: Column, kind: DataType) -> Column:
    """Digits of the number as written, without sign, point, exponent and leading zeros; 1 if none is left.

    For doubles the shortest decimal text counts, positional from 1e-4 up to 1e16, where whole numbers end in ".0"."""
    if isinstance(kind, (StringType, IntegralType)):
        return _plain_figures(c)
    v = F.abs(c.cast("double"))
    return _double_figures(_digits(v.cast("string"), v), _exponent(v.cast("string")))


def with_figures(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same as a column of df, in steps, so that no part is computed twice."""
    kind = df.schema[column].dataType
    if isinstance(kind, (StringType, IntegralType)):
        return df.withColumn(out, _plain_figures(name(column)))
    df = df.withColumn("__v", F.abs(name(column).cast("double"))).withColumn("__t", F.col("__v").cast("string"))
    df = df.withColumns({"__d": _digits(F.col("__t"), F.col("__v")), "__e": _exponent(F.col("__t"))})
    return df.withColumn(out, _double_figures(F.col("__d"), F.col("__e"))).drop("__v", "__t", "__d", "__e")


def round_figures(v: Column, figures: Column) -> Column:
    """v to so many significant figures, half to even, never coarser than to whole numbers; 0, null and
    numbers too small to be scaled stay."""
    decimals = figures - 1 - F.floor(F.log10(F.abs(v)))
    scale = F.pow(F.lit(10.0), decimals.cast("double"))
    return (
        F.when(v == 0, F.lit(0.0)).when(v.isin(float("inf"), float("-inf")), v)
        .when(decimals <= 0, F.rint(v)).when(decimals > 300, v).otherwise(F.rint(v * scale) / scale)
    )


def settled(c: Column) -> Column:
    """c, computed where it stands: as the expression isn't deterministic, Catalyst copies it into no predicate above.

    Predicates on other columns of the same projection aren't pushed through it either; they belong before it."""
    return F.when(F.rand(0) + 1 > 0, c)  # always so, but no rule folds it


def truthy(c: Column) -> Column:
    """Boolean from booleans, numbers or text: true, 1 and their spellings; false, 0 and theirs; else null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
