"""Column expressions shared by the operators. All stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F, types as T

# Python strips every one of these, Spark's plain trim only the first.
_BLANKS = " \t\n\r\f\x0b"
_NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"
_INTEGER = r"^[+-]?[0-9]+$"
_INF = float("inf")


def quoted(name: str) -> str:
    """``name`` as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(quoted(name))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def folded(c: Column) -> Column:
    """Trimmed and lower-cased text."""
    return F.lower(strip(c))


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The pattern guard keeps forms that only Spark reads as numbers, such as ``1d``, out.
    """
    t = strip(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def parse_integer(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(_INTEGER), t.try_cast("bigint"))


def without_nan(c: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(c), c)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN taken as missing."""
    return without_nan(col(name)) if is_fractional(dtype) else col(name)


def as_number(name: str, dtype: T.DataType) -> Column:
    """Any column as a double, unusable values as null."""
    if isinstance(dtype, T.StringType):
        return without_nan(parse_number(col(name)))
    if is_fractional(dtype):
        return without_nan(col(name).cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    return F.lit(None).cast("double")


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_INF))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant map, null when the key is unknown."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, key)


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_of(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def any_of(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def integer_id(name: str, dtype: T.DataType) -> Column:
    """Id given as number or text to a long, decimals cut, unusable values null."""
    if isinstance(dtype, T.IntegralType):
        return col(name).cast("bigint")
    return finite_or_null(as_number(name, dtype)).try_cast("bigint")
