"""Feature preparation: dropping, coercing and encoding columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import constants as K
from ..functions.scalars import as_number, col, finite_or_null, parse_number, present, without_nan
from .columnstats import collect_measures
from .encode import encode_columns
from .profile import type_class, unique_ratio
from .validate import clean_target, label_text, require_columns


def _present(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    return {n: present(n, df.schema[n].dataType) for n in names}


def _features(df: DataFrame, keep: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(keep)]


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Without the columns that hold no value at all, and their names."""
    # Flags of one type: any number of columns is one pass.
    flags = {n: F.when(c.isNotNull(), 1) for n, c in _present(df, _features(df, keep)).items()}
    found = collect_measures(df, flags, {"known": F.count})
    empty = [n for n, m in found.items() if not m["known"]]
    return df.drop(*[col(c) for c in empty]), empty


def _varies(c: Column) -> Column:
    return F.coalesce(F.min(c) < F.max(c), F.lit(False))


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Without the columns of at most one distinct value, and their names.

    Smallest and largest hash tell, in one pass over any mix of types, and where they are
    equal the smallest and largest value; nothing is counted distinct.
    """
    values = _present(df, _features(df, keep))
    hashes = {n: F.when(c.isNotNull(), F.xxhash64(c)) for n, c in values.items()}
    found = collect_measures(df, hashes, {"varies": _varies})
    alike = {n: values[n] for n, m in found.items() if not m["varies"]}
    found |= collect_measures(df, alike, {"varies": _varies})
    constant = [n for n, m in found.items() if not m["varies"]]
    return df.drop(*[col(c) for c in constant]), constant


def epoch_micros(name: str, dtype: T.DataType) -> Column:
    """Date or time as microseconds since 1970, as a double.

    Times without a zone count as UTC whatever the session's zone is.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, col(name).cast("timestamp_ntz")).cast("double")


def converted(name: str, dtype: T.DataType) -> Column | None:
    """A non-text column as a finite double; None for text."""
    kind = type_class(dtype)
    if kind == "time":
        return epoch_micros(name, dtype)
    if kind in ("number", "bool"):
        return finite_or_null(as_number(name, dtype))
    return None


def datetimes_to_epoch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema if type_class(f.dataType) == "time"]
    return df.withColumns({n: epoch_micros(n, df.schema[n].dataType) for n in names})


def bools_to_numbers(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if type_class(f.dataType) == "bool"]
    return df.withColumns({n: col(n).cast("double") for n in names})


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles, values that are not numbers as missing."""
    return df.withColumns({
        n: as_number(n, df.schema[n].dataType) for n in columns if n in df.columns
    })


def infinity_to_missing(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: finite_or_null(col(n)) for n in names})


def numeric_text_shares(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Share of all rows that parse as a number, per text column."""
    names = list(columns or [f.name for f in df.schema if type_class(f.dataType) == "text"])
    found = collect_measures(
        df, {n: without_nan(parse_number(col(n))) for n in names},
        {"parsed": F.count, "rows": lambda c: F.count(F.lit(1))},
    )
    return {n: (m["parsed"] or 0) / m["rows"] if m["rows"] else 0.0 for n, m in found.items()}


def convert_numeric_text(
    df: DataFrame, columns: Sequence[str] | None = None, share: float = K.NUMERIC_TEXT_SHARE
) -> tuple[DataFrame, list[str]]:
    """Text columns that mostly parse become numeric; returns their names too."""
    shares = numeric_text_shares(df, columns)
    names = [n for n, s in shares.items() if s >= share]
    return df.withColumns({n: without_nan(parse_number(col(n))) for n in names}), names


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories as the rank of their value, missing stays missing."""
    return encode_columns(df, {n: col(n) for n in columns})


def encode_labels(df: DataFrame, target: str, output: str = "label") -> DataFrame:
    """Adds the target's code: its text sorted ascending, numbered from 0."""
    return encode_columns(df, {output: label_text(target, df.schema[target].dataType)})


def identifier_names(columns: Sequence[str]) -> list[str]:
    """Columns whose name alone suggests a row identifier."""
    hits = []
    for c in columns:
        name = c.strip().lower()
        if name in K.IDENTIFIER_NAMES or name.endswith("id"):
            hits.append(c)
    return hits


def drop_identifiers(
    df: DataFrame, key: str | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Without columns named like an identifier whose values are mostly unique.

    ``key`` stays in the frame (splits need it) but is still reported.
    """
    suspects = identifier_names(_features(df, keep))
    if not suspects:
        return df, []
    ratios = {r["column_name"]: r["unique_ratio"] for r in unique_ratio(df, suspects).collect()}
    removed = [c for c in suspects if (ratios.get(c) or 0.0) > K.IDENTIFIER_RATIO]
    return df.drop(*[col(c) for c in removed if c != key]), removed


def prepare_features(
    df: DataFrame, target: str, key: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Numeric features and an encoded label, ready for the learner suite.

    Order matters: empty and constant columns are judged on all rows, then rows
    without a usable target go, then columns are converted, then columns that
    turned out empty go. Key columns pass through. Two aggregates decide, one
    projection converts; only real categories need a dictionary join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, [target, *keys])
    keep = [target, *keys]
    df, _ = drop_constant_columns(df, keep)
    df = clean_target(df, target)
    fields = [f for f in df.schema if f.name not in keep and type_class(f.dataType) != "other"]
    direct = {f.name: converted(f.name, f.dataType) for f in fields}
    text = [n for n, c in direct.items() if c is None]
    numbers = {n: c for n, c in direct.items() if c is not None}
    parsed = {n: without_nan(parse_number(col(n))) for n in text}
    # One aggregate: how many usable numbers each column yields, and how many texts.
    known = collect_measures(
        df,
        {**{f"n.{n}": c for n, c in numbers.items()},
         **{f"p.{n}": c for n, c in parsed.items()},
         **{f"f.{n}": finite_or_null(c) for n, c in parsed.items()},
         **{f"t.{n}": F.when(col(n).isNotNull(), F.lit(1.0)) for n in text}},
        {"known": F.count, "rows": lambda c: F.count(F.lit(1))},
    )

    def count(kind, name):
        return known[f"{kind}.{name}"]["known"] or 0

    rows = max([m["rows"] or 0 for m in known.values()], default=0)
    as_numbers = [n for n in text if rows and count("p", n) / rows >= K.NUMERIC_TEXT_SHARE]
    columns, codes = [col(k) for k in keys], {}
    for f in fields:
        if f.name in numbers:
            if count("n", f.name):
                columns.append(numbers[f.name].alias(f.name))
        elif f.name in as_numbers:
            if count("f", f.name):
                columns.append(finite_or_null(parsed[f.name]).alias(f.name))
        elif count("t", f.name):
            columns.append(col(f.name))
            codes[f.name] = col(f.name)
    columns.append(col(target))
    codes[label] = col(target)
    narrowed = df.select(*columns)
    encoded = encode_columns(narrowed, codes)
    return encoded if label == target else encoded.drop(col(target))
