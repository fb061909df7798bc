"""Row filters and projections on whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions import values as V
from staytide.schemas import Measurement


def by_code(df: DataFrame, code: str, codes: Sequence) -> DataFrame:
    """Events whose code is listed; the test reaches the scan."""
    return df.filter(F.col(code).isin(list(codes)))


def by_name(df: DataFrame, name: str, part: str) -> DataFrame:
    """Events whose name holds a text, in any case."""
    return df.filter(F.lower(F.col(name)).contains(part.lower()))


def plausible(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    return df.filter(V.in_range(value, low, high))


def measurement(df: DataFrame, code: str, value: str, kind: Measurement) -> DataFrame:
    """Events of one measurement of a source, with plausible values."""
    if kind.codes:
        df = by_code(df, code, kind.codes)
    if kind.contains:
        df = by_name(df, code, kind.contains)
    if kind.low is None and kind.high is None:
        return df
    return plausible(df, value, kind.low, kind.high)


def numeric(df: DataFrame, text: str, out: str) -> DataFrame:
    """Rows whose text is a number, with that number."""
    return df.filter(V.is_number(text)).withColumn(out, V.number(text))


def adults(df: DataFrame, age_text: str, gender: str, min_age: float = 18) -> DataFrame:
    """Rows with a numeric age from `min_age` on and a known gender; age becomes a number."""
    age = V.number(age_text)
    return df.filter((age >= min_age) & F.col(gender).isin("Female", "Male")).withColumn(age_text, age)


def in_band(df: DataFrame, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    for c, (low, high) in bands.items():
        df = df.filter(V.in_range(c, low, high))
    return df


def fill_zero(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """NULL becomes 0 in a named group of columns."""
    return df.fillna(0, subset=list(group))


def without_missing(df: DataFrame, *columns: Column | str) -> DataFrame:
    for c in columns:
        df = df.filter(V.as_col(c).isNotNull())
    return df
