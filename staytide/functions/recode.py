"""Category maps, one-hot columns and threshold classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from staytide.functions.values import as_col

# Categories of the sources and the classes they stand for.
GENDER_BY_WORD = {"Male": 1, "Female": 0}
GENDER_BY_LETTER = {"M": 1, "F": 0}
ETHNICITY = {
    "Caucasian": "WHITE",
    "African American": "BLACK",
    "Hispanic": "LATINO",
    "Asian": "OTHER",
    "Other/Unknown": "OTHER",
    "Native American": "OTHER",
}
RACE_BY_SUBSTRING = [
    ("WHITE", "WHITE"),
    ("PORTUGUESE", "WHITE"),
    ("BLACK", "BLACK"),
    ("LATINO", "LATINO"),
    ("SOUTH AMERICAN", "LATINO"),
    ("ASIAN", "OTHER"),
    ("UNKNOWN", "OTHER"),
    ("INDIAN", "OTHER"),
    ("HAWAIIAN", "OTHER"),
    ("MULTIPLE RACE", "OTHER"),
    ("UNABLE TO OBTAIN", "OTHER"),
    ("PATIENT DECLINED TO ANSWER", "OTHER"),
]
RACE_COLUMNS = {"WHITE": "race_w", "BLACK": "race_b", "LATINO": "race_l", "OTHER": "race_o"}
VENTILATION_COLUMNS = {
    "invasive": "mv_invasive",
    "non_invasive": "mv_non_vasive",
    "oxygen_therapy": "mv_oxygen_therapy",
    "none": "mv_none",
    "unknown": "mv_unknown",
}
# class of an episode by its highest therapy type
THERAPY_CLASSES = [(1, "oxygen_therapy"), (2, "unknown"), (3, "non_invasive"), (4, "invasive")]
LEGACY_CLASSES = [(1, "oxygen_therapy"), (2, "unknown"), (3, "mv_non_vasive"), (4, "mv_invasive")]


def recode(c: Column | str, mapping: Mapping, keep_others: bool = False) -> Column:
    """Exact-value map; other values become NULL, or stay as they are."""
    c = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return out.otherwise(c) if keep_others else out


def recode_first_match(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The first rule whose substring occurs decides; text that meets no rule stays."""
    c = as_col(c)
    out = None
    for part, new in rules:
        hit = c.contains(part)
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return out.otherwise(c)


def one_hot(c: Column | str, columns: Mapping[str, str], missing: str | None = None) -> dict[str, Column]:
    """0/1 columns for known categories. A NULL sets none of them, or the `missing` column."""
    c = as_col(c)
    out = {}
    for value, name in columns.items():
        hit = F.coalesce(c == value, F.lit(False))
        out[name] = (hit | c.isNull() if name == missing else hit).cast("int")
    return out


def threshold_class(c: Column | str, steps: Sequence[tuple[float, str]], default: str = "none") -> Column:
    """Label of the first step that the value does not exceed; above all steps or NULL: default."""
    c = as_col(c)
    out = None
    for limit, label in steps:
        out = F.when(c <= limit, F.lit(label)) if out is None else out.when(c <= limit, F.lit(label))
    return out.otherwise(F.lit(default))
