"""Words of a text as column expressions: maximal runs without space, tab to carriage return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def text_of(text: Column | str) -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column | str) -> Column:
    """Array of the words in order; empty for NULL, empty and blank texts."""
    trimmed = F.btrim(text_of(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column | str) -> Column:
    return F.size(words_of(text)).cast("bigint")
