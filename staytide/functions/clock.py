"""Time as whole microseconds: offsets, horizons, windows and outcome strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from staytide.functions.values import as_col
from staytide.schemas import HOUR_US, MINUTE_US

DAY_US = 24 * HOUR_US

# Duration text such as '2 days 01:30:00.5' or '-1 days +22:30:00'.
DURATION = r"^\s*(-?\d+) days?(?: \+?(\d{1,2}):(\d{2}):(\d{2})(\.\d{1,6})?)?\s*$"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = as_col(ts)
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY_US
        + F.hour(ts).cast("bigint") * HOUR_US
        + F.minute(ts).cast("bigint") * MINUTE_US
        + seconds
    )


def instant(ts: Column | str) -> Column:
    """A timestamp without zone as the instant of that time in UTC; a watermark needs an instant."""
    return F.timestamp_micros(micros(ts))


def elapsed_us(start: Column | str, end: Column | str) -> Column:
    return micros(end) - micros(start)


def timestamp_or_null(text: Column | str) -> Column:
    return as_col(text).try_cast("timestamp_ntz")


def duration_us(text: Column | str) -> Column:
    """Duration text in microseconds; anything else becomes NULL."""
    text = as_col(text)

    def part(i: int) -> Column:
        found = F.regexp_extract(text, DURATION, i)
        return F.when(found != "", found)

    def number(i: int) -> Column:
        return F.coalesce(part(i).try_cast("bigint"), F.lit(0))

    fraction = F.coalesce(F.round(part(5).try_cast("double") * 1_000_000).cast("bigint"), F.lit(0))
    whole = number(1) * DAY_US + number(2) * HOUR_US + number(3) * MINUTE_US + number(4) * 1_000_000
    return F.when(text.rlike(DURATION), whole + fraction)


def dies_within(t: Column, death: Column, span: Column | int) -> Column:
    """1 if death comes no later than `span` after t. A death before t counts; no death gives 0."""
    return F.coalesce(t + span >= death, F.lit(False)).cast("int")


def horizon_labels(
    t: Column | str,
    death: Column | str,
    hours: Sequence[int],
    unit_per_hour: int = HOUR_US,
    alive: Column | None = None,
) -> dict[str, Column]:
    """One 0/1 column per horizon. `alive` marks rows whose end time is a discharge, not a death."""
    t, death = as_col(t), as_col(death)
    if alive is not None:
        death = F.when(~F.coalesce(alive, F.lit(False)), death)
    return {f"death_in_{h}_hours": dies_within(t, death, h * unit_per_hour) for h in hours}


def window_test(offset: Column | str, start: Column | int, end: Column | int) -> Column:
    offset = as_col(offset)
    return (offset >= start) & (offset < end)


def window_before(moment: int, length: int, unit: int = HOUR_US) -> tuple[int, int]:
    """The prediction window that ends at a moment."""
    return (moment - length) * unit, moment * unit


def window_after(moment: int, length: int, unit: int = HOUR_US) -> tuple[int, int]:
    """The exploration window that starts at a moment."""
    return moment * unit, (moment + length) * unit


def outcome_stratum(death_offset: Column | str, moment: int, outcome: int, unit: int = HOUR_US) -> Column:
    """Where a death falls: before the moment, inside the outcome window, later, or nowhere."""
    death_offset = as_col(death_offset)
    return (
        F.when(death_offset.isNull(), "none")
        .when(death_offset < moment * unit, "before")
        .when(death_offset < (moment + outcome) * unit, "within")
        .otherwise("after")
    )
