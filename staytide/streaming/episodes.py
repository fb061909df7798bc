"""Alert episodes: runs of deviating windows of a key, opened, carried and closed by keyed state with timers.

An episode opens with the `n_open`-th deviating window in a row, and closes on return (a window within the tolerance) or on
silence (nothing for longer than `silence`). It is told once, when it closes. One stream writes the windows as the watermark lets
them out, a second one follows them: windows of a key come in order of time, so the state of a key is one small row
whatever the number of its events. The batch form gives the same episodes as the stream has told by a given moment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from staytide.streaming.alerts import drain, event_stream, window_means

STATE = "n int, start_us bigint, last_us bigint, peak double"
COLUMNS = "start_us bigint, end_us bigint, n_windows int, peak double, reason string"


def judged_windows(
    events: DataFrame, targets: DataFrame, key: str, time: str, value: str, target: str, width: str, tolerance: float, delay: str | None = None
) -> DataFrame:
    """(key, start_us, end_us, deviation, deviates) of every window of the keys with a target; `delay` is the watermark of a stream."""
    if delay is not None:
        events = events.withWatermark(time, delay)
    means = window_means(events, key, time, value, width)
    off = F.col("mean_value") - F.col(target)
    told = means.join(targets.select(key, target), key)
    return told.select(
        key, F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"),
        off.alias("deviation"), (F.abs(off) > tolerance).alias("deviates"),
    )


def episode_stream(windows: DataFrame, key: str, n_open: int, silence_us: int) -> DataFrame:
    """(key, start_us, end_us, n_windows, peak, reason) of the episodes as they close.

    `windows` is a stream of closed windows (key, start_us, end_us, deviation, deviates), none earlier than those of a batch before.
    """
    ended = F.timestamp_micros("end_us")
    windows = windows.withColumn("ended", ended).withWatermark("ended", "0 seconds")
    kind = windows.schema[key].dataType.simpleString()

    def follow(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed: list[tuple] = []
        n, start, last, peak = state.get if state.exists else (0, 0, 0, 0.0)

        def close(reason: str) -> None:
            nonlocal n
            if n >= n_open:
                closed.append((*of, start, last, n, peak, reason))
            n = 0

        if state.hasTimedOut:
            close("silence")
        rows = pd.concat(list(frames)).sort_values("start_us") if not state.hasTimedOut else None
        for r in rows.itertuples(index=False) if rows is not None else ():
            if n and r.start_us - last > silence_us:
                close("silence")
            if not r.deviates:
                close("return")
                continue
            if not n:
                start, peak = r.start_us, r.deviation
            n, last = n + 1, r.end_us
            # of equal ones the earlier
            peak = r.deviation if abs(r.deviation) > abs(peak) else peak
        watermark_us = state.getCurrentWatermarkMs() * 1000
        if n and last + silence_us < watermark_us:
            close("silence")
        if n:
            state.update((n, int(start), int(last), float(peak)))
            state.setTimeoutTimestamp(-(-(last + silence_us) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=[key, *[c.split()[0] for c in COLUMNS.split(", ")]])

    return windows.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, {COLUMNS}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def follow_alerts(judged: DataFrame, key: str, n_open: int, silence_us: int, folder: str) -> DataFrame:
    """Runs both streams over what the source of `judged` holds now; all episodes told so far.

    Offsets, states, windows and episodes lie in `folder`: called again, the streams go on. The second stream takes whole batches
    of the first at a time, as parts of one would seem late.
    """
    windows = drain(judged, "windows", f"{folder}/windows")
    closed = event_stream(judged.sparkSession, f"{folder}/windows/out", windows.schema, files_per_batch=1_000_000)
    return drain(episode_stream(closed, key, n_open, silence_us), "episodes", f"{folder}/episodes")


def last_end(windows: DataFrame, watermark_us: Column | int) -> int:
    """The end of the last window that has ended by the watermark: the moment up to which the second stream has come."""
    return windows.filter(F.col("end_us") <= watermark_us).agg(F.coalesce(F.max("end_us"), F.lit(0))).first()[0]


def episodes(windows: DataFrame, key: str, n_open: int, silence_us: int, now_us: int) -> DataFrame:
    """The episodes that a stream with the watermark `now_us` has told: of windows that have ended, closed by then.

    A key has one window per width of time, so a key's windows are few whatever its events.
    """
    order = Window.partitionBy(key).orderBy("start_us")
    before = lambda c: F.lag(c).over(order)
    gap = F.col("start_us") - before("end_us") > silence_us
    fresh = before("deviates").isNull() | ~before("deviates") | gap
    seen = windows.filter(F.col("end_us") <= now_us).withColumns(
        {"next_us": F.lead("start_us").over(order), "fresh": (F.col("deviates") & fresh).cast("int")}
    )
    runs = seen.withColumn("run", F.sum("fresh").over(order)).filter("deviates")
    # among equal peaks the earlier one
    peak = F.max_by("deviation", F.struct(F.abs("deviation"), -F.col("start_us")))
    told = runs.groupBy(key, "run").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).cast("int").alias("n_windows"),
        peak.alias("peak"), F.max_by("next_us", "start_us").alias("next_us"),
    )
    # a run is maximal: a next window within the silence is a return
    returned = F.col("next_us") - F.col("end_us") <= silence_us
    silent = (F.col("next_us") - F.col("end_us") > silence_us) | (F.col("next_us").isNull() & (F.col("end_us") + silence_us < now_us))
    reason = F.when(returned, "return").when(silent, "silence")
    return told.withColumn("reason", reason).filter(F.col("reason").isNotNull() & (F.col("n_windows") >= n_open)).drop("run", "next_us")
