"""Alert episodes: the stream against a plain walk and the batch form, with restarts, late events and timers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from staytide.session import shared_dir
from staytide.streaming import alerts, episodes

HOUR = 3_600_000_000
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "stay_id long, ts timestamp, value double"


def plain(rows, target, n_open, silence, now):
    """One key after the other, window by window. `rows`: (key, hours, value)."""
    windows = {}
    for k, t, v in rows:
        windows.setdefault((k, int(t)), []).append(v)
    out = []
    for k in sorted({k for k, _ in windows}):
        run, last = [], None

        def close(reason):
            if len(run) >= n_open:
                peak = max(run, key=lambda w: (abs(w[1]), -w[0]))[1]
                out.append((k, run[0][0], run[-1][0] + 1, len(run), round(peak, 9), reason))
            run.clear()

        for hour in sorted(h for key, h in windows if key == k and h + 1 <= now):
            mean = sum(windows[k, hour]) / len(windows[k, hour])
            if run and hour - (run[-1][0] + 1) > silence:
                close("silence")
            if abs(mean - target) > 10:
                run.append((hour, mean - target))
            else:
                close("return")
        if run and run[-1][0] + 1 + silence < now:
            close("silence")
    return sorted(out)


def data(seed, hours=60):
    rnd = random.Random(seed)
    rows = []
    for k in range(6):
        high = False
        for h in range(hours):
            if rnd.random() < 0.25:
                high = not high
            if rnd.random() < 0.6:
                rows += [(k, h + rnd.random() * 0.99, (130.0 if high else 95.0) + rnd.random()) for _ in range(rnd.randrange(1, 3))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(hours=t), v) for k, t, v in rows], SCHEMA)


def told(df):
    zero = int(T0.timestamp() * 1_000_000)
    return sorted((r.stay_id, (r.start_us - zero) // HOUR, (r.end_us - zero) // HOUR, r.n_windows, round(r.peak, 9), r.reason) for r in df.collect())


def windows(df, targets, delay=None):
    return episodes.judged_windows(df, targets, "stay_id", "ts", "value", "target", "1 hour", 10, delay)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(k, 100.0) for k in range(6)], "stay_id long, target double")


def run(spark, folder, targets):
    events = alerts.event_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema)
    return told(episodes.follow_alerts(windows(events, targets, "1 hour"), "stay_id", 2, 2 * HOUR, folder))


def test_stream_with_restarts_and_late_events(spark, targets):
    folder, rows = shared_dir(spark, "episodes-test"), data(1)
    ends = [20, 33, 60]
    parts = [[r for r in rows if a <= r[1] < b] for a, b in zip([0, *ends], ends)]
    # an event that comes after its window was closed is left out
    late = (0, 3.5, 1000.0)
    for i, part in enumerate(parts):
        frame(spark, part + ([late] if i == 2 else [])).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = run(spark, folder, targets)
        seen = [r for p in parts[: i + 1] for r in p]
        watermark = max(r[1] for r in seen) - 1
        assert got == plain(seen, 100.0, 2, 2, max(int(r[1]) + 1 for r in seen if int(r[1]) + 1 <= watermark))
    assert {r[-1] for r in got} == {"return", "silence"} and len(got) > 10
    # nothing new: nothing is told twice
    assert run(spark, folder, targets) == got


def test_batch_form(spark, targets):
    zero = int(T0.timestamp() * 1_000_000)
    for seed, now in ((2, 59.0), (3, 41.5), (4, 10.0)):
        rows = data(seed)
        got = episodes.episodes(windows(frame(spark, rows), targets), "stay_id", 2, 2 * HOUR, int(zero + now * HOUR))
        assert told(got) == plain(rows, 100.0, 2, 2, now)
    assert episodes.episodes(windows(frame(spark, []), targets), "stay_id", 2, HOUR, zero).collect() == []
