"""Groups of equal texts against a dictionary; runs that stop and go on; false hits of a weak digest."""

import hashlib

from pyspark.sql import functions as F

from staytide.llm import stream_dedup
from staytide.session import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Same text"),
    (2, "same TEXT"),
    (3, "same text "),
    (4, None),
    (5, ""),
    (None, ""),
    (None, "alone"),
    (None, "ALONE"),
    (6, "ÉCOLE İ Ⅰ"),
    (7, "école İ Ⅰ"),
    (8, "ÉcOLE İ Ⅰ"),
    (9, "repeated"),
    (9, "repeated"),
    (9, "another text"),
    (10, "long " * 100_000),
    (11, "LONG " * 100_000),
    (12, "long " * 100_000 + "!"),
]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = groups[norm]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df, with_digest=True):
    sha = F.lower(F.hex("digest")).alias("sha")
    rows = df.select("doc_id", "keep_id", "group_size", "kept", *([sha] if with_digest else [])).collect()
    return sorted((tuple(r) for r in rows), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, lane int").repartition(parts)


def test_groups(spark):
    df = frame(spark, ROWS)
    assert told(stream_dedup.deduplicate(df)) == plain(ROWS)
    # one file per batch: each text meets those of earlier batches in the state
    assert told(stream_dedup.deduplicate(df, maxFilesPerTrigger="1")) == plain(ROWS)
    assert stream_dedup.deduplicate(df.limit(0)).collect() == []


def test_full_texts_are_compared(spark):
    """A digest of one byte, of which a few values are met, brings unequal texts together; they are told apart."""
    weak = lambda text: bytes([sum(text) % 3])
    got = told(stream_dedup.deduplicate(frame(spark, ROWS), weak, maxFilesPerTrigger="2"), False)
    assert got == sorted((r[:4] for r in plain(ROWS)), key=str)


def test_later_files_meet_the_state(spark):
    at = shared_dir(spark, "dedup-test")
    first, second = [(i, f"text {i % 40}") for i in range(100)], [(i, f"Text {i % 60}") for i in range(100, 180)]
    place = (f"{at}/rows", f"{at}/state", f"{at}/out")
    stream_dedup.digested(frame(spark, first)).write.mode("append").parquet(place[0])
    stream_dedup.follow(spark, *place)
    one = {r.keep_id: r.group_size for r in stream_dedup.groups(spark, place[2]).collect()}
    assert one == {max(i for i in range(100) if i % 40 == k): sum(i % 40 == k for i in range(100)) for k in range(40)}
    stream_dedup.digested(frame(spark, second)).write.mode("append").parquet(place[0])
    stream_dedup.follow(spark, *place)
    stream_dedup.follow(spark, *place)  # nothing new
    got = {(r.keep_id, r.group_size) for r in stream_dedup.groups(spark, place[2]).collect()}
    assert got == {(k, n) for _, k, n, _, _ in plain(first + second)}
    # the state lies in a RocksDB store below the checkpoint
    files = [p for p in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{place[1]}/state").select("path").toPandas()["path"]]
    assert any(p.endswith(".zip") or p.endswith(".changelog") for p in files)


def test_a_batch_that_runs_again_counts_once(spark):
    """A run ended after its batch was written, before it was marked as done: the next run takes that batch again."""
    import os

    at = shared_dir(spark, "dedup-again")
    place = (f"{at}/rows", f"{at}/state", f"{at}/out")
    rows = [(i, f"text {i % 7}") for i in range(50)]
    stream_dedup.digested(frame(spark, rows)).write.parquet(place[0])
    stream_dedup.follow(spark, *place, maxFilesPerTrigger="1")
    commits = sorted((f for f in os.listdir(f"{place[1]}/commits") if f.isdigit()), key=int)
    assert len(commits) == 3
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{place[1]}/commits/{name}"):
            os.unlink(f"{place[1]}/commits/{name}")
    stream_dedup.follow(spark, *place, maxFilesPerTrigger="1")
    assert {(r.keep_id, r.group_size) for r in stream_dedup.groups(spark, place[2]).collect()} == {(k, n) for _, k, n, _, _ in plain(rows)}
