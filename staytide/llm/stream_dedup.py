"""Exact duplicates by a stream with keyed state on disk.

Each text is lower-cased (A-Z only) and digested. A Structured Streaming query groups the digests: its state, in a RocksDB
store without expiry, holds for each digest the largest id, the number of rows, and a locator of the content (file and id);
copies are counted before the shuffle, so a group with a third of all rows is a row per task there. The state goes with
the checkpoint in the shared folder, so a run that stops goes on where it was, and later files meet all earlier texts.

A digest that is hit again is no proof: the full texts of all such rows are compared, each distinct text once per task.
Should texts of one digest differ, they are told apart.

Defined results: NULL texts count as empty ones, which equal each other. A NULL id is below every other id; in
a group of NULL ids alone `keep_id` is NULL. Each row whose id is the group's `keep_id` is kept, so repeated rows of that id all
are. Rows that share an id but not a text belong to different groups. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staytide.llm.textarrays import LOWER, column, parts, text_bytes
from staytide.session import materialize, shared_dir

# Bytes of new files that one micro-batch takes.
BATCH_BYTES = str(64 << 30)
# Memory of all state stores of an executor; the rest of the state is on its disk.
STORE_MB = 400
# Lanes that the rows of a repeated digest are dealt over when their texts are fetched.
LANES = 16
ROW_SCHEMA = "doc_id bigint, digest binary, file string"

Digest = Callable[[bytes], bytes]


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _texts(digest: Digest, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id, text and one more column, with the text's digest; the normalised text goes on if it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            flat, at = text_bytes(column(part, "text"))
            data, ends = LOWER[flat].tobytes(), at.tolist()
            norm = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
            columns = {"doc_id": part.column(0), "digest": pa.array([digest(t) for t in norm], pa.binary()), part.schema.names[2]: part.column(2)}
            if with_text:
                columns["norm"] = pa.array(norm, pa.binary())
            yield pa.record_batch(columns)

    return run


def _slim(docs: DataFrame, more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), more)


def digested(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """doc_id, digest of the normalised text, and file of each row."""
    return _slim(docs, F.input_file_name().alias("file")).mapInArrow(_texts(digest, False), ROW_SCHEMA)


def store_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, whose streams keep their state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # many small stores: none takes disk in advance
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STORE_MB))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


def follow(spark: SparkSession, rows: str, checkpoint: str, out: str, **options: str) -> None:
    """Takes all files below `rows` (of digested rows) that the checkpoint has not seen into the state; changed groups go to `out`.

    A batch that is run again after a failure replaces its own folder, so nothing counts twice.
    """
    session = store_session(spark)
    source = session.readStream.schema(ROW_SCHEMA).options(**(options or {"maxBytesPerTrigger": BATCH_BYTES})).parquet(rows)
    state = source.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct("file", "doc_id")).alias("located"),
    )

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


GROUP_SCHEMA = "digest binary, keep_id bigint, group_size bigint, located struct<file: string, doc_id: bigint>, batch bigint"


def groups(spark: SparkSession, out: str) -> DataFrame:
    """The state of each digest as its last batch left it."""
    seen = spark.read.schema(GROUP_SCHEMA).parquet(out)
    last = seen.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "located"), "batch").alias("g"))
    return last.select("digest", "g.*")


def texts_of_hits(docs: DataFrame, hits: DataFrame, digest: Digest = sha256) -> DataFrame:
    """doc_id, digest, norm of the rows whose digest is among the hits.

    A digest's rows are dealt over lanes, as one may hold a third of all rows.
    """
    lanes = F.array(*[F.lit(i) for i in range(LANES)])
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES)).cast("int").alias("lane")
    texts = _slim(docs, lane).mapInArrow(_texts(digest, True), "doc_id bigint, digest binary, lane int, norm binary")
    return texts.join(hits.select("digest", F.explode(lanes).alias("lane")), ["digest", "lane"], "left_semi").drop("lane")


def variants(hits: DataFrame) -> DataFrame:
    """Per repeated digest, each of its distinct texts, by a comparison of all bytes: norm, keep_id, group_size."""
    return hits.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(docs: DataFrame, digest: Digest = sha256, **options: str) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept, file and located_id (where the group's content lies)."""
    spark = docs.sparkSession
    at = shared_dir(spark, "dedup")
    digested(docs, digest).write.parquet(f"{at}/rows")
    follow(spark, f"{at}/rows", f"{at}/state", f"{at}/groups", **options)
    rows = spark.read.schema(ROW_SCHEMA).parquet(f"{at}/rows")
    if rows.isEmpty():
        state = spark.createDataFrame([], GROUP_SCHEMA).drop("batch")
    else:
        state = materialize(groups(spark, f"{at}/groups"), "dedup-state")
    texts = variants(texts_of_hits(docs, state.filter("group_size > 1"), digest))
    false_hits = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "dedup-false")
    told = rows.select("doc_id", "digest").join(state, "digest")
    columns = ["doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")]
    place = [F.col("located.file").alias("file"), F.col("located.doc_id").alias("located_id")]
    result = told.select(*columns, *place)
    if false_hits.isEmpty():
        return result
    # texts of one digest that differ: their rows get the groups of the texts themselves
    apart = texts_of_hits(docs, false_hits, digest)
    sorted_out = apart.join(variants(apart), ["digest", "norm"]).select(*columns, F.lit("").alias("file"), F.col("keep_id").alias("located_id"))
    return result.join(false_hits, "digest", "left_anti").select(*result.columns).unionByName(sorted_out)
