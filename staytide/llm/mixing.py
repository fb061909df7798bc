"""Mixing sources to target weights along a low-discrepancy schedule.

Each source is a stream of its documents in hashed order, cut into blocks of equal size in words. Points of the
golden-ratio sequence, mapped through the cumulative weights of the sources, say which source fills the next
slot; the k-th slot of a source takes its k-th block, starting over at its first block when the
stream is used up. The last slot of a source ends where its target is met, and a source that got too few
points makes up for them in closing slots. So slots of a source come evenly spread and its words
meet the target.

No task holds a whole source: running totals and ranks go over chunks (`operators.prefix`), slots and blocks
join on (source, block).

Defined results: NULL text has no words; NULL is a source of its own, the last one; a document
without words takes nothing; repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staytide.llm.words import word_count
from staytide.operators.prefix import row_ranks, sums_before
from staytide.session import materialize

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 2048
# Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
CELLS = 4096
SLOTS_PER_CHUNK = 65_536


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: m_rank, source, m_total, m_target, m_quota (the target in whole words).

    Targets share `share` of all words by weight, but none exceeds `most` times its source: with the
    sources in order of limit per weight, those before the first one whose level fits are at their limit.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("m_total"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("m_rank"), F.lit(len(weights))))
    listed = (
        per_source.withColumn("m_rank", F.row_number().over(by_name) - 1)
        .withColumn("m_weight", weight)
        .withColumn("m_limit", F.col("m_total").cast("double") * most)
        .withColumn("m_ratio", F.col("m_limit") / F.col("m_weight"))
    )
    before = Window.orderBy("m_ratio", "m_rank").rowsBetween(Window.unboundedPreceding, -1)
    leveled = listed.withColumn(
        "m_level",
        (F.sum(F.col("m_total").cast("double")).over(everything) * share - F.coalesce(F.sum("m_limit").over(before), F.lit(0.0)))
        / (F.sum("m_weight").over(everything) - F.coalesce(F.sum("m_weight").over(before), F.lit(0.0))),
    )
    place = F.struct("m_ratio", "m_rank", "m_level")
    first = F.min(F.when(F.col("m_level") <= F.col("m_ratio"), place)).over(everything)
    return (
        leveled.withColumn("m_first", first)
        .withColumn("m_target", F.least(F.col("m_first.m_level") * F.col("m_weight"), F.col("m_limit")))
        .select(
            "m_rank",
            "source",
            "m_total",
            "m_target",
            F.least(F.floor(F.col("m_target") + 0.5), F.col("m_total") * most).cast("bigint").alias("m_quota"),
        )
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document, written once."""
    return materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's row and m_start: the words of its stream before the document."""
    placed = (
        sizes.withColumn("m_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("m_chunk", F.substring("m_hash", 1, 3))
        .join(sources.withColumnRenamed("source", "m_source"), F.col("source").eqNullSafe(F.col("m_source")))
        .drop("m_source")
    )
    return sums_before(placed, ["m_rank"], "m_chunk", ["m_hash", "doc_id", "size"], {"m_start": "size"})


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The slots: m_slot (order of the mix), m_rank, m_block, m_epoch and m_take, words from the block's start.

    A slot's order is exact; closing slots follow the last point.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("m_total") / block)
    rest = F.col("m_quota") % F.greatest(F.col("m_total"), F.lit(1))
    epochs = F.floor(F.col("m_quota") / F.greatest(F.col("m_total"), F.lit(1)))
    wanted = sources.withColumn("m_blocks", blocks.cast("bigint")).withColumn(
        "m_slots", (epochs * F.col("m_blocks") + F.ceil(rest / block)).cast("bigint")
    )
    n = int(wanted.agg(F.coalesce(F.sum("m_slots"), F.lit(0)).alias("n")).first()["n"])
    up_to = Window.orderBy("m_rank").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum("m_slots").over(up_to).cast("double") / max(n, 1)
    lanes = wanted.withColumn("m_to", ends).withColumn("m_from", F.coalesce(F.lag("m_to").over(Window.orderBy("m_rank")), F.lit(0.0)))
    lanes = lanes.filter("m_slots > 0")
    # a lane lies in the cells it touches: as many rows as there are cells and lanes
    cells = lanes.withColumn(
        "m_cell",
        F.explode(F.sequence(F.floor(F.col("m_from") * CELLS), F.least(F.floor(F.col("m_to") * CELLS), F.lit(CELLS - 1).cast("bigint")))),
    )
    x = F.col("id") * GOLDEN
    points = spark.range(n).select(F.col("id").alias("m_slot"), (x - F.floor(x)).alias("m_x"))
    points = points.withColumn("m_cell", F.floor(F.col("m_x") * CELLS))
    dealt = (
        points.join(cells, "m_cell")
        .filter((F.col("m_x") >= F.col("m_from")) & (F.col("m_x") < F.col("m_to")))
        .select("m_slot", "m_rank", F.floor(F.col("m_slot") / SLOTS_PER_CHUNK).alias("m_chunk"))
    )
    ranked = row_ranks(dealt, ["m_rank"], "m_chunk", ["m_slot"], "m_k").select("m_slot", "m_rank", "m_k")
    got = dealt.groupBy("m_rank").agg(F.count(F.lit(1)).alias("m_got"))
    closing = (
        wanted.join(got, "m_rank", "left")
        .withColumn("m_got", F.coalesce("m_got", F.lit(0).cast("bigint")))
        .filter("m_got < m_slots")
        .select((F.lit(n) + F.col("m_rank")).cast("bigint").alias("m_slot"), "m_rank", F.explode(F.expr("sequence(m_got, m_slots - 1)")).alias("m_k"))
    )
    facts = wanted.select("m_rank", "m_total", "m_quota", "m_blocks", "m_slots")
    slots = ranked.unionByName(closing).join(facts, "m_rank").filter("m_k < m_slots")
    at = F.col("m_epoch") * F.col("m_total") + F.col("m_block") * block
    return (
        slots.withColumn("m_epoch", F.floor(F.col("m_k") / F.col("m_blocks")))
        .withColumn("m_block", F.col("m_k") % F.col("m_blocks"))
        .withColumn("m_take", F.least(F.lit(block).cast("bigint"), F.col("m_total") - F.col("m_block") * block, F.col("m_quota") - at))
        .select("m_slot", "m_rank", "m_epoch", "m_block", "m_take")
    )


def pieces(stream: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block it lies in, with its words' places in the block; one NULL block if it has none."""
    first = F.floor(F.col("m_start") / block)
    last = F.floor((F.col("m_start") + F.col("size") - 1) / block)
    cut = stream.withColumn("m_block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.col("m_block") * block
    return cut.withColumn("m_piece_from", F.greatest(F.col("m_start"), begin) - begin).withColumn(
        "m_piece_to", F.least(F.col("m_start") + F.col("size"), begin + block) - begin
    )


def mixture(sizes: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, a row per piece and slot: m_slot and m_epoch, doc_id, and the words taken.

    Pieces that no slot takes stay as a row with a NULL slot and no words.
    """
    sources = materialize(targets(sizes), "mix-sources")
    cut = pieces(streams(sizes, sources), block)
    joined = cut.join(schedule(sources, block), ["m_rank", "m_block"], "left")
    take = F.coalesce("m_take", F.lit(0).cast("bigint"))
    words = F.greatest(F.least(F.col("m_piece_to"), take) - F.col("m_piece_from"), F.lit(0))
    return joined.withColumn("m_words", F.coalesce(words, F.lit(0)).cast("bigint"))


def taken_per_document(sizes: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    keys: list[Column | str] = ["doc_id", "source", "size", "m_rank", "m_start", "m_total", "m_target"]
    # repeated rows without words share their place in the stream; a row number is not needed to keep them apart
    rows = mixture(sizes, block).groupBy(*keys).agg(F.sum("m_words").alias("taken"), F.count_if(F.col("m_block").isNull()).alias("m_empty"))
    return rows.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("m_empty"), F.lit(1).cast("bigint")).cast("int")))).select(
        "doc_id", "source", "size", F.col("m_total").alias("source_size"), F.col("m_target").alias("target"), "taken"
    )
