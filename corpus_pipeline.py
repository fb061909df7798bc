"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder and hands
what it rereads to the next stage. All stages but the last return the columns of documents.

Rows with a NULL text go at the first stage (an empty text fails the base rules); columns beyond those of
documents pass through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staytide.llm import mixing, order_minhash, packing, pii, quality
from staytide.session import materialize
from staytide.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return order_minhash.keep_first(docs)


def _row(docs: DataFrame) -> Column:
    """The given columns as one struct, so that no working column can clash with them."""
    return F.struct(*docs.columns).alias("row")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows."""
    clean = pii.find_spans(docs.select("text", _row(docs))).select("row", pii.redacted().alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(dict(docs.dtypes).get("n_chars", "int"))}
    return clean.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: never, once or twice.

    Ids are unique by now; a row with a NULL id, if any, stays once.
    """
    taken = mixing.taken_per_document(mixing.sized(docs))
    times = (
        taken.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0))
        .groupBy("doc_id")
        .agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times"))
    )
    copies = docs.select("doc_id", _row(docs)).join(times, "doc_id", "left")
    n = F.when(F.col("doc_id").isNull(), 1).otherwise(F.coalesce("times", F.lit(0)))
    return copies.select("row", F.explode(F.array_repeat(F.lit(1), n))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

# SQL cannot express the learned rules, the alignment and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
