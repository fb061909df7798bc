"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staytide.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the learned decision list over all documents."""
    from staytide.llm import quality

    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    from staytide.llm import pii

    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count_of(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.spans_text("p_base"), 256).alias("base_sha256"),
        pii.spans_text("p_spans").alias("spans"),
    )


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from staytide.llm import mixing

    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.taken_per_document(sizes).select("doc_id", "size", "source_size", "target", "taken")


# A source's stream is taken from its start up to the target, over again once used up.
ORACLES["op7_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per_source AS (
  SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rk % 3 + 1] AS w, total::DOUBLE * 2 AS lim FROM per_source),
leveled AS (
  SELECT *, lim / w AS ratio,
    (sum(total::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY lim / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, total, rk,
    least((SELECT level FROM leveled WHERE level <= ratio ORDER BY ratio, rk LIMIT 1) * w, lim) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, a.total, a.target, least(floor(a.target + 0.5), a.total * 2) AS quota,
    coalesce(sum(s.size) OVER (PARTITION BY a.rk ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target,
  CAST(greatest(least(start + size, quota) - start, 0) + greatest(least(start + size, quota - total) - start, 0) AS BIGINT) AS taken
FROM placed
"""


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and group of every document."""
    from staytide.llm import order_minhash

    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    from staytide.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated bytes dropped from every document."""
    from staytide.llm import suffix_dedup

    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query
def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and Pitman-Yor scores of all documents, learned from six sevenths of them."""
    from staytide.llm import pitman_yor

    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"), train)


@query
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from staytide.llm import itq

    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from staytide.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labels."""
    from staytide.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = toxicity.character_model(docs)
    classifier = toxicity.learn(docs, labels, fold != 0, model)
    return toxicity.score(docs, model, classifier).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, removals and losses of five filters in all orders, by source."""
    from staytide.llm import filter_audit

    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
split AS (SELECT d.*, f.first, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w FROM docs d JOIN firsts f ON d.t = f.t),
judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
marked AS (
  SELECT s.part, coalesce(j.good, 0) AS good, coalesce(j.toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN s.doc_id > first THEN 16 ELSE 0 END) AS m
  FROM split s LEFT JOIN judged j ON s.doc_id = j.doc_id),
filters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
sets AS (SELECT DISTINCT own, before FROM steps),
counted AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, m),
told AS (
  SELECT part, own, before, sum(CASE WHEN m & (before + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & before = 0 AND m & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & before > 0 AND m & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, sets GROUP BY part, own, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told JOIN steps USING (own, before)
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which repeat a stretch of theirs."""
    from staytide.llm import periodic

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.runs_of(periodic.exercised(docs)))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document among those of equal text."""
    from staytide.llm import stream_dedup

    found = stream_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op13_exact_dedup"] = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""
