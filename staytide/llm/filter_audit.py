"""Audit of how filters interact: what each removes, in any order, by relations of failing ids.

Each filter's failing documents are stored as a table of their keys. Documents pass these tables one after the other:
a left-semi join keeps those that the filter takes, a left-anti join those that it leaves, and both go on with what has
become of them, so that five pairs of joins place every document among those that fail the same filters. Documents of one
part that fail the same filters are alike in every order, so they go on as one row with counts.
Then, for each set of filters that may come before another (80 of them), the anti join with the relation of failing classes leaves
the survivors, a semi join of these with the next filter's relation gives what it removes, and a semi join of what the set took
gives what it would have removed in vain. The 120 orders share these sets.

Defined results: NULL texts count as empty, a NULL part as the empty string. A row's key is its id and its text, so
rows that share an id with different texts are judged apart, and repeated rows count as often as they come. A NULL
id is a copy of nothing, and nothing is a copy of it. A label counts if any of the id's label rows has it. Without documents there
is no row. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.words import text_of, words_of
from staytide.session import materialize

COUNTS = ["docs", "good", "toxic"]


def failing_text(text: Column | str) -> dict[str, Column]:
    """Conditions on a text alone: too few words, too few different ones, too many capitals, symbols."""
    t = text_of(text)
    words = words_of(t)
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def keyed(docs: DataFrame, failing: Mapping[str, Column], part: str = "source") -> DataFrame:
    """One slim row per document: doc_id, digest of the text, key of both, part, and a flag per filter."""
    flags = [F.coalesce(test, F.lit(False)).alias(f"fails_{name}") for name, test in failing.items()]
    digest = F.md5(text_of("text"))
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags
    )
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest")
    return slim.withColumn("key", key)


def later_copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose text a smaller id has too. Copies are counted before the shuffle."""
    known = rows.filter(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return known.join(first, "digest").filter(F.col("doc_id") > F.col("first")).select("key")


def failing_ids(rows: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """A stored table of keys per filter with a flag."""
    return {n: materialize(rows.filter(f"fails_{n}").select("key").distinct(), f"failing-{n}") for n in names}


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows as key, part, docs, good, toxic: repeated rows add up, rows without an id have no labels."""
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("bigint")).alias("is_good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("is_toxic")
    )
    counted = rows.groupBy("key", "part").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("docs"))
    told = counted.filter(F.col("doc_id").isNotNull()).join(judged, "doc_id", "left").unionByName(
        counted.filter(F.col("doc_id").isNull()), allowMissingColumns=True
    )
    share = {k: (F.col("docs") * F.coalesce(f"is_{k}", F.lit(0))).alias(k) for k in ("good", "toxic")}
    return told.select("key", "part", "docs", *share.values())


def classes(documents: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """part, failed (names of the filters that fail, in order), docs, good, toxic.

    Each table splits the documents by a semi and an anti join; the frame is written between two tables, as both
    joins read it.
    """
    state = documents.withColumn("failed", F.lit(""))
    for name, table in tables.items():
        state = materialize(state, f"audit-before-{name}")
        taken = state.join(table, "key", "left_semi").withColumn("failed", F.concat("failed", F.lit(name)))
        state = taken.unionByName(state.join(table, "key", "left_anti"))
    return state.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in COUNTS])


def prefixes(names: str) -> list[tuple[str, str]]:
    """All (set of filters that came before, next filter)."""
    return [("".join(s), f) for f in names for k in range(len(names)) for s in combinations([n for n in names if n != f], k)]


def audit(documents: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders.

    `documents`: key, part, docs, good, toxic. `tables`: failing keys by the filter's letter.
    """
    spark, names = documents.sparkSession, "".join(tables)
    sets = ["".join(s) for k in range(len(names) + 1) for s in combinations(names, k)]
    spots = prefixes(names)
    # relations of bounded size: which classes a set of filters takes, and which one filter fails
    taken = spark.createDataFrame([(before, c) for before in sets for c in sets if set(before) & set(c)], "before string, failed string")
    fails = spark.createDataFrame([(f, c) for f in names for c in sets if f in c], "filter string, failed string")
    pairs = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in spots])
    met = materialize(classes(documents, tables), "audit-classes").withColumn("at", F.explode(pairs)).select("*", "at.*").drop("at")
    by, which = ["before", "failed"], ["filter", "failed"]
    survivors = met.join(F.broadcast(taken), by, "left_anti")
    parts_of = {
        "removed": survivors.join(F.broadcast(fails), which, "left_semi"),
        "kept": survivors.join(F.broadcast(fails), which, "left_anti"),
        "redundant": met.join(F.broadcast(taken), by, "left_semi").join(F.broadcast(fails), which, "left_semi"),
        "neither": met.join(F.broadcast(taken), by, "left_semi").join(F.broadcast(fails), which, "left_anti"),
    }
    one = None
    for kind, rows in parts_of.items():
        rows = rows.withColumn("kind", F.lit(kind))
        one = rows if one is None else one.unionByName(rows)
    sum_of = lambda kind, of="docs": F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(of))), F.lit(0))
    fails_alone = F.col("failed") == F.col("filter")
    steps = one.groupBy("part", "before", "filter").agg(
        *[sum_of(k).alias(k) for k in ("kept", "removed", "redundant")],
        F.coalesce(F.sum(F.when(fails_alone, F.col("docs"))), F.lit(0)).alias("unique_fails"),
        sum_of("removed", "good").alias("good_lost"),
        sum_of("removed", "toxic").alias("toxic_lost"),
    )
    steps = materialize(steps, "audit-steps")
    # a set of k filters comes before the next one in k! (n - 1 - k)! orders
    k = F.length("before")
    weights = [F.lit(factorial(i) * factorial(len(names) - 1 - i)) for i in range(len(names))]
    shapley = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.element_at(F.array(*weights), k + 1)).alias("shapley"))
    orders = [("".join(sorted(o[:i])), o[i], "".join(o), i + 1) for o in permutations(names) for i in range(len(names))]
    # rows of the orders: a fixed number
    listed = spark.createDataFrame(orders, "before string, filter string, filter_order string, step int")
    told = steps.join(shapley, ["part", "filter"]).join(F.broadcast(listed), ["before", "filter"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over documents: the four on texts, and later copies of a text (E)."""
    tests = failing_text("text")
    rows = materialize(keyed(docs, tests, part), "audit-rows")
    tables = failing_ids(rows, list(tests))
    tables["E"] = materialize(later_copies(rows).distinct(), "failing-E")
    return audit(with_labels(rows, labels), tables)
