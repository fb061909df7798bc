"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression.

Statistics of a text are column expressions. The learner bins them, grows a conjunction of thresholds
that covers low-quality rows, prunes it on rows kept apart, and goes on with the rows that no rule
covers yet. Every step is a small aggregate; the result is an ordered list of rules that `verdict`
turns into CASE WHEN. Nothing here leaves the DataFrame API.

Defined results: NULL text counts as empty; an empty or blank text has zero words and fails the base
rules; missing statistics count as 0; rows with NULL or other labels are not learned from; without
labelled rows of both classes the list is empty and only the base rules reject.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.words import text_of, words_of
from staytide.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Labelled rows to learn from; the first ones by a hash of the id.
LABELLED_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """Reject a row if every (statistic, '>' or '<=', threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    support: int

    def column(self) -> Column:
        test = F.lit(True)
        for name, side, cut in self.conditions:
            value = F.coalesce(F.col(name), F.lit(0.0))
            test = test & (value > cut if side == ">" else value <= cut)
        return test


def _kept_length(text: Column, but: str) -> Column:
    """Code points of the given class."""
    return F.length(F.regexp_replace(text, f"[^{but}]+", "")).cast("bigint")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds q_* columns: counts over the whole text, and the shares the learner looks at."""
    t = F.col("q_text")
    base = docs.withColumn("q_text", text_of(text)).withColumn("q_words", words_of(t))
    hashed = base.withColumn("q_n_words", F.size("q_words").cast("bigint")).withColumn(
        "q_windows",
        F.expr(
            "CASE WHEN size(q_words) < 3 THEN cast(array() AS array<struct<h:bigint,i:int>>) ELSE "
            "sort_array(transform(sequence(0, size(q_words) - 3), i -> named_struct("
            "'h', xxhash64(get(q_words, i), get(q_words, i + 1), get(q_words, i + 2)), 'i', i))) END"
        ),
    )
    # equal windows are neighbours once sorted
    repeated = hashed.withColumn(
        "q_repeated",
        F.expr(
            "transform(filter(q_windows, (x, k) -> x.h <=> get(q_windows, k - 1).h OR x.h <=> get(q_windows, k + 1).h), "
            "x -> x.i)"
        ),
    )
    lines = "filter(split(q_text, '\\n'), x -> btrim(x, ' \\t\\n\\u000b\\f\\r') != '')"
    counted = repeated.withColumns(
        {
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("bigint"),
            "q_n_symbols": _kept_length(t, "#*$%&|<>"),
            "q_upper": _kept_length(t, "A-Z"),
            "q_digits": _kept_length(t, "0-9"),
            "q_shouts": _kept_length(t, "!?"),
            "q_distinct": F.size(F.array_distinct("q_words")),
            "q_lines": F.expr(lines),
            "q_n_repeat_words": F.expr(
                "cast(size(array_distinct(concat(q_repeated, transform(q_repeated, i -> i + 1), "
                "transform(q_repeated, i -> i + 2)))) AS bigint)"
            ),
        }
    ).drop("q_windows", "q_repeated", "q_words", "q_text")
    n, chars = F.col("q_n_words"), F.col("q_word_chars")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    n_lines = F.size("q_lines")
    return counted.withColumns(
        {
            "q_n_dup_lines": (n_lines - F.size(F.array_distinct("q_lines"))).cast("bigint"),
            "q_word_length": share(chars, n),
            "q_symbol_share": share(F.col("q_n_symbols"), chars),
            "q_symbols_per_word": share(F.col("q_n_symbols"), n),
            "q_upper_share": share(F.col("q_upper"), chars),
            "q_digit_share": share(F.col("q_digits"), chars),
            "q_shouts_per_word": share(F.col("q_shouts"), n),
            "q_distinct_share": share(F.col("q_distinct"), n),
            "q_repeat_share": share(F.col("q_n_repeat_words"), n),
            "q_line_length": share(n, n_lines),
        }
    ).withColumn("q_dup_line_share", share(F.col("q_n_dup_lines"), n_lines)).drop("q_lines")


SHARES = (
    "q_word_length",
    "q_symbol_share",
    "q_symbols_per_word",
    "q_upper_share",
    "q_digit_share",
    "q_shouts_per_word",
    "q_distinct_share",
    "q_repeat_share",
    "q_line_length",
    "q_dup_line_share",
)


def base_failed() -> Column:
    n = F.col("q_n_words")
    return (n < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * n)


def learn_rules(
    rows: DataFrame,
    label: str,
    features: Sequence[str] = SHARES,
    *,
    bins: int = 24,
    max_rules: int = 12,
    max_conditions: int = 3,
    min_support: int = 8,
    min_precision: float = 0.97,
) -> list[Rule]:
    """Sequential covering. `rows` holds numbers and a 0/1 label, where 1 is what rules shall cover.

    Two thirds of the rows grow rules by FOIL gain, one third prunes them; the split follows a hash of the
    statistics. A rule enters the list if it is right for `min_precision` of the rows it covers.
    The driver sees one histogram of (statistic, bin) per step.
    """
    names = list(features)
    cuts_at = [k / bins for k in range(1, bins)]
    clean = rows.filter(F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("_y"),
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
    )
    found = (
        clean.groupBy("_y")
        .agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(n, cuts_at, 10_000).alias(n) for n in names])
        .collect()
    )
    if len(found) < 2:
        return []
    edges = {n: sorted({x for row in found for x in row[n]}) for n in names}

    def bin_of(n: str) -> Column:
        edge_array = F.array(*[F.lit(float(x)) for x in edges[n]])
        return F.size(F.filter(edge_array, lambda e: e < F.col(n)))

    binned = materialize(
        clean.select("_y", (F.pmod(F.xxhash64(*names), F.lit(3)) == 2).alias("_prune"), F.array(*map(bin_of, names)).alias("_b")),
        "rule-bins",
    )

    def holds(conditions) -> Column:
        test = F.lit(True)
        for f, side, k in conditions:
            at = F.get("_b", F.lit(f))
            test = test & (at > k if side == ">" else at <= k)
        return test

    def counts(frame: DataFrame, tests: Sequence[Column]) -> list[tuple[int, int]]:
        sums = [F.count_if(t & (F.col("_y") == y)).alias(f"c{i}_{y}") for i, t in enumerate(tests) for y in (1, 0)]
        row = frame.agg(*sums).first()
        return [(row[f"c{i}_1"], row[f"c{i}_0"]) for i in range(len(tests))]

    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(max_rules):
        grow = binned.filter(~F.col("_prune") & left)
        conditions: list[tuple[int, str, int]] = []
        while len(conditions) < max_conditions:
            best = _best_condition(grow.filter(holds(conditions)), len(names), min_support)
            if best is None or best[0] in conditions:
                break
            conditions.append(best[0])
            if best[1] == 0:
                break
        if not conditions:
            break
        # prune: the shortest prefix that is as good on the rows kept apart
        prefixes = [conditions[: k + 1] for k in range(len(conditions))]
        kept_apart = counts(binned.filter(F.col("_prune") & left), [holds(p) for p in prefixes])
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in kept_apart]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        conditions = prefixes[k]
        ((p, n),) = counts(binned.filter(left), [holds(conditions)])
        if p < min_support or p / (p + n) < min_precision:
            break
        # bin > k says value > cut k, and bin <= k says value <= cut k
        rules.append(Rule(tuple((names[f], side, edges[names[f]][c]) for f, side, c in conditions), p / (p + n), p))
        left = left & ~holds(conditions)
    return rules


def _best_condition(rows: DataFrame, n_features: int, min_support: int):
    """((statistic, side, bin), negatives left) of the highest FOIL gain, from one histogram."""
    cells = (
        rows.select("_y", F.posexplode("_b").alias("_f", "_k"))
        .groupBy("_f", "_k")
        .agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("n"))
        .collect()
    )
    best, best_gain = None, 1e-9
    for f in range(n_features):
        own = sorted((c["_k"], c["p"], c["n"]) for c in cells if c["_f"] == f)
        p_all, n_all = sum(c[1] for c in own), sum(c[2] for c in own)
        if not p_all or not n_all:
            continue
        before = math.log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for k, p, n in own[:-1]:
            p_low, n_low = p_low + p, n_low + n
            for side, pp, nn in (("<=", p_low, n_low), (">", p_all - p_low, n_all - n_low)):
                if pp >= min_support:
                    gain = pp * (math.log2(pp / (pp + nn)) - before)
                    if gain > best_gain:
                        best, best_gain = ((f, side, k), nn), gain
    return best


def verdict(rules: Sequence[Rule]) -> Column:
    """CASE WHEN over the rules in order: false where one rejects the row, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = LABELLED_ROWS) -> DataFrame:
    """At most `rows` labelled documents, the first by a hash of the id; a bound that allows the broadcast."""
    h = F.xxhash64(F.col("doc_id").cast("bigint"))
    some = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .select("doc_id", F.col(label).alias("_label"))
        .orderBy(h, "doc_id", "_label")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def learn_from_labels(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules for documents labelled quality = 0. Rows the base rules reject anyway are left out."""
    # written first: a filter on computed columns would be pushed below them, and work them out per element
    known = materialize(with_statistics(labelled_sample(docs, labels, "quality", rows)).drop("text"), "rule-rows")
    return learn_rules(known.filter(~base_failed()).withColumn("_low", 1 - F.col("_label")), "_low")


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds the statistics, base_failed and kept."""
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def keep(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that the rules keep, with their columns.

    The row number ties the filter to its place above the statistics, which are worked out once.
    """
    # the user's columns as one struct, so that none can clash with the statistics
    judged = judge(docs.select("text", F.struct(*docs.columns).alias("row")), rules).withColumn("q_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("q_row") >= 0)).select("row.*")
