"""Quality rules as a short-circuit cascade of column expressions.

Everything stays in DataFrame functions: words and their 3-word windows are
arrays inside the row, so a document is never exploded or shuffled.

Repeats are found by sorting one long per window, its hash in the high bits and
its position in the low ones (as many as the document needs, so at most 2^-54
per pair of windows of an ordinary document that two different ones meet).

The bound loosens as a text grows (64 bits less the logarithm of its words), and
equal keys are not compared further: DataFrame functions on arrays have no
cheap way to, and at a million words the chance of any such pair is 3 %.

Defined results: a null or empty text has no words, all counts are 0 and it
fails the base rule; a null ``doc_id`` is an id like any other; documents of any
length are read whole; ties and repeated rows are judged alike; an empty table
gives an empty table; the input's other columns, whatever their names, are kept
out unless named in ``keep``.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

SYMBOLS = "[^#*$%&|<>]"
#: Rows that the costs and selectivities are measured on, about.
SAMPLE_ROWS = 2000
#: How often a sampled row is judged for a rule's cost, and the least cost that is told from none.
REPEATS, LEAST_SECONDS = 3, 0.002

#: Rules: name -> expression that is true for a document to reject. Each reads the
#: text (and base counts) itself, so a document that an earlier rule rejects
#: never pays for it.
RULES: dict[str, str] = {
    "symbols": "n_symbols > 0.25 * n_words",
    "duplicate_lines": "n_dup_lines > 0.5 * n_lines",
    "word_length": "word_chars < 2.5 * n_words OR word_chars > 15 * n_words",
    "capitals": "length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > 0.5 * word_chars",
    "marks": "length(regexp_replace(text, '[^!?]+', '')) > 0.5 * n_words",
    "digits": "length(regexp_replace(text, '[^0-9]+', '')) > 0.6 * word_chars",
    "letters": "length(regexp_replace(text, '[^\\\\p{L}]+', '')) < 0.3 * word_chars",
}


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text and the base counts."""
    one = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    # A leading or trailing separator makes one empty piece at either end.
    two = one.withColumn("words", F.filter(F.split("text", SPACE_CLASS), lambda w: w != ""))
    three = two.withColumn("n", F.size("words"))
    bits = "CAST(ceil(log2(n + 2)) AS INT)"
    keys = F.expr(
        f"CASE WHEN n >= 4 THEN transform(slice(words, 1, n - 2), (w, i) -> shiftleft(xxhash64(w, words[i + 1], words[i + 2]), {bits}) | i) ELSE array() END"
    )
    four = three.withColumn("keys", F.sort_array(keys.cast("array<bigint>")))
    five = four.withColumn(
        "twice",
        F.expr(
            f"sort_array(transform(filter(keys, (k, i) -> coalesce(shiftright(k, {bits}) = shiftright(get(keys, i - 1), {bits}), false) "
            f"OR coalesce(shiftright(k, {bits}) = shiftright(get(keys, i + 1), {bits}), false)), k -> k & (shiftleft(1L, {bits}) - 1)))"
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE_CLASS, "") != "")
    six = five.withColumn("lines", lines)
    return six.select(
        *keep,
        "text",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS + "+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("aggregate(transform(twice, (p, i) -> least(3, coalesce(get(twice, i + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def cascade_order(counted: DataFrame, rules: dict[str, str] | None = None) -> list[str]:
    """Rule names by rejection per cost, best first, measured on the sample ``counted``.

    The order changes the time only: a document is kept if no rule rejects it.
    """
    rules = RULES if rules is None else rules
    sample = counted.cache()
    try:
        if sample.isEmpty():
            return list(rules)
        hits = sample.agg(F.count("*").alias("all"), *[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()]).first()
        # Each row is judged several times in a job, and what a job costs without a rule is taken off.
        often = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(expression: str) -> float:
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                often.agg(F.count_if(F.expr(expression))).collect()
                best = min(best, time.perf_counter() - began)
            return best

        nothing = seconds("again < 0")
        cost = {name: max(seconds(expression) - nothing, LEAST_SECONDS) for name, expression in rules.items()}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda k: -(hits[k] + 0.5) / (hits["all"] + 1) / cost[k])


def verdicts(docs: DataFrame, rules: dict[str, str] | None = None, keep: tuple[str, ...] = ("doc_id",), rows: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` (no rule of the cascade rejected it) for every document.

    ``rows`` is the table's size if the caller knows it (else it is counted).
    """
    rules = RULES if rules is None else rules
    rows = docs.count() if rows is None else rows
    share = min(1.0, sample_rows / max(rows, 1))
    order = cascade_order(with_counts(docs.sample(False, share, 7) if share < 1 else docs, keep), rules)
    first = F.when(base_failed(), F.lit("base"))
    for name in order:  # CASE WHEN stops at the first branch that holds
        first = first.when(F.expr(rules[name]), F.lit(name))
    judged = with_counts(docs, keep).withColumn("failed_rule", first)
    return judged.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("failed_rule").isNull().alias("kept")
    )
