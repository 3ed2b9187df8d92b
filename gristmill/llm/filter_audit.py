"""How filters of documents interact: what each removes after the others, in every order.

Words are exploded into rows and counted by (document, word), then by document, for totals and
distinct words. Other flags come from the text itself, from copies of a text and from labels, and are
joined. What a document fails is a set of filters; one aggregation counts each of the 32 sets in a
column of its own, and every figure of every order follows from these counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"


def word_totals(rows: DataFrame, *key: str) -> DataFrame:
    """``key, words, distinct`` of the column ``text`` by key; keys without a word have no row.

    Rows of a key lie in one partition after one shuffle of the texts, so that both counts run where
    the words are made: (key, word) rows, more bytes than the texts, never travel.
    """
    words = rows.repartition(*key).select(*key, F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(*key, "word").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def filter_flags(docs: DataFrame, labels: DataFrame, part: str = "lang", least_words: int = 100, least_distinct_pct: int = 80, most_capital_pct: int = 10, marks: str = "[#$%&*|]") -> DataFrame:
    """What each document fails: ``doc_id, part, rows, words, distinct, a, b, c, d, e, good, toxic``.

    a: fewer than ``least_words`` words; b: a smaller share of distinct words than
    ``least_distinct_pct`` per cent; c: more than ``most_capital_pct`` per cent of the code points are
    A-Z; d: the text has one of ``marks``; e: a smaller doc_id has the same text. ``good`` and
    ``toxic``: some row of ``labels`` (doc_id, quality, toxic) says 1.

    Null texts are empty, with no words, and fail a alone (and e); a null ``part`` is the empty string.
    Rows equal in doc_id, text and part are one row here, ``rows`` of them. Rows of one doc_id are
    no copies of each other, and a null doc_id neither is nor has a copy. Further columns are ignored. An
    empty table gives an empty result.
    """
    d = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("t", F.xxhash64("text"))  # tells rows of one id apart
    key = ("doc_id", "t", "part")
    flags = d.select(
        *key, F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]++", "")) > most_capital_pct * F.length("text")).alias("c"),
        F.col("text").rlike(marks).alias("d"),
    ).groupBy(*key, "digest", "c", "d").agg(F.count("*").alias("rows"))
    totals = word_totals(d.select(*key, "text"), *key).toDF("id2", "t2", "part2", "words", "distinct")
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")) & (F.col("part") == F.col("part2"))
    # One row a text, joined by id: copies of a frequent text have different keys.
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "digest2")
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = flags.join(totals, same, "left").join(first, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("digest2")), "left").join(said, F.col("doc_id") == F.col("labelled"), "left")
    words, distinct = (F.coalesce(c, F.lit(0)) for c in ("words", "distinct"))
    # Equal rows were counted together.
    words = F.expr("coalesce(words, 0L) div rows")
    return out.select(
        "doc_id", "part", "rows", words.alias("words"), distinct.alias("distinct"),
        (words < least_words).alias("a"), (100 * distinct < least_distinct_pct * words).alias("b"), "c", "d",
        (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("e"),
        *(F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")),
    )


def failure_counts(flags: DataFrame) -> DataFrame:
    """``part`` and three arrays of 32 counts, ``n, good, toxic``: documents by the set of filters they fail (a is 1, b 2, c 4, d 8, e 16)."""
    failed = sum((F.when(F.col(x.lower()), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.sum(F.when((F.col("failed") == m) & is_kind, F.col("rows")).otherwise(0)).alias(f"{k}{m}") for k, is_kind in kinds.items() for m in range(32)]
    wide = flags.withColumn("failed", failed).groupBy("part").agg(*counts)
    return wide.select("part", *(F.array(*(f"{k}{m}" for m in range(32))).alias(k) for k in kinds))


def _sum(of: str, condition: str) -> Column:
    """Sum of the array ``of`` over the sets ``m`` that fit."""
    return F.expr(f"aggregate(filter(transform({of}, (x, m) -> named_struct('x', x, 'm', m)), s -> {condition.replace('$', 's.m')}), 0L, (a, s) -> a + s.x)")


def interaction_report(flags: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, with what the step's filter does there.

    ``kept``: documents left after the step; ``removed``: by its filter, here; ``redundant``: they fail it
    but are gone already; ``unique_fails``: they fail it only; ``good_lost, toxic_lost``: of those
    removed here; ``shapley``: all that the filter removes, over all orders.
    """
    bit = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - 65)"
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    steps = failure_counts(flags).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("f", F.expr(bit.format("step"))).withColumn("b", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (a, i) -> a + {bit.format('i')})"))
    here = "$ & f != 0 AND $ & b = 0"
    out = steps.select(
        "part", "filter_order", "step", "f",
        _sum("n", "$ & (b | f) = 0").alias("kept"), _sum("n", here).alias("removed"), _sum("n", "$ & f != 0 AND $ & b != 0").alias("redundant"),
        _sum("n", "$ = f").alias("unique_fails"), _sum("good", here).alias("good_lost"), _sum("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")
