"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, white space collapsed) and hashed; for each host the distinct
documents that hold a line are counted. A line above the host's limit is boilerplate and is removed;
a document that keeps too little of its words is rejected, as is one that fails the base rules.

Copied documents must not turn their own lines into boilerplate; copies are the business of
deduplication. So a line is counted twice. First exact copies of a text count as one document; what is
above the limits then is a candidate. A line whose first or last five words are those of a candidate is
an edited candidate. A document of which both hold as much as two texts of similarity 0.8 have in
common, 8 of 9 words, may be a near copy: with all others whose longest candidate line is the same it
counts as one document when candidates are counted again. Lines that stand in many otherwise different
documents stay above the limits, even if little else stands there; lines that always come with the same
rest of a text do not.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, WORD, drop_stored, small_side, store

_LINE = r"lower(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ')))"
_WORD_SQL = WORD.replace("\\", "\\\\")

#: Words of repeated 3-word windows, from ``h``, the hashes of the windows in order.
_REPEAT = """CASE WHEN size(h) = size(array_distinct(h)) THEN 0L ELSE
  transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS p)))), s ->
    transform(array(sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)), x -> x.p))), q ->
      aggregate(transform(q, (x, i) -> least(3L, coalesce(get(q, i + 1) - x, 3L))), 0L, (a, x) -> a + x))[0])[0] END"""


#: Words at a line's ends that tell an edited line.
ENDS = 5


def document_stats(docs: DataFrame, host: str = "source", whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: base figures and ``lines``, an array of (hash, words, index, head, tail, first).

    ``head`` and ``tail`` are hashes of a line's first and last ENDS words. Words are runs of anything but ASCII white space; a null text has none. ``first`` marks a line's
    first occurrence in its document; only lines with a word count. With ``whole`` there is a column
    ``row``, too: all columns of ``docs``.
    """
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    keep = ["row"] if whole else []
    d = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"), *row)
    d = d.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), *keep)
    d = d.select(
        "doc_id", "host", "text_hash", *keep,
        F.size("w").cast("long").alias("n_words"),
        F.expr("length(array_join(w, ''))").cast("long").alias("word_chars"),
        F.expr(r"length(regexp_replace(text, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr(rf"filter(split(text, '\n', -1), l -> l rlike '{_WORD_SQL}')").alias("ls"),
        F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0L, size(w) - 3L), i -> xxhash64(get(w, cast(i as int)), get(w, cast(i + 1 as int)), get(w, cast(i + 2 as int)))) END").alias("h"),
    )
    lines = rf"""transform(array(transform(transform(ls, l -> split({_LINE}, ' ')), (n, i) -> struct(xxhash64(array_join(n, ' ')) AS h, i AS i, cast(size(n) AS long) AS words,
        xxhash64(slice(n, 1, {ENDS})) AS head, xxhash64(slice(n, greatest(size(n) - {ENDS - 1}, 1), {ENDS})) AS tail))), a ->
        transform(array(sort_array(a)), s -> transform(s, (x, i) -> struct(x.h AS h, x.words AS words, x.i AS i, x.head AS head, x.tail AS tail, NOT coalesce(get(s, i - 1).h = x.h, false) AS first)))[0])[0]"""
    return d.select(
        "doc_id", "host", "text_hash", *keep, "n_words", "word_chars", "n_symbols",
        F.expr("cast(size(ls) - size(array_distinct(ls)) as long)").alias("n_dup_lines"),
        F.expr(_REPEAT).alias("n_repeat_words"),
        F.expr(lines).alias("lines"),
    )


def frequent_lines(units: DataFrame, hosts: DataFrame, least_docs: int, host_share: float) -> DataFrame:
    """``host, frequent, heads, tails``: hashes of the lines that stand in more than ``least_docs`` units and ``host_share`` of a host's documents, and of their ends.

    ``units`` has rows (host, unit, h, head, tail), repeated or not: a line and what counts as one document;
    ``hosts`` the number of documents. A host's documents hold at most (lines of a document on
    average) / ``host_share`` such lines, so a host's arrays are short whatever its size.
    """
    ends = [F.min(x).alias(x) for x in ("head", "tail")]
    # Copies fall together first, then each line's units are counted; both steps combine before they shuffle.
    counts = units.groupBy("host", "h", "unit").agg(*ends).groupBy("host", "h").agg(F.count("*").alias("n"), *ends).where(F.col("n") > least_docs)
    counts = counts.join(small_side(hosts.toDF("host2", "docs")), F.col("host").eqNullSafe(F.col("host2")))
    return counts.where(F.col("n") > host_share * F.col("docs")).groupBy("host").agg(F.collect_list("h").alias("frequent"), F.collect_list("head").alias("heads"), F.collect_list("tail").alias("tails"))


def _with_arrays(stats: DataFrame, often: DataFrame) -> DataFrame:
    """``stats`` with its host's arrays, null where it has none."""
    # A host's arrays count as a hundred rows of the limit.
    often = small_side(often.withColumnRenamed("host", "host2"), SMALL_ROWS // 100)
    return stats.join(often, stats["host"].eqNullSafe(F.col("host2")), "left").drop("host2")


def boilerplate(stats: DataFrame, least_docs: int, host_share: float, copy_pct: int) -> DataFrame:
    """``host, frequent, heads, tails`` as above, near copies counted as one (see the module): ``copy_pct`` is the similarity, in per cent, from which documents are copies."""
    hosts = store(stats.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    line = [F.col(f"l.{x}").alias(x) for x in ("h", "head", "tail")]
    first = stats.select("host", F.col("text_hash").alias("unit"), F.explode("lines").alias("l")).where("l.first").select("host", "unit", *line)
    candidates = store(frequent_lines(first, hosts, least_docs, host_share), "candidates")
    held = _with_arrays(stats.select("host", "text_hash", "n_words", "lines"), candidates).where("frequent IS NOT NULL")
    held = held.withColumn("own", F.expr("filter(lines, l -> array_contains(frequent, l.h))")).where("size(own) > 0")
    longest = F.expr("array_max(transform(own, l -> struct(l.words AS words, -l.i AS at, l.h AS h))).h")
    common = F.expr("aggregate(filter(lines, l -> array_contains(frequent, l.h) OR array_contains(heads, l.head) OR array_contains(tails, l.tail)), 0L, (a, l) -> a + l.words)")
    copied = (100 + copy_pct) * common >= 2 * copy_pct * F.col("n_words")
    units = held.select("host", F.when(copied, longest).otherwise(F.col("text_hash")).alias("unit"), F.explode("own").alias("l")).where("l.first").select("host", "unit", *line)
    out = store(frequent_lines(units, hosts, least_docs, host_share), "frequent")
    drop_stored(hosts, candidates)
    return out


def quality_verdicts(docs: DataFrame, host: str = "source", least_docs: int = 20, host_share: float = 0.05, least_words: int = 50, most_repeat_pct: int = 50, most_removed_pct: int = 80, copy_pct: int = 80, whole: bool = False) -> DataFrame:
    """Verdict on each row of ``docs`` (doc_id, text, ``host``), which may have further columns.

    Returns doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_words, removed_lines (hashes), kept, and with ``whole`` the columns of
    ``docs`` as ``row``. ``base_failed``: under ``least_words`` words or more than ``most_repeat_pct``
    per cent of words in repeated 3-word windows. A document is depleted if frequent lines hold more
    than ``most_removed_pct`` per cent of its words or leave it under ``least_words`` words. Null or
    empty texts have no words and fail; a null host is a host of its own; equal rows get equal
    verdicts; an empty table gives an empty result.

    Texts are read once and never shuffled: only line hashes are, and a host's few frequent lines
    come back to its documents.
    """
    stats = store(document_stats(docs, host, whole), "stats")
    out = _with_arrays(stats, boilerplate(stats, least_docs, host_share, copy_pct))
    gone = F.expr("coalesce(array_intersect(transform(lines, l -> l.h), frequent), cast(array() AS array<bigint>))")
    out = out.withColumn("removed_lines", gone).drop("frequent", "heads", "tails")
    out = out.withColumn("removed_words", F.expr("aggregate(filter(lines, l -> array_contains(removed_lines, l.h)), 0L, (a, l) -> a + l.words)")).drop("lines")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_pct * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((100 * F.col("removed_words") > most_removed_pct * F.col("n_words")) | (F.col("n_words") - F.col("removed_words") < least_words))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, without their frequent lines."""
    v = quality_verdicts(docs, whole=True, **options).where("kept").select("row", "removed_lines")
    clean = F.expr(rf"array_join(filter(split(row.text, '\n', -1), l -> NOT (l rlike '{_WORD_SQL}' AND array_contains(removed_lines, xxhash64({_LINE})))), '\n')")
    changed = F.size("removed_lines") > 0
    v = v.withColumn("clean", F.when(changed, clean).otherwise(F.col("row.text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return v.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
