"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, its source's target over its source's size. The
whole part is certain. The fractional parts are rounded in pairs: one moves up and the other down
by the same number of words, at random and without bias, until one of them is whole; the other goes
on to the next pair. Small groups of documents are folded this way inside one row, what is left of
each group goes to the next level, and so on up a tree until one residual is left for each source.
As that tends to be a large document, it is drawn on its own and the words it gains or loses are
taken from, or given to, a pool of smaller documents, in three classes of falling size; each is
folded in the same way. A source's words so differ from its target by less than a small document,
wherever its pool has room.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, word_count

#: Documents that are folded in one row, on average.
FAN_IN = 48
#: Documents of a source that take up what the tree leaves over, and their sizes over the mean size.
POOL = 256
CLASSES = (2.0, 0.5, 0.125)
ITEM = ("id", "size", "m", "base", "p")


def source_targets(units: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Target of each source: ``source, source_size, units, target``.

    Sources in code point order, null last, take ``weights`` in turn and share the total size; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight.
    Solved in closed form: with sources ordered by their limit per unit of weight, those below the
    common level are at their limit. One row per source is ranked, not one per document.
    """
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    ordered = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("nth", F.row_number().over(ordered))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct("nth", "level"))).over(every)
    return s.withColumn("target", F.least("most", F.coalesce(free["level"] * F.col("w"), F.col("most")))).select("source", "source_size", "units", "target")


def _fold(seed: int, level: int) -> str:
    """SQL of one group's fold: from ``items`` to the decided items and the one left over.

    x is what has been carried, y the next item; up and down are the words that x can gain, or lose
    to y, before one of the two is whole.
    """
    item = "struct<id:bigint,size:bigint,m:bigint,base:bigint,p:double>"
    eps = "1e-9"
    whole = f"named_struct('id', z.id, 'size', z.size, 'm', z.m, 'base', z.base + cast(z.p > 0.5 as bigint), 'p', 0D)"
    settle = lambda z: whole.replace("z.", f"{z}.")
    moved = lambda z, by: f"named_struct('id', {z}.id, 'size', {z}.size, 'm', {z}.m, 'base', {z}.base, 'p', {z}.p + ({by}) / {z}.size)"
    is_whole = lambda z: f"({z}.p < {eps} or {z}.p > 1 - {eps})"
    u = f"(pmod(xxhash64({seed}, {level}, x.id, x.size, y.id, y.size), 9007199254740992L) / 9007199254740992D)"
    pair = f"""transform(array(named_struct('x', acc.left, 'y', it)), q -> transform(array(named_struct('x', q.x, 'y', q.y,
        'up', least((1 - q.x.p) * q.x.size, q.y.p * q.y.size), 'down', least(q.x.p * q.x.size, (1 - q.y.p) * q.y.size))),
        r -> transform(array(named_struct('x', r.x, 'y', r.y, 'd', if({u.replace("x.", "r.x.").replace("y.", "r.y.")} * (r.up + r.down) < r.down, r.up, -r.down))),
        t -> named_struct('x', {moved("t.x", "t.d")}, 'y', {moved("t.y", "-t.d")}))[0])[0])[0]"""
    step = f"""transform(array({pair}), v ->
        case when {is_whole("v.x")} and {is_whole("v.y")} then named_struct('left', cast(null as {item}), 'done', concat(acc.done, array({settle("v.x")}, {settle("v.y")})))
             when {is_whole("v.x")} then named_struct('left', v.y, 'done', concat(acc.done, array({settle("v.x")})))
             else named_struct('left', v.x, 'done', concat(acc.done, array({settle("v.y")}))) end)[0]"""
    return f"""aggregate(items, named_struct('left', cast(null as {item}), 'done', cast(array() as array<{item}>)),
        (acc, it) -> if(acc.left is null, named_struct('left', it, 'done', acc.done), {step}))"""


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 20, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document: ``doc_id, source, size, m, source_size, target, total``.

    ``docs`` has doc_id (long), text, source. One row per distinct (doc_id, source, size); ``m`` is
    how many rows share it and ``total`` how many copies they get together, at most ``most`` each.
    Null and empty texts have size 0 and never move words; a source without words has target 0.
    Null ids and null sources are values of their own. An empty table gives an empty plan.
    The draw depends on ids, sizes, sources and the seed alone, so reruns agree.
    """
    units = store(docs.select("doc_id", "source", word_count().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    targets = store(source_targets(units, weights, most), "targets")
    mass = F.col("m") * F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    items = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    items = items.withColumn("mass", F.when(F.abs(mass - F.round(mass)) < 1e-9, F.round(mass)).otherwise(mass))
    items = items.select("source", "units", "source_size", F.col("doc_id").alias("id"), "size", "m", F.floor("mass").cast("long").alias("base"), (F.col("mass") - F.floor("mass")).alias("p"))
    most_units = targets.agg(F.max("units")).first()[0] or 0
    keep = ["source", "id", "size", "m", "base"]
    done = [items.where("size = 0 or p = 0").select(*keep)]
    # A pool of smaller documents of each source is kept back, in classes of falling size.
    mean = F.col("source_size") / F.col("units")
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit("pool"), "id", "size"), F.greatest(F.lit(1), F.ceil(F.col("units") / float(POOL))).cast("long"))
    cls = F.lit(0)
    for k, share in enumerate(CLASSES):
        cls = F.when((part == 0) & (F.col("size") <= share * mean), k + 1).otherwise(cls)
    open_items = items.where("size > 0 and p > 0").withColumn("cls", cls)
    left = open_items.where("cls = 0")
    levels = max(1, math.ceil(math.log(max(most_units, 2), fan_in)))
    for level in range(levels + 1):
        groups = F.lit(1) if level == levels else F.greatest(F.lit(1), F.ceil(F.col("units") / float(fan_in ** (level + 1)))).cast("long")
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id", "size"), groups)
        rows = left.groupBy("source", at.alias("g")).agg(F.max("units").alias("units"), F.sort_array(F.collect_list(F.struct(*ITEM))).alias("items"))
        rows = store(rows.select("source", "units", F.expr(_fold(seed, level)).alias("s")), f"fold{level}")
        done.append(rows.select("source", F.explode("s.done").alias("d")).select("source", "d.id", "d.size", "d.m", "d.base"))
        left = rows.where("s.left is not null").select("source", "units", "s.left.*")
    # The residual of each source is drawn and its mass handed to the pool, class by class.
    for k in range(1, len(CLASSES) + 1):
        pool = open_items.where(F.col("cls") == k).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "id", "m", "base", "p")), asc=False).alias("raw"))
        pool = pool.withColumn("items", F.transform("raw", lambda x: F.struct(*[x[c].alias(c) for c in ITEM]))).drop("raw")
        carry = left.select(F.col("source").alias("s2"), F.struct(*ITEM).alias("carry"))
        rows = pool.join(carry, pool["source"].eqNullSafe(carry["s2"]), "full").select(F.when(F.col("items").isNull(), F.col("s2")).otherwise(F.col("source")).alias("source"), "items", "carry")
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-k), "carry.id", "carry.size"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        rows = rows.withColumn("up", draw < F.col("carry.p"))
        gain = F.when(F.col("up"), 1 - F.col("carry.p")).otherwise(-F.col("carry.p")) * F.col("carry.size")
        rows = rows.withColumn("gain", F.coalesce(gain, F.lit(0.0)))
        rows = rows.withColumn("low", F.expr("aggregate(items, 0D, (a, x) -> a + x.p * x.size)")).withColumn("high", F.expr("aggregate(items, 0D, (a, x) -> a + (1 - x.p) * x.size)"))
        moved = """transform(items, x -> named_struct('id', x.id, 'size', x.size, 'm', x.m, 'base', x.base, 'p',
            if(gain > 0, x.p * (1 - least(1D, gain / low)), x.p + (1 - x.p) * least(1D, -gain / high))))"""
        rows = rows.withColumn("items", F.expr(moved))
        folded = store(rows.select("source", "carry", "up", F.expr(f"if(items is null, null, {_fold(seed, 100 + k)})").alias("s")), f"pool{k}")
        done.append(folded.where("s is not null").select("source", F.explode("s.done").alias("d")).select("source", "d.id", "d.size", "d.m", "d.base"))
        done.append(folded.where("s is not null and carry is not null").select("source", "carry.id", "carry.size", "carry.m", (F.col("carry.base") + F.col("up").cast("long")).alias("base")))
        left = folded.where("s is null or s.left is not null").select("source", F.when(F.col("s").isNull(), F.col("carry")).otherwise(F.col("s.left")).alias("c")).select("source", "c.*")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "id", "size"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    done.append(left.select("source", "id", "size", "m", (F.col("base") + (draw < F.col("p")).cast("long")).alias("base")))
    plan = done[0]
    for d in done[1:]:
        plan = plan.unionByName(d)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return plan.join(t, plan["source"].eqNullSafe(t["s"])).select(F.col("id").alias("doc_id"), "source", "size", "m", "source_size", "target", F.col("base").alias("total"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Rows that share id, source and size share their copies as evenly as whole numbers allow.
    """
    p = mix_plan(docs, **options)
    row = p.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i"))
    copies = F.expr("total div m") + (F.col("i") <= F.col("total") % F.col("m")).cast("long")
    row = row.withColumn("copies", copies)
    return row.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, each as often as the mix takes it.

    Documents of size 0 count as taken once if the plan gives them a copy.
    """
    p = store(mix_plan(docs, **options), "plan").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "m", "total")
    p = p.toDF("_id", "_source", "_size", "_m", "_total")
    shared = p.agg(F.max("_m")).first()[0] or 1
    sized = docs.withColumn("_words", word_count())
    # The plan has a row a document, so both sides grow alike: merged at every size.
    out = sized.join(p.hint("merge"), sized["doc_id"].eqNullSafe(p["_id"]) & sized["source"].eqNullSafe(p["_source"]) & (sized["_words"] == p["_size"]))
    i = F.lit(1)
    if shared > 1:
        i = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("text")))
    out = out.withColumn("_copies", F.expr("_total div _m") + (i <= F.col("_total") % F.col("_m")).cast("long"))
    out = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[docs[c] for c in docs.columns])
