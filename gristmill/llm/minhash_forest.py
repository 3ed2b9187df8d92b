"""Near-duplicates by an LSH forest, confirmed on full shingle sets.

Documents with equal shingle sets are one node. Each node has TREES labels of DEPTH min-hash values.
A tree is the sorted order of its labels, spread over tasks by range partitioning with the node as
last key, so equal labels can be cut anywhere. The length of the prefix that neighbouring labels share
is computed for every step of an order; a node's candidates are the rows on both sides with the
longest. Where few labels share a prefix these reach up to a short one; where thousands do, they share
a long one, so the depth adapts to each region and the candidates stay in proportion to the nodes.
Neighbours across task boundaries are joined through the ends of each task's run.

A candidate whose sketch agrees too little is not confirmed; the limit is four standard deviations
below the wanted similarity. The others are confirmed on full sets in two rounds: each node's best two
first; then, of the rest, all that join what is still apart. In a group of thousands of copies nearly
all candidates fall away before they cost anything.

Where more rows share a prefix of CROWD values than the window reaches, the order alone could leave a
pair out. Nodes of such runs form regions, and each region is finished on the full sets, whatever the
sketches say: every node outside the region's largest component is compared with every node of
another component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop_stored, small_side, store, stored_bytes, width
from .components import components
from .kernels import U, pieces, shingle_set, word_hashes

TREES, DEPTH = 20, 8
HASHES = TREES * DEPTH
#: Neighbours on each side in an order, and the share of the 64 sketch bytes that must agree.
WINDOW = 8
#: Tasks, or blocks of them, whose ends meet in one task.
MEET = 256
SKETCH = 64
#: Rows that share so many values of a label, WINDOW of them or more, are a crowded run. A pair at
#: similarity 0.8 shares as many in one of the trees but for 3 in 100,000.
CROWD = 4
#: Nodes of a region that a task holds while the region's other components pass by.
BLOCK = 256
#: Below the wanted similarity by about four standard deviations of the estimate.
MARGIN = 0.19

_rng = np.random.Generator(np.random.PCG64(715517))
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LANE = 1 << 15


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES min-hash values (32 bits) of each non-empty sorted set."""
    out = np.full((HASHES, len(sets)), 0xFFFFFFFF, np.uint32)
    for first in range(0, len(sets), 64):
        group = sets[first : first + 64]
        x = np.concatenate(group)
        x = (x ^ (x >> U(32))).astype(np.uint32)
        ends = np.cumsum([len(s) for s in group])
        for a in range(0, len(x), _LANE):
            part = x[a : a + _LANE]
            lo = int(np.searchsorted(ends, a, "right"))
            hi = int(np.searchsorted(ends, a + len(part), "left")) + 1
            cut = np.maximum(np.concatenate(([0], ends[lo : hi - 1])) - a, 0)
            cut[0] = 0
            at = slice(first + lo, first + hi)
            for k in range(HASHES):
                v = (part ^ _XOR[k]) * _MUL[k]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                v ^= v >> np.uint32(13)
                np.minimum(out[k, at], np.minimum.reduceat(v, cut), out=out[k, at])
    return out.T


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the whole set) ``, sig`` (16 bits of each value); empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
        for batch in batches:
            for piece in pieces(batch):
                h, at = word_hashes(piece.column(1).to_pylist())
                sets = [shingle_set(h[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
                full = [s for s in sets if len(s)]
                sig = iter((min_hashes(full) >> np.uint32(16)).astype(">u2")) if full else iter(())
                rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), next(sig).tobytes()) if len(s) else (0, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def forest_rows(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: ``tree, label, node, sketch``; ``nodes`` has node, sig."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    step = HASHES // SKETCH
    # A byte of every second value, from all trees alike.
    sketch = F.unhex(F.concat(*[F.substring(F.hex("sig"), 4 * step * k + 3, 2) for k in range(SKETCH)]))
    rows = nodes.select("node", "sig", sketch.alias("sketch")).select(trees, "node", "sig", "sketch")
    return rows.select("tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("label"), "node", "sketch")


def common_prefix(trees: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How many leading values each row's label shares with that of the row before; 0 for the first and in a new tree."""
    if not len(trees):
        return np.empty(0, np.int64)
    differ = labels[1:] != labels[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), labels.shape[1])
    return np.concatenate(([0], np.where(trees[1:] == trees[:-1], shared, 0)))


def _near(lcp: np.ndarray, nodes: np.ndarray, sk: np.ndarray, least: float, fresh: int | None = None) -> list[np.ndarray]:
    """Pairs of the WINDOW rows on each side that share the longest prefixes, if their sketches agree.

    Rows are in order, so the longest prefix that two rows share is the least of the steps between
    them, and falls with the distance: the nearest rows are those with the longest. A row of
    the result is (node, node, bytes that agree, length of the prefix).
    """
    found, shared = [], lcp[1:]
    for w in range(1, min(WINDOW, len(nodes) - 1) + 1):
        if w > 1:
            shared = np.minimum(shared[:-1], lcp[w:])
        i = np.flatnonzero((shared > 0) & (nodes[w:] != nodes[:-w]))
        if fresh is not None:  # only pairs across the boundary
            i = i[(i < fresh) & (i + w >= fresh)]
        for k in range(0, len(i), 1 << 16):
            j = i[k : k + (1 << 16)]
            agree = (sk[j] == sk[j + w]).sum(1, dtype=np.int64)
            good = agree >= least * SKETCH
            j, agree = j[good], agree[good]
            found.append(np.stack([np.minimum(nodes[j], nodes[j + w]), np.maximum(nodes[j], nodes[j + w]), agree, shared[j]], 1))
    return found


def _crowded(lcp: np.ndarray, nodes: np.ndarray, least: int) -> np.ndarray:
    """Pairs of each row of a run of ``least`` rows or more that share CROWD values, with the run's first row."""
    new = lcp < CROWD
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    i = np.flatnonzero((size[run] >= least) & ~new)
    return np.stack([nodes[first[run[i]]], nodes[i]], 1)


def _columns(batch: pa.RecordBatch) -> tuple:
    n = batch.num_rows
    label = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(n, DEPTH)
    sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
    return common_prefix(batch.column("tree").to_numpy(), label), batch.column("node").to_numpy(), sk


def candidates(rows: DataFrame, least: float, parts: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``a, b, agree, prefix``: neighbours in any order whose sketches agree well enough, each pair once; ``a, b`` that ties the nodes of crowded runs; and the stored tables behind both."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    out = "a long, b long, agree int, prefix int, part int, side int, pos int, tree int, label binary, sketch binary"
    names = [c.split()[0] for c in out.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tail, head_left = TaskContext.get().partitionId(), None, WINDOW

        def ends(side: int, rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            own = {"a": rows.column("node"), "part": pa.array([part] * n, pa.int32()), "side": pa.array([side] * n, pa.int32()), "pos": pa.array(range(n), pa.int32()), "tree": rows.column("tree"), "label": rows.column("label"), "sketch": rows.column("sketch")}
            return pa.RecordBatch.from_arrays([own[c].cast(k) if c in own else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if head_left:
                yield ends(0, batch.slice(0, head_left))
                head_left = 0
            now = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            lcp, nodes, sk = _columns(now)
            tied = _crowded(lcp, nodes, WINDOW)
            # A tie has -1 for the agreement.
            p = np.concatenate([*_near(lcp, nodes, sk, least), np.column_stack([tied, np.full((len(tied), 2), -1)])])
            m = len(p)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2], pa.int32()), pa.array(p[:, 3], pa.int32()), *(pa.nulls(m, k) for k in kinds[4:])], names)
            tail = now.slice(max(0, now.num_rows - WINDOW))
        if tail is not None:
            yield ends(1, tail)

    made = store(ordered.mapInArrow(run, out), "neighbours")
    pairs = made.where("b is not null AND agree >= 0").select("a", "b", "agree", "prefix")
    ties = made.where("agree < 0").select("a", "b")
    # The ends of each task's run: a few rows a task, met block by block, and the blocks' ends again, up a tree.
    edges, levels = made.where("b is null").select("a", "part", "side", "pos", "tree", "label", "sketch"), [made]

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.rename(columns={"a": "node"}).to_dict("records")
        seam, tied, head, tail = _seams(rows, least)
        found = [(x, y, agree, prefix, *[None] * 6) for x, y, agree, prefix in seam] + [(x, y, -1, -1, *[None] * 6) for x, y in tied]
        ends = [(e["node"], None, None, None, int(key[0]), side, k, e["tree"], e["label"], e["sketch"]) for side, end in ((0, head), (1, tail)) for k, e in enumerate(end)]
        return pd.DataFrame([*found, *ends], columns=names).astype({c: "Int64" for c in names if c not in ("label", "sketch")})

    blocks = parts
    while blocks > 1:
        blocks = -(-blocks // MEET)
        met = store(edges.withColumn("block", F.expr(f"part div {MEET}").cast("int")).groupBy("block").applyInPandas(meet, out), "seams")
        pairs = pairs.unionByName(met.where("b is not null AND agree >= 0").select("a", "b", "agree", "prefix"))
        ties = ties.unionByName(met.where("agree < 0").select("a", "b"))
        edges = met.where("b is null").select("a", "part", "side", "pos", "tree", "label", "sketch")
        levels.append(met)
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"), F.max("prefix").alias("prefix")), ties.distinct(), levels


def _seams(edges: list[dict], least: float) -> tuple[list[tuple[int, ...]], list[tuple[int, int]], list[dict], list[dict]]:
    """Pairs of neighbours on two sides of a boundary between runs, ties of rows there that share a prefix, and the first and last rows of all."""
    parts = sorted({e["part"] for e in edges})
    tails, heads = ({p: sorted((e for e in edges if e["part"] == p and e["side"] == side), key=lambda e: e["pos"]) for p in parts} for side in (1, 0))
    found, tied, before, first, whole = [], [], [], [], True
    for p in parts:
        run = [*before, *heads[p]]
        if before:
            label = np.frombuffer(b"".join(bytes(e["label"]) for e in run), ">u2").reshape(-1, DEPTH)
            lcp, nodes = common_prefix(np.asarray([e["tree"] for e in run]), label), np.asarray([e["node"] for e in run])
            # How far a run goes on in the tasks is not known here: two rows are enough.
            tied += [tuple(map(int, r)) for r in _crowded(lcp, nodes, 2)]
            sk = np.frombuffer(b"".join(bytes(e["sketch"]) for e in run), np.uint8).reshape(-1, SKETCH)
            for x in _near(lcp, nodes, sk, least, fresh=len(before)):
                found += [tuple(map(int, r)) for r in x]
        if whole:  # runs shorter than the window go on in the next
            first = [*first, *heads[p]][:WINDOW]
            whole = len(heads[p]) < WINDOW
        before = [*before, *tails[p]][-WINDOW:] if len(heads[p]) < WINDOW else tails[p]
    return found, tied, first, before


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, text`` of the documents whose id is in ``ids``, a stored table with ``node``."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    return named.join(small_side(ids), "node", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those with 100 * intersection >= percent * union of their full sets.

    b's text travels to a's task; a's partners are dealt into slices, so a node with many partners is
    read by several tasks. One text is held at a time beside a's set. ``texts`` is a stored table.
    """
    parts = width(pairs.sparkSession, 8 * stored_bytes(texts))
    slices = F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")
    p = pairs.select("a", "b", slices.alias("slice"))
    # One join brings every text that a task needs: a's own, once a slice, and its partners'.
    asked = p.select(F.col("b").alias("node"), "a", "slice", "b").unionByName(p.select(F.col("a").alias("node"), "a", "slice").distinct().withColumn("b", F.lit(None).cast("long")))
    both = asked.join(texts.hint("merge"), "node").select("a", "slice", "b", "text")
    both = both.repartition(parts, "a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in batches:
            for piece in pieces(batch):
                a, s, b = (piece.column(c).to_pylist() for c in ("a", "slice", "b"))
                h, at = word_hashes(piece.column("text").to_pylist())
                ok_a, ok_b = [], []
                for i in range(piece.num_rows):
                    x = shingle_set(h[at[i] : at[i + 1]], shingle)
                    if key != (a[i], s[i]):
                        key, mine = (a[i], s[i]), []
                    if b[i] is None:
                        mine.append(x)
                        continue
                    for m in mine:
                        if not len(m) or not len(x):
                            continue
                        small, large = min(len(x), len(m)), max(len(x), len(m))
                        if 100 * small < percent * large:
                            continue
                        same = len(np.intersect1d(m, x, assume_unique=True))
                        if 100 * same >= percent * (len(m) + len(x) - same):
                            ok_a.append(a[i])
                            ok_b.append(b[i])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(ok_a, pa.int64()), pa.array(ok_b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose ends have different roots."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def regions(ties: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root, region, blocks, apart`` for crowded regions of several components; ``apart``: not of the largest."""
    r = components(ties).withColumnRenamed("root", "region").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = r.groupBy("region", "root").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("region").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("roots > 1")
    return r.join(whole, "region").select("node", "root", "region", "blocks", (F.col("root") != F.col("main")).alias("apart"))


def finish(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b``: links between components inside each region, from the full sets of all pairs that are apart.

    A region is dealt into blocks. A task holds the sets of one block, and the nodes that are apart pass
    by one at a time; each gives one link with each component that it is linked with in the block.
    """
    parts = width(members.sparkSession, 8 * stored_bytes(texts))
    m = members.join(texts.hint("merge"), "node")
    held = m.select("region", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("passing"), "node", "root", "text")
    passing = m.where("apart").select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("passing"), "node", "root", "text")
    both = held.unionByName(passing).repartition(parts, "region", "block").sortWithinPartitions("region", "block", "passing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, nodes, roots, block = None, [], [], [], None
        for batch in batches:
            for piece in pieces(batch):
                region, part, passes, node, root = (piece.column(c).to_pylist() for c in ("region", "block", "passing", "node", "root"))
                h, at = word_hashes(piece.column("text").to_pylist())
                ok_a, ok_b = [], []
                for i in range(piece.num_rows):
                    x = shingle_set(h[at[i] : at[i + 1]], shingle)
                    if key != (region[i], part[i]):
                        key, sets, nodes, roots, block = (region[i], part[i]), [], [], [], None
                    if not len(x):
                        continue
                    if not passes[i]:
                        sets.append(x)
                        nodes.append(node[i])
                        roots.append(root[i])
                        continue
                    if not sets:
                        continue
                    if block is None:
                        known, place = np.unique(np.concatenate(sets), return_inverse=True)
                        size = np.array([len(s) for s in sets])
                        block = known, place.astype(np.int32), np.cumsum(size) - size, size, np.array(nodes), np.array(roots)
                        sets = [None]
                    known, place, start, size, who, whose = block
                    k = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    mark = np.zeros(len(known), np.int32)
                    mark[k[known[k] == x]] = 1
                    same = np.add.reduceat(mark[place], start).astype(np.int64)
                    good = np.flatnonzero((whose != root[i]) & (100 * same >= percent * (size + len(x) - same)))
                    _, one = np.unique(whose[good], return_index=True)
                    ok_a += [node[i]] * len(one)
                    ok_b += who[good[one]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ok_a, pa.int64()), pa.array(ok_b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicates among all ``docs`` (doc_id, text), which may have further columns.

    Returns one row per row of ``docs``: doc_id, n_shingles (distinct shingles of the whole text),
    component_id (least doc_id reachable through links), kept (doc_id = component_id). Two documents
    are linked if 100 * intersection >= ``percent`` * union of their sets of ``shingle`` words; a
    shorter text is one shingle; one without words has none and is linked with nothing. Rows that
    share a doc_id are one document: they share a component. A row with a null id gets a null
    component and is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marks = store(sketches(docs, shingle), "sketches")
    sets = store(marks.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "sets")
    least = max(0.0, percent / 100 - MARGIN)
    # A tree's row is about a third of a stored set's.
    pairs, ties, made = candidates(forest_rows(sets.select("node", "sig")), least, width(spark, TREES * stored_bytes(sets) // 3))
    pairs, ties = store(pairs, "pairs"), store(ties, "ties")
    drop_stored(*made)
    sides = [t.select(F.col(c).alias("node")) for t in (pairs, ties) for c in ("a", "b")]
    ends = store(reduce(DataFrame.union, sides).distinct(), "ends")
    texts = store(texts_of(docs, ends), "texts")
    drop_stored(ends)
    both = pairs.select("a", "b", "agree", "prefix", F.col("a").alias("n")).union(pairs.select("a", "b", "agree", "prefix", F.col("b").alias("n")))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("agree"), F.desc("prefix"), "a", "b"))).where("r <= 2").select("a", "b").distinct()
    best = store(best, "best")
    first = store(confirm(best, texts, shingle, percent), "links")
    roots = components(first)
    rest = store(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), roots), "rest")
    links = store(first.unionByName(confirm(rest, texts, shingle, percent)), "links")
    drop_stored(pairs, best, first, roots, rest)
    # What crowded runs may have left out, on the full sets.
    roots = components(links)
    crowd = store(regions(ties, roots), "crowd")
    # Rows of one id with different texts, and equal sets, are linked as they stand.
    same = marks.where("digest is not null and doc_id is not null").join(sets.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    every = store(links.unionByName(finish(crowd, texts, shingle, percent)).unionByName(same), "links")
    drop_stored(links, ties, roots, crowd, texts, sets)
    roots = components(every)
    drop_stored(every)
    out = marks.select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each group of near-duplicates.

    Only ids travel: those of documents that go, and those that several rows share. Of several rows
    with one id that stays, the one whose columns hash least is kept; rows without an id cannot be
    told apart and stay. An empty table gives an empty result.
    """
    groups = store(near_duplicates(docs, shingle, percent).where("doc_id is not null").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "groups")
    ids = groups.select(F.col("doc_id").alias("_id"), "kept")
    single = docs.join(small_side(ids.select("_id")), docs["doc_id"] == F.col("_id"), "left_anti")
    again = docs.join(small_side(ids.where("kept").select("_id")), docs["doc_id"] == F.col("_id"), "left_semi")
    order = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    again = again.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where("_n = 1").select(*docs.columns)
    return single.unionByName(again)
