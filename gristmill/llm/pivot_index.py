"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its NEAREST nearest reference points (pivots) in order. Two vectors are
candidates if they share at least SHARED of them. Inverted lists hold, for each pivot, the vectors
that have it; as SHARED must be shared, a vector need only be posted under its
NEAREST - SHARED + 1 rarest pivots, and a candidate pair is looked at in the list of its first common
posting alone. Candidates are verified by cosine in double precision.

A list of more than LIST vectors is posted again under pairs of pivots (whoever shares SHARED pivots
shares a second one), then under triples; what is still too long there is cut into blocks and every
two blocks are compared in a task of their own. No list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stored, recorded, store
from .components import components

#: Reference points: a sample of so many vectors, those with the least hash of their id.
PIVOTS = 256
NEAREST = 10
SHARED = 3
LIST = 4096
#: Pivots have a cosine below this with each other.
APART = 0.6


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (little-endian floats); null, zero and empty vectors and those with a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_id, out_v = batch.column("vec_id").to_pylist(), [], []
            for i, e in enumerate(batch.column("embedding").to_pylist()):
                if not e or any(x is None for x in e):
                    continue
                x = np.asarray(e, np.float64)
                if np.isfinite(x).all() and x.any():
                    f = x.astype("<f4") + np.float32(0)  # one zero
                    out_id.append(ids[i])
                    out_v.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_v, pa.binary())], ["vec_id", "v"])

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def choose_pivots(nodes: DataFrame, pivots: int) -> np.ndarray:
    """``pivots`` reference vectors.

    From a sample of 8 times as many (those with the least hashes of their ids), each is taken that
    is not close to one taken before: pivots inside one dense group would be in a random order for its
    members. Fixed random directions fill up what is missing.
    """
    rows = nodes.select("v", "node").orderBy(F.xxhash64("node"), "node").limit(8 * pivots).collect()
    sample = _unit(np.stack([np.frombuffer(r["v"], "<f4") for r in rows]))
    fill = _unit(np.random.Generator(np.random.PCG64(64)).normal(size=(pivots, sample.shape[1])))
    taken = np.empty((0, sample.shape[1]))
    for x in sample:
        if len(taken) == pivots:
            break
        if not len(taken) or (taken @ x).max() < APART:
            taken = np.concatenate((taken, x[None]))
    return np.concatenate((taken, fill))[:pivots].astype(np.float32)


def describe(nodes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Adds ``perm``: the numbers of the ``nearest`` pivots, nearest first (16-bit, little-endian)."""
    unit = nodes.sparkSession.sparkContext.broadcast(_unit(pivots))
    nearest = min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = unit.value.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _unit(_matrix(batch.column("v"), dim)) @ unit.value.T
            order = np.argsort(-s, 1, kind="stable")[:, :nearest].astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("node"), batch.column("mult"), pa.array([r.tobytes() for r in order], pa.binary())], ["v", "node", "mult", "perm"])

    return nodes.mapInArrow(run, "v binary, node long, mult long, perm binary")


def _postings(described: DataFrame, rank: np.ndarray, posted: int) -> DataFrame:
    """``list`` (a pivot's place in the order of rarity), and the vector, for its ``posted`` rarest pivots."""
    place = described.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            perm = np.frombuffer(b"".join(batch.column("perm").to_pylist()), "<u2").reshape(batch.num_rows, -1)
            own = np.sort(place.value[perm], 1).astype("<u2")  # rarest first
            many = min(posted, own.shape[1])
            for j in range(many):
                yield pa.RecordBatch.from_arrays([pa.array(own[:, j].astype(np.int64)), batch.column("v"), batch.column("node"), batch.column("mult"), pa.array([r.tobytes() for r in own], pa.binary())], ["list", "v", "node", "mult", "own"])

    return described.mapInArrow(run, "list long, v binary, node long, mult long, own binary")


def _deeper(rows: DataFrame, depth: int, posted: int) -> DataFrame:
    """Postings of over-long lists once more, under each pivot after the last of the list's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), "<u2").reshape(batch.num_rows, -1).astype(np.int64)
            key = batch.column("list").to_numpy()
            last = key & 0xFFFF
            for j in range(min(posted + depth, own.shape[1])):
                on = np.flatnonzero(own[:, j] > last)
                if len(on):
                    b = batch.take(pa.array(on))
                    yield pa.RecordBatch.from_arrays([pa.array((key[on] << 16) | own[on, j]), *(b.column(c) for c in ("v", "node", "mult", "own"))], ["list", "v", "node", "mult", "own"])

    return rows.mapInArrow(run, "list long, v binary, node long, mult long, own binary")


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, dim: int, key: list[int], shared: int, least: float) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Links of candidates whose first common pivots are ``key``: counts by node, and links that span them."""

    def parts(g: pd.DataFrame) -> tuple:
        return _unit(np.frombuffer(b"".join(g["v"]), "<f4").reshape(-1, dim)), np.frombuffer(b"".join(g["own"]), "<u2").reshape(len(g), -1).astype(np.int64), g["node"].to_numpy(), g["mult"].to_numpy()

    x, own_x, node_x, mult_x = parts(left)
    y, own_y, node_y, mult_y = (x, own_x, node_x, mult_x) if right is None else parts(right)
    links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1024
    for a in range(0, len(x), step):
        for b in range(a if right is None else 0, len(y), step):
            s = x[a : a + step] @ y[b : b + step].T >= least
            if right is None and a == b:
                s = np.triu(s, 1)
            i, j = np.nonzero(s)
            if not len(i):
                continue
            i, j = i + a, j + b
            good = np.zeros(len(i), bool)
            for k in range(0, len(i), 1 << 15):
                u, v = own_x[i[k : k + (1 << 15)]], own_y[j[k : k + (1 << 15)]]
                same = (u[:, :, None] == v[:, None, :]).any(2)
                # The pair belongs to the list of its first common pivots.
                nth = np.cumsum(same, 1)
                ok = same.sum(1) >= shared
                for d, p in enumerate(key):
                    ok &= ((u == p) & same & (nth == d + 1)).any(1)
                good[k : k + (1 << 15)] = ok
            i, j = i[good], j[good]
            np.add.at(links_x, i, mult_y[j])
            np.add.at(links_y, j, mult_x[i])
            found.append((i, j))
    a, b = _spanning(found, node_x, node_y)
    counts: dict[int, int] = {}
    for nodes, links in ((node_x, links_x), (node_y, links_y)):
        for n, c in zip(nodes[links > 0].tolist(), links[links > 0].tolist(), strict=True):
            counts[n] = counts.get(n, 0) + c
    return a, b, counts


def _spanning(links: list[tuple[np.ndarray, np.ndarray]], node_x: np.ndarray, node_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links found here: (node, least node)."""
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = node_x[np.concatenate([a for a, _ in links])]
    j = node_y[np.concatenate([b for _, b in links])]
    nodes, back = np.unique(np.concatenate((i, j)), return_inverse=True)
    u, v = back[: len(i)], back[len(i) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        least = least[least]
        if (least == root).all():
            break
        root = least
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


_FOUND = "a long, b long, links long"


def _found(a: np.ndarray, b: np.ndarray, counts: dict[int, int]) -> pd.DataFrame:
    n = len(counts)
    return pd.DataFrame({"a": [*a.tolist(), *counts], "b": pd.array([*b.tolist(), *[None] * n], "Int64"), "links": pd.array([*[None] * len(a), *counts.values()], "Int64")})


def _key(number: int, depth: int) -> list[int]:
    return [(int(number) >> (16 * (depth - 1 - d))) & 0xFFFF for d in range(depth)]


def _whole_list(depth: int, dim: int, shared: int, least: float):
    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _found(*_compare(g, None, dim, _key(key[0], depth), shared, least))

    return one


def search(described: DataFrame, dim: int, least: float, pivots: int = PIVOTS, shared: int = SHARED, list_size: int = LIST) -> DataFrame:
    """Links of all candidates: rows (a, b) that span the components, and rows (a, links) to be summed."""
    posted = min(NEAREST, pivots) - shared + 1
    # How often each pivot occurs: one number for each pivot.
    count = np.zeros(pivots, np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(pivots, np.int64)
        for batch in batches:
            c += np.bincount(np.frombuffer(b"".join(batch.column("perm").to_pylist()), "<u2"), minlength=pivots)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pivots)), pa.array(c)], ["p", "n"])

    for r in described.select("perm").mapInArrow(tally, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
        count[r["p"]] = r["n"]
    rank = np.empty(pivots, np.int64)
    rank[np.lexsort((np.arange(pivots), count))] = np.arange(pivots)
    rows, found = _postings(described, rank, posted), None
    for depth in range(1, shared + 1):
        rows = store(rows, f"postings{depth}")
        sizes = rows.groupBy("list").agg(F.count("*").alias("size"))
        long_lists = store(sizes.where(F.col("size") > list_size).select("list", "size"), "long")
        any_long = not long_lists.isEmpty()
        short = rows.join(long_lists.select("list"), "list", "left_anti") if any_long else rows

        part = store(short.groupBy("list").applyInPandas(_whole_list(depth, dim, shared, least), _FOUND), "found")
        found = part if found is None else found.unionByName(part)
        if not any_long:
            return found
        rows = rows.join(long_lists, "list")
        if depth < shared:
            rows = _deeper(rows.drop("size"), depth, posted)
    # Lists that stay too long: every two blocks of a list meet in one task.
    blocks = F.ceil(F.col("size") / list_size).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def two(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        k = _key(key[0], shared)
        if key[1] == key[2]:
            return _found(*_compare(g, None, dim, k, shared, least))
        return _found(*_compare(g[g["block"] == key[1]], g[g["block"] == key[2]], dim, k, shared, least))

    part = rows.select("list", "lo", "hi", "block", "v", "node", "mult", "own").groupBy("list", "lo", "hi").applyInPandas(two, _FOUND)
    return found.unionByName(store(part, "found"))


def near_vectors(vectors: DataFrame, least: float = 0.95, pivots: int = PIVOTS) -> DataFrame:
    """Groups of near-duplicate vectors among all rows (vec_id, embedding), which may have further columns.

    Returns vec_id, n_links (other vectors with cosine >= ``least``), component_id (least vec_id
    reachable through links), kept. Equal vectors are one class and are linked with each other.
    Vectors that are null, empty, zero or hold null or non-finite components have no links; vectors of
    different lengths are never linked. A row with a null id has no links, a null component, and is
    kept; rows of one id count as vectors of their own that share a component. An empty table gives
    an empty result. ``pivots``: from SHARED to 65,536 reference points.
    """
    bound_batches(vectors.sparkSession)
    member = store(usable(vectors), "vectors")
    nodes = store(member.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")), "classes")
    widths = [r[0] for r in nodes.select(F.expr("length(v) div 4")).distinct().collect()]
    spark = vectors.sparkSession
    every = spark.createDataFrame([], _FOUND)
    with recorded() as made:
        for dim in widths:
            own = nodes.where(F.length("v") == 4 * dim)
            described = store(describe(own, choose_pivots(own, pivots), NEAREST), "described")
            every = every.unionByName(search(described, dim, least, pivots))
    every = store(every, "every") if widths else every
    drop_stored(*made)
    counts = every.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    member = member.join(nodes, "v").select("vec_id", "node", "mult")
    same = member.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    roots = components(every.where("b is not null").select("a", "b").unionByName(same))
    per = member.join(counts, "node", "left").groupBy("vec_id").agg(F.max(F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = vectors.select("vec_id").join(per, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

