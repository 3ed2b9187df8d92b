"""How far the sources of a language differ in the terms they use.

Terms become integers. Partial counts of (lang, term) by source are dealt out by term and sorted, so that a
task holds whole terms; it cuts them into chunks, finds the terms that stay, and keeps them as a sorted
array: a term's id is its place there (searchsorted), and so ids keep UTF-8 order. Counts of a chunk become
one dense vector a source (bincount by id). With the totals known, the chunks are compared one by one:
whole columns of numbers, exact in 64 bits, ties broken by id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, bound_batches, drop_stored, store
from .kernels import PIECE, pieces

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Terms that a task counts before it hands them on, and kept terms of a chunk.
HELD, CHUNK = 500_000, 4096
#: Ten to the ninth in steps that keep 64-bit products exact up to 9 * 10^15 occurrences.
_STEP, _STEPS = 1000, 3

_COUNTS = "key binary, source string, docs long, n long"
_CHUNKS = "lang string, terms array<binary>, sources array<string>, counts array<long>"
_VALUES = "lang string, source string, part string, item string, value long"


def _add(text: bytes, total: Counter, docs: Counter) -> None:
    """Count the terms of a text, and each distinct one once in ``docs``."""
    seen, at = set(), 0
    while at < len(text):
        m = _GAP.search(text, at + PIECE) if len(text) - at > 2 * PIECE else None
        end = m.start() if m else len(text)
        terms = _TERM.findall(text, at, end)
        total.update(terms)
        seen.update(terms)
        at = end
    docs.update(seen)


def term_counts(docs: DataFrame) -> DataFrame:
    """``key, source, docs, n``: in how many documents of a source a term stands, and how often; rows of one term are to be added up.

    ``key`` is the language, a null byte and the term, which has none: one column to sort by. A task hands on what it holds
    when that grows past HELD terms and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, found) in held.items():
                start, terms = lang.encode() + b"\0", list(total)
                for k in range(0, len(terms), 1 << 14):
                    part = terms[k : k + (1 << 14)]
                    cols = [pa.array([start + t for t in part], pa.binary()), pa.array([source] * len(part)), *(pa.array(np.fromiter(map(c.__getitem__, part), np.int64, len(part))) for c in (found, total))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "source", "docs", "n"])
            held.clear()

        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                for text, lang, source in zip(texts, piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True):
                    _add(text.lower(), *held.setdefault((lang, source), (Counter(), Counter())))  # bytes: only A-Z change
                if sum(len(x) for x, _ in held.values()) > HELD:
                    yield from handed()
        yield from handed()

    bound_batches(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def _kept(rows: pa.Table, least_docs: int) -> tuple[list[bytes], pa.ChunkedArray, np.ndarray, np.ndarray]:
    """The terms of sorted ``rows`` that stay, in order; and the sources, ids and counts of their rows."""
    key = rows.column("key").combine_chunks()
    starts = np.concatenate(([0], np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1))
    spread = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    stays = spread >= least_docs
    row_stays = np.repeat(stays, np.diff(np.append(starts, len(key))))
    at = np.flatnonzero(row_stays)
    ids = np.searchsorted(starts[stays], at, "right") - 1
    return key.take(pa.array(starts[stays])).to_pylist(), rows.column("source").take(pa.array(at)), ids, rows.column("n").to_numpy()[at]


class _Chunks:
    """Kept terms of one language, with their counts by source, until there are enough for a chunk."""

    def __init__(self, chunk: int) -> None:
        self.chunk, self.lang = chunk, b""
        self.clear()

    def clear(self) -> None:
        self.terms, self.sources, self.ids, self.counts = [], [], [], []

    def add(self, keys: list[bytes], sources: pa.ChunkedArray, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs = [k[: k.rindex(b"\0")] for k in keys]
        at = 0
        while at < len(keys):
            if langs[at] != self.lang:
                yield from self.made()
                self.lang = langs[at]
            end = at + 1
            while end < len(keys) and end - at + len(self.terms) < self.chunk and langs[end] == self.lang:
                end += 1
            a, b = np.searchsorted(ids, (at, end))
            self.ids.append(ids[a:b] - at + len(self.terms))
            self.sources += sources.slice(a, b - a).to_pylist()
            self.counts.append(counts[a:b])
            self.terms += [k[len(self.lang) + 1 :] for k in keys[at:end]]
            at = end
            if len(self.terms) >= self.chunk:
                yield from self.made()

    def made(self) -> Iterator[pa.RecordBatch]:
        if self.terms:
            names, source = np.unique(np.array(self.sources, object), return_inverse=True)
            cell, n, size = source * len(self.terms) + np.concatenate(self.ids), np.concatenate(self.counts), len(names) * len(self.terms)
            # Halves of 32 bits: bincount adds floats, which are exact up to 2^53.
            low, high = (np.bincount(cell, w, size).astype(np.int64) for w in (n & 0xFFFFFFFF, n >> 32))
            cols = [pa.array([self.lang.decode()]), pa.array([self.terms], pa.list_(pa.binary())), pa.array([names.tolist()], pa.list_(pa.string())), pa.array([low + (high << 32)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "terms", "sources", "counts"])
        self.clear()


def term_chunks(counts: DataFrame, least_docs: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the kept terms: ``lang, terms, sources, counts`` (a dense vector for each source, one after another).

    ``counts`` has rows as ``term_counts`` gives them. A term stays if at least ``least_docs`` documents of
    its language hold it. A chunk is at most ``chunk`` kept terms of a language in order; all rows of a term are in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest = _Chunks(chunk), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            # The last term may go on in the next batch; its rows are added up meanwhile.
            key = rows.column("key")
            last = pc.equal(key, key[-1]).to_numpy()
            first = int(len(last) - np.count_nonzero(last))
            rest = rows.slice(first).group_by(["key", "source"]).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(["key", "source", "docs", "n"])
            if first:
                yield from out.add(*_kept(rows.slice(0, first), least_docs))
        if rest is not None:
            yield from out.add(*_kept(rest, least_docs))
        yield from out.made()

    return counts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _CHUNKS)


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 * count / size)`` for 0 <= count <= size, exactly."""
    out = np.zeros(np.broadcast(count, size).shape, np.int64)
    rest = np.broadcast_to(count, out.shape)
    for _ in range(_STEPS):
        whole, rest = np.divmod(rest * _STEP, size)
        out = out * _STEP + whole
    return 1 + out


class _Compared:
    """What a task's chunks of one language add to each pair of sources, and each source's first terms in them."""

    def __init__(self, lang: str, groups: list[dict], v: int) -> None:
        self.lang, self.names, self.v = lang, [s["source"] for s in groups], v
        self.n = np.array([s["n"] for s in groups], np.int64)[:, None]
        self.pairs = np.zeros((len(groups), len(groups)), np.int64)
        self.tops: list[list[tuple[int, bytes]]] = [[] for _ in groups]

    def add(self, terms: list[bytes], sources: list[str], vectors: np.ndarray, top: int) -> None:
        counts = np.zeros((len(self.names), len(terms)), np.int64)
        counts[np.searchsorted(np.array(self.names, object), np.array(sources, object))] = vectors.reshape(-1, len(terms))
        p = shares(counts + 2, self.n + 2 * self.v)
        q = shares(counts.sum(0) + 2, self.n.sum() + 2 * self.v)
        for a in range(len(self.names)):
            f = ((p[a] - p[a + 1 :]) ** 2 // (p[a] + p[a + 1 :])).sum(1)
            self.pairs[a, a + 1 :] += f
            self.pairs[a + 1 :, a] += f
            own = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            f = (p[a, own] - q[own]) ** 2 // (p[a, own] + q[own])
            first = np.argsort(-f, kind="stable")[:top]  # the first of equals by id
            self.tops[a] = sorted([*self.tops[a], *((-int(f[k]), terms[own[k]]) for k in first)])[:top]

    def made(self) -> Iterator[pa.RecordBatch]:
        def rows(source: str, part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
            k = len(items)
            cols = [pa.array([x] * k, pa.string()) for x in (self.lang, source, part)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])

        for a, name in enumerate(self.names):
            yield rows(name, "pair", self.names[:a] + self.names[a + 1 :], np.delete(self.pairs[a], a).tolist())
            yield rows(name, "term", [t.decode() for _, t in self.tops[a]], [-f for f, _ in self.tops[a]])


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs`` (text, lang, source; others are ignored).

    Terms are runs of letters A-Z, a-z and anything beyond ASCII, A-Z lower-cased. A language keeps the
    V terms that stand in ``least_docs`` of its rows. A kept term that a group holds ``count`` times has
    the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)) there, N the group's occurrences of kept terms;
    q likewise for the whole language or another source; f = floor((p - q)^2 / (p + q)). Part ``pair``:
    each other source of the language with the sum of f over all kept terms, 0 if none is kept. Part
    ``term``: the ``top`` kept terms that the group has, with p over the language's q. Ranks go by value
    descending, then item by UTF-8.

    Null lang, source and text are empty strings; empty texts have no term but their group is there;
    repeated rows are documents of their own; an empty table gives an empty result. The pairs are the
    square of a language's sources, as asked for; all else grows with terms and documents.
    """
    d = docs.select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("lang", "source", "text")))
    chunks = store(term_chunks(term_counts(d), least_docs), "chunks")
    sums = F.expr("transform(sources, (s, i) -> struct(s AS source, aggregate(slice(counts, i * size(terms) + 1, size(terms)), 0L, (a, x) -> a + x) AS n))")
    held = chunks.select("lang", F.explode(sums).alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = store(d.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n")).unionByName(held).groupBy("lang", "source").agg(F.sum("n").alias("n")), "groups")
    kept = chunks.groupBy(F.col("lang").alias("lang2")).agg(F.sum(F.size("terms")).cast("long").alias("v"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    langs = store(langs.join(kept, F.col("lang") == F.col("lang2"), "left").select("lang", "groups", F.coalesce("v", F.lit(0)).alias("v")), "langs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Compared] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                r = {x: row.column(x)[0].as_py() for x in ("lang", "terms", "sources", "v")}
                if r["lang"] not in held:
                    held[r["lang"]] = _Compared(r["lang"], row.column("groups")[0].as_py(), r["v"])
                held[r["lang"]].add(r["terms"], r["sources"], row.column("counts")[0].values.to_numpy(), top)
        for x in held.values():
            yield from x.made()

    # A language's array has a row of the limit for each source.
    side = F.broadcast(langs) if groups.count() <= SMALL_ROWS else langs.hint("merge")
    found = store(chunks.join(side, "lang").mapInArrow(run, _VALUES), "values")
    pairs = langs.select("lang", "groups.source", F.explode("groups.source").alias("item")).select("lang", F.explode("source").alias("source"), F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(pairs.where("source != item")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    out = store(pairs.withColumn("rank", rank).unionByName(terms), "divergence")
    drop_stored(chunks, groups, langs, found)
    return out
