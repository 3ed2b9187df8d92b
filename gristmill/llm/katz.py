"""Language-model scoring by Katz backoff.

A model of order n with Good-Turing discounts and exactly normalised backoff weights, over all
training documents. A word w after a context v of k - 1 words has P(w | v) = d(r) r / c(v) if the k words
were seen r times, else a(v) P(w | v without its first word), recursively down to single words, where
what the discounts leave is the probability of the unknown word. The weight a(v) is what the
discounts leave of v, over the lower order's probability of the words not seen after v, so each
context's probabilities sum to one. Before a document stand as many begin marks as a context is long.

Tokens are 64-bit word hashes, and so are n-grams. Texts are read once and kept as chunks: a list of
distinct words and the running text as places in that list. From then on only distinct items travel:

1. Each chunk asks for the counts of its distinct n-grams of every order, as sorted blocks of keys
   dealt out by hash, with its own training counts. A frequent word is one key a chunk, so no key is hot.
2. The task that holds a share of the keys sums the counts of all chunks and answers every chunk, in
   the order it asked in. One of the chunks that hold an n-gram is told to account for it.
3. Each chunk, with its answers, scores its documents as far as seen n-grams go, order by order, and
   gives its part of each context's sums (for the weights), and the contexts of unseen n-grams.
4. The weights are a table by order and context; documents look up those of their unseen n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stored, store, width
from .kernels import U, mix, pieces, word_hashes
from .langid import held_out

#: Words of an n-gram in production.
ORDER = 2
#: Tokens of a chunk, and keys of a block that is answered at once.
CHUNK_TOKENS = 1 << 20
BLOCK_KEYS = 1 << 16
#: Counts up to this are discounted by Good-Turing; above, by RELIABLE, so every context leaves something.
GT_MOST = 5
RELIABLE = 1e-3
END_HASH = np.uint64(0x656E645F6F665F64)
BEGIN_HASH = np.uint64(0x626567696E5F6F66)

CHUNKS = "chunk string, docs binary, held binary, lengths binary, vocab binary, stream binary, tokens long"
ASKED = "share int, kind int, chunk string, keys binary, counts binary"
ANSWERS = "chunk string, kind int, share int, counts binary, n1 array<long>, total long, types long"


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit keys as steps, byte by byte: the high bytes of the steps are nearly all zero."""
    step = np.diff(x, prepend=U(0))
    return zlib.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """The corpus as chunks of about CHUNK_TOKENS tokens; ``docs`` has doc_id, text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids, held, lengths, tokens, size = [], [], [], [], 0

        def give() -> pa.RecordBatch:
            nonlocal ids, held, lengths, tokens, size
            all_tokens = np.concatenate(tokens)
            vocab, stream = np.unique(all_tokens, return_inverse=True)
            row = {
                "chunk": uuid.uuid4().hex, "docs": _pack(np.asarray([-1 if i is None else i for i in ids], np.int64)), "held": _pack(np.asarray([2 * (i is None) + h for i, h in zip(ids, held, strict=True)], np.uint8)),
                "lengths": _pack(np.asarray(lengths, np.int64)), "vocab": _planes(vocab), "stream": _pack(np.ascontiguousarray(stream.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)), "tokens": len(all_tokens),
            }
            ids, held, lengths, tokens, size = [], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.string()), *((c, pa.binary()) for c in ("docs", "held", "lengths", "vocab", "stream")), ("tokens", pa.int64())]))

        for batch in batches:
            for piece in pieces(batch):
                h, at = word_hashes(piece.column("text").to_pylist())
                n = np.diff(at) + 1
                out = np.insert(h, at[1:], END_HASH)
                ids += piece.column("doc_id").to_pylist()
                held += piece.column("held_out").to_pylist()
                lengths += n.tolist()
                tokens.append(out)
                size += len(out)
                if size >= CHUNK_TOKENS:
                    yield give()
        if size:
            yield give()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's documents and its distinct n-grams of each order, sorted by hash as it asks for them."""

    def __init__(self, row: dict, order: int) -> None:
        self.name = row["chunk"]
        self.docs = _unpack(row["docs"], "<i8")
        flags = _unpack(row["held"], np.uint8)
        self.null, self.held = flags >= 2, (flags & 1).astype(bool)
        self.lengths = _unpack(row["lengths"], "<i8")
        raw = _unpack(row["stream"], np.uint8).reshape(4, -1)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.training = np.repeat(~self.held, self.lengths)
        #: By order: the distinct keys, and which of them ends at each token.
        self.keys = [_unplanes(row["vocab"])]
        self.at = [np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)]
        #: By order from 2: each token's context.
        self.context = []
        words, begin = self.keys[0][self.at[0]], BEGIN_HASH
        key = words
        for _ in range(1, order):
            context = np.empty_like(key)
            context[1:] = key[:-1]
            context[self.starts] = begin
            key = mix(context * U(0xD1342543DE82EF95) + words)
            begin = mix(np.asarray([begin + U(1)]))[0]
            distinct, at = np.unique(key, return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at)
            self.context.append(context)

    def asked(self, shares: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(share, order, keys, training counts) of each block."""
        for kind, (keys, at) in enumerate(zip(self.keys, self.at, strict=True), 1):
            counts = np.bincount(at[self.training], minlength=len(keys))
            present, cut = dealt_out(keys, shares)
            for s, a, b in zip(present, cut[:-1], cut[1:], strict=True):
                yield s, kind, _planes(keys[a:b]), _pack(counts[a:b].astype(np.uint32))


def dealt_out(keys: np.ndarray, shares: int) -> tuple[list[int], list[int]]:
    """The shares that sorted keys fall into, and where each begins, then the end.

    A share is a range of the hash space. Only shares with a key are named, so a chunk has no more
    blocks than distinct keys, however many shares the corpus needs (below 2**32 of them).
    """
    share = ((keys >> U(32)) * U(shares)) >> U(32)
    starts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1])))
    return share[starts].tolist(), [*starts.tolist(), len(keys)]


def _answer(kind: int, rows: list[tuple[str, np.ndarray, np.ndarray]], share: int) -> Iterator[dict]:
    keys = np.concatenate([k for _, k, _ in rows])
    counts = np.concatenate([c for _, _, c in rows]).astype(np.int64)
    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(back, counts, minlength=len(distinct)).astype(np.int64)
    owner = np.zeros(len(keys), bool)
    owner[first] = True
    # The low bit tells which chunk accounts for the item.
    given = (total[back] << 1 | owner).astype(np.uint64)
    seen = total[total > 0]
    n = np.bincount(np.minimum(seen, GT_MOST + 2), minlength=GT_MOST + 3)[: GT_MOST + 2]
    at = 0
    for k, (chunk, own, _) in enumerate(rows):
        part = given[at : at + len(own)]
        at += len(own)
        wide = bool(len(part)) and int(part.max()) >= 1 << 32
        data = np.ascontiguousarray(part.astype(np.uint64 if wide else np.uint32))
        size = 8 if wide else 4
        packed = bytes([size]) + zlib.compress(np.ascontiguousarray(data.view(np.uint8).reshape(-1, size).T).tobytes(), 1)
        yield {"chunk": chunk, "kind": kind, "share": share, "counts": packed, "n1": n.tolist() if k == 0 else None, "total": int(seen.sum()) if k == 0 else None, "types": len(seen) if k == 0 else None}


def _given(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = b[0]
    raw = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(size, -1)
    x = np.ascontiguousarray(raw.T).view(np.uint64 if size == 8 else np.uint32).ravel().astype(np.int64)
    return x >> 1, (x & 1).astype(bool)


def _ask(table: DataFrame, shares: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("share", pa.int32()), ("kind", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row, order)
                for s, kind, keys, counts in c.asked(shares):
                    yield pa.RecordBatch.from_pylist([{"share": s, "kind": kind, "chunk": c.name, "keys": keys, "counts": counts}], schema)

    return table.mapInArrow(run, ASKED)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _answers(asked: DataFrame, parts: int) -> DataFrame:
    """Answers to each chunk; a task holds one share of one order at a time."""
    dealt = asked.repartition(parts, "kind", "share").sortWithinPartitions("kind", "share", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.string()), ("kind", pa.int32()), ("share", pa.int32()), ("counts", pa.binary()), ("n1", pa.list_(pa.int64())), ("total", pa.int64()), ("types", pa.int64())])
        key, held = None, []

        def give() -> Iterator[pa.RecordBatch]:
            if held:
                for r in _answer(key[0], held, key[1]):
                    yield pa.RecordBatch.from_pylist([r], schema)

        for batch in batches:
            for row in _rows(batch):
                if key != (row["kind"], row["share"]):
                    yield from give()
                    key, held = (row["kind"], row["share"]), []
                held.append((row["chunk"], _unplanes(row["keys"]), _unpack(row["counts"], np.uint32)))
        yield from give()

    return dealt.mapInArrow(run, ANSWERS)


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r from 0 to GT_MOST, and for more at the end; n[r] is how many items were seen r times.

    Katz's form of Good-Turing. Where counts are too sparse for it (a discount out of 0 to 1), (r - 0.5) / r.
    """
    d = np.full(GT_MOST + 2, 1 - RELIABLE)
    d[0] = 0
    common = (GT_MOST + 1) * n[GT_MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT_MOST + 1):
        good = n[r] and common < 1
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if good else 0.0
        d[r] = x if 0 < x < 1 - RELIABLE else (r - 0.5) / r
    return d


def _seen_p(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, GT_MOST + 1)] * counts


SCORED = "kind int, doc_id long, held_out boolean, level int, ctx long, n_tokens long, n_known long, base double, score double, seen double, lower double, times long"


def _score(c: Chunk, answers: dict[tuple[int, int], bytes], shares: int, m: dict) -> Iterator[pa.RecordBatch]:
    def gather(kind: int) -> tuple[np.ndarray, np.ndarray]:
        got = [_given(answers[kind, s]) for s in dealt_out(c.keys[kind - 1], shares)[0]]
        return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])

    names = [x.split()[0] for x in SCORED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 4, pa.int64()]

    def batch(kind: int, n: int, level: int = 0, **cols) -> pa.RecordBatch:
        fixed = {"kind": kind, "level": level}
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, fixed[x]), k) if x in fixed else pa.array(cols[x], k) if x in cols else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names)

    ids = pa.array(c.docs, pa.int64(), mask=c.null)
    # Ids may repeat: a document is known by its chunk and place, too.
    place = (np.uint64(int(c.name[:16], 16)) + np.arange(len(ids), dtype=np.uint64)).view(np.int64)
    count, _ = gather(1)
    p = np.where(count > 0, _seen_p(count, m["d"][0]) / max(m["N"], 1), m["unknown"])
    base = np.log10((count + 0.5) / (m["N"] + 0.5 * (m["V"] + 1)))[c.at[0]]
    known = np.add.reduceat((count[c.at[0]] > 0).astype(np.int64), c.starts)
    log_p, rows = np.log10(p)[c.at[0]], []
    for level in range(2, len(c.keys) + 1):
        at, lower_at, context = c.at[level - 1], c.at[level - 2], c.context[level - 2]
        times = np.empty(len(at), np.int64)  # of each token's context
        times[1:] = count[lower_at][:-1]
        times[c.starts] = m["documents"]
        lower, (count, own) = p, gather(level)
        _, one = np.unique(at, return_index=True)  # a token that ends each n-gram
        seen = count > 0
        p = np.where(seen, _seen_p(count, m["d"][level - 1]) / np.maximum(times[one], 1), 0.0)
        log_p = np.where(seen[at], np.log10(np.maximum(p, 1e-300))[at], log_p)
        # This chunk's part of each context's sums.
        mine = one[np.flatnonzero(own & seen)]
        k, back = np.unique(context[mine], return_inverse=True)
        rows.append(batch(1, len(k), level, ctx=k.view(np.int64), seen=np.bincount(back, p[at[mine]], len(k)), lower=np.bincount(back, lower[lower_at[mine]], len(k))))
        # Contexts of unseen n-grams, by document; contexts never seen have weight one.
        un = np.flatnonzero(~seen[at] & (times > 0))
        if len(un):
            doc, (k, back) = np.searchsorted(c.ends, un, "right"), np.unique(context[un], return_inverse=True)
            both, n = np.unique(doc * len(k) + back, return_counts=True)
            d, x = both // len(k), both % len(k)
            rows.append(batch(2, len(both), level, doc_id=ids.take(pa.array(d)), ctx=k[x].view(np.int64), n_tokens=place[d], times=n))
    yield batch(0, len(ids), doc_id=ids, held_out=c.held, ctx=place, n_tokens=c.lengths, n_known=known, base=np.add.reduceat(base, c.starts), score=np.add.reduceat(log_p, c.starts))
    yield from rows


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, held_out), learnt from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are words
    (A-Z lower-cased), then an end token, so null and empty texts have one token. Base is the
    add-half unigram score; score the log10 probability of the text in the model of ``order`` words
    (1: no context). Without training rows every word is unknown. Repeated rows count and are scored
    each; null ids are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    table = store(chunks(docs), "chunks")
    size = table.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = max(8, -(-size // (BLOCK_KEYS * 16)))
    # About 8 bytes a token and order travel, and half of that comes back.
    answers = store(_answers(_ask(table, shares, order), width(spark, 8 * order * size)), "answers")
    facts = answers.where("n1 is not null").groupBy("kind").agg(F.sum("total").alias("total"), F.sum("types").alias("types"), *[F.sum(F.col("n1")[r]).alias(f"n{r}") for r in range(GT_MOST + 2)]).collect()
    f = {r["kind"]: r for r in facts}
    n = [[f[k][f"n{r}"] if k in f else 0 for r in range(GT_MOST + 2)] for k in range(1, order + 1)]
    total, types = (f[1]["total"], f[1]["types"]) if 1 in f else (0, 0)
    d = [discounts(x) for x in n]
    # What the discounts leave: exact, from the counts of counts and the total of the larger counts.
    small = sum(r * n[0][r] for r in range(1, GT_MOST + 1))
    kept = sum(d[0][r] * r * n[0][r] for r in range(1, GT_MOST + 1)) + d[0][-1] * (total - small)
    unknown = 1 - kept / total if total else 1.0
    m = {"N": total, "V": types, "d": d, "unknown": unknown, "documents": docs.where("not held_out").count()}
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    left = table.select("chunk", F.lit(-1).alias("kind"), F.lit(-1).alias("share"), F.lit(None).cast("binary").alias("counts"), *names[1:])
    right = answers.select("chunk", "kind", "share", "counts", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in names[1:]])
    both = right.unionByName(left).repartition(width(spark, (4 + 4 * order) * size), "chunk").sortWithinPartitions("chunk", F.desc("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, got = None, {}
        for batch in batches:
            for row in _rows(batch):
                if row["chunk"] != key:
                    key, got = row["chunk"], {}
                if row["kind"] >= 0:
                    got[row["kind"], row["share"]] = row["counts"]
                else:  # the chunk itself comes last
                    yield from _score(Chunk(row, order), got, shares, m)
                    got = {}

    rows = store(both.mapInArrow(run, SCORED), "scored")
    drop_stored(table, answers)
    sums = rows.where("kind = 1").groupBy("level", "ctx").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
    weights = sums.select("level", "ctx", F.log10(F.greatest(1 - F.col("seen"), F.lit(1e-12)) / F.greatest(1 - F.col("lower"), F.lit(1e-12))).alias("w"))
    unseen = rows.where("kind = 2").select("doc_id", F.col("n_tokens").alias("place"), "level", "ctx", "times")
    part = unseen.join(weights, ["level", "ctx"]).groupBy("doc_id", "place").agg(F.sum(F.col("w") * F.col("times")).alias("backoff"))
    out = rows.where("kind = 0").select("doc_id", F.col("ctx").alias("place"), "held_out", "n_tokens", "n_known", "base", "score")
    part = part.toDF("d", "p", "backoff")
    out = out.join(part, out["doc_id"].eqNullSafe(part["d"]) & (out["place"] == part["p"]), "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"))


def score_held_out(docs: DataFrame, mod: int = 5, rest: int = 1, order: int = ORDER) -> DataFrame:
    """``katz_scores`` learnt from the rows whose crc32 of the id leaves another remainder than ``rest``."""
    return katz_scores(docs.select("doc_id", "text", held_out("doc_id", mod, rest).alias("held_out")), order)
