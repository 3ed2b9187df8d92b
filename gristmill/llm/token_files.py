"""Token ids of a corpus in Simple-8b files, in ascending order of document id.

Documents are range-partitioned by id and sorted, so partition k holds smaller ids than partition
k + 1. Each task encodes its documents, packs their ids in chunks and hands the chunks to Spark's
Parquet writer, which commits whole tasks only: a lost executor leaves no half-written file.

A chunk is a row: ``part`` and ``chunk`` (its place in the order), ``before`` (ids of the part before
it), ``doc_ids``, ``lengths`` (ids of each document), ``n`` (ids in all), ``words`` (64-bit
little-endian Simple-8b words) and ``blocks`` (32-bit little-endian offsets: the word at which each
block of 4096 ids begins).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import bound_batches, new_path, width
from .kernels import cut_long, hash_piece, pieces

CHUNK_IDS = 1 << 20
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
_MARKS = frozenset(".,;:!?")
FILE_SCHEMA = "part int, chunk int, before long, doc_ids array<long>, lengths array<long>, n long, words binary, blocks binary"


def _word_pieces(w: str) -> int:
    """How many word ends the ids of ``w`` have for sure: 1 for Latin letters, 2 with one mark after them, else 0 (unknown)."""
    if w.isalpha():
        n = 1
    elif w[-1:] in _MARKS and w[:-1].isalpha():
        n = 2
    else:
        return 0
    return n if w.isascii() or max(w) < "\u0250" and "\u0130" not in w else 0


def _byte_letters() -> dict[int, str]:
    """How byte-level models spell the letters from U+0080 to U+024F: a printable byte is itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(chr(b if b in own else other[b]) for b in chr(c).encode()) for c in range(0x80, 0x250)}


_BYTE_LETTERS = _byte_letters()


def _bare(tokenizer):
    """The tokenizer's model behind a plain split at spaces, if its own normaliser and pre-tokeniser are the known ones."""
    from tokenizers import Tokenizer, pre_tokenizers

    spec = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]:
        return None
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return bare


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once, known by its 64-bit hash.

    Only for tokenizers that never join characters across a space or line feed (their pre-tokeniser
    drops white space), where the ids of a text are the ids of its pieces one after another. Words
    of Latin letters are encoded many at a time, and told apart by the tokens that end a word in the
    vocabulary; all others one by one.
    """

    def __init__(self, file: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.bare = _bare(self.tokenizer) if self.suffix else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if self.suffix:
            for token, k in self.tokenizer.get_vocab().items():
                self.ends[k] = token.endswith(self.suffix)
        self.end_id = end_id
        self.fold = self.bare is not None  # its normaliser makes lower case
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)  # hashes of words, sorted, and their numbers
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 18, np.uint32), 0, 0
        self.new: list[int] = []

    def _learn(self, keys: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = self.words
        self.words += len(keys)
        while len(self.start) < self.words:
            self.start, self.size = np.concatenate((self.start, self.start)), np.concatenate((self.size, self.size))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.size[first : self.words] = sizes
        self.start[first : self.words] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.new += keys

    def _encode_bare(self, words: list[tuple[str, int, int]], spell: bool) -> None:
        """Latin letters, and a mark after them, by the library's model alone: to these the normaliser
        only does lower case, and the pre-tokeniser only cuts off the mark and spells bytes as letters."""
        for k in range(0, len(words), 1024):
            part = words[k : k + 1024]
            text = " ".join([w if n == 1 else f"{w[:-1]} {w[-1]}" for w, n, _ in part]).lower()
            ids = np.asarray(self.bare.encode_batch_fast([text.translate(_BYTE_LETTERS) if spell else text], add_special_tokens=False)[0].ids, np.uint32)
            last, nth = np.flatnonzero(self.ends[ids]), np.cumsum([n for _, n, _ in part])
            if len(last) == nth[-1]:
                self._learn([h for _, _, h in part], np.diff(last[nth - 1], prepend=-1), ids)
            else:
                self._encode_each([(w, h) for w, _, h in part])

    def _encode_each(self, words: list[tuple[str, int]]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, _ in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._learn([h for _, h in part], sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _encode(self, words: list[tuple[str, int]]) -> None:
        plain: dict[bool, list[tuple[str, int, int]]] = {True: [], False: []}
        other = []
        for w, h in words:
            n = _word_pieces(w) if self.bare else 0
            if n:
                plain[w.isascii()].append((w, n, h))
            else:
                other.append((w, h))
        self._encode_bare(plain[True], False)
        self._encode_bare(plain[False], True)
        self._encode_each(other)

    def _look_up(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes stand among the known ones, and which are known."""
        at = np.searchsorted(self.keys, distinct)
        there = np.minimum(at, max(len(self.keys) - 1, 0))
        return at, self.keys[there] == distinct if len(self.keys) else np.zeros(len(distinct), bool)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        blob = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        bounds = np.cumsum([0] + [len(x) + 1 for x in blob])
        data, found, at = b"\n".join(blob), [], 0
        for part in cut_long(data):
            h, start, end = hash_piece(part, self.fold)
            found.append((h, start + at, end + at))
            at += len(part)
        h, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._look_up(distinct)
        if not known.all():
            if len(self.keys) and len(self.keys) + np.count_nonzero(~known) > REMEMBERED:
                self.forget()
                known[:] = False
            i = np.flatnonzero(~known)
            begin = self.words
            self._encode([(data[a:b].decode("utf-8", "surrogatepass"), k) for a, b, k in zip(start[first[i]].tolist(), end[first[i]].tolist(), distinct[i].tolist(), strict=True)])
            fresh = np.asarray(self.new, np.uint64)
            self.new = []
            order = np.argsort(fresh)
            place = np.searchsorted(self.keys, fresh[order])
            self.keys, self.number = np.insert(self.keys, place, fresh[order]), np.insert(self.number, place, begin + order)
            at, known = self._look_up(distinct)
        n = self.number[at][back]
        size = self.size[n].astype(np.int64)
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[n] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        cut = np.concatenate(([0], total))[np.searchsorted(start, bounds[1:])]  # ids before the end of each text
        return np.insert(ids, cut, np.uint32(self.end_id)), np.diff(cut, prepend=0) + 1


#: A worker process keeps its encoder, and the words it has learnt, from task to task.
_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(file: str, end_id: int) -> WordEncoder:
    if (file, end_id) not in _encoders:
        _encoders.clear()
        _encoders[file, end_id] = WordEncoder(file, end_id)
    return _encoders[file, end_id]


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[list, list]]:
    """Ids and texts of about ``most`` bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for piece in pieces(batch):
            ids += piece.column(0).to_pylist()
            texts += piece.column(1).to_pylist()
            size += piece.nbytes
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _chunk(part: int, k: int, before: int, docs: list, lengths: list[int], ids: list[np.ndarray]) -> dict:
    values = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    words, starts = simple8b.encode(values)
    return {"part": part, "chunk": k, "before": before, "doc_ids": docs, "lengths": lengths, "n": len(values), "words": words.astype("<u8").tobytes(), "blocks": starts.astype("<u4").tobytes()}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the files.

    Null texts are empty; each document ends with ``end_id``. Rows with equal ids follow each other,
    by text; a null id comes first. Whole texts are encoded, whatever their length. An empty table
    writes an empty folder of files.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = width(spark)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, k = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        held, lengths, ids, size, before = [], [], [], 0, 0
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()), ("words", pa.binary()), ("blocks", pa.binary())])
        for docs_now, texts in _gathered(batches):
            x, n = encoder(texts)
            held += docs_now
            lengths += n.tolist()
            ids.append(x)
            size += len(x)
            if size >= chunk_ids:
                yield pa.RecordBatch.from_pylist([_chunk(part, k, before, held, lengths, ids)], schema)
                before += size
                k += 1
                held, lengths, ids, size = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_chunk(part, k, before, held, lengths, ids)], schema)

    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files with their ids: ``doc_id, start, n_tokens, ids``."""
    return _per_document(spark, path, "ids array<long>", lambda x: x.astype(np.int64).tolist(), pa.list_(pa.int64()))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: unsigned crc32 of the ids as little-endian 32-bit."""
    return _per_document(spark, path, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _per_document(spark: SparkSession, path: str, column: str, make, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One number for each partition: the ids before it.
    first, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        first[r["part"]] = total
        total += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = column.split()[0]
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                values = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["blocks"], "<u4"), row["n"])
                lengths = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                at = first[row["part"]] + row["before"]
                for k in range(0, len(lengths), 1000):
                    cut = [(int(e - m), int(m)) for e, m in zip(ends[k : k + 1000], lengths[k : k + 1000], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["doc_ids"][k : k + 1000], pa.int64()), pa.array([at + a for a, _ in cut], pa.int64()),
                        pa.array([m for _, m in cut], pa.int64()), pa.array([make(values[a : a + m]) for a, m in cut], kind),
                    ], schema=schema)

    return files.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")


def tokenizer_file(name: str) -> str:
    """Where the file of a public tokenizer is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def write_and_digest(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and return the digests read back from them."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer or tokenizer_file("word_bpe_49k.json"))
    return token_digests(spark, path)
