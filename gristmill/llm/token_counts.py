"""How many tokens a byte-pair tokenizer makes of each text, without making them.

A text is cut at the tokenizer's added tokens (one token each) and then into pre-tokens. A pre-token
begins as one symbol a byte. All adjacent pairs with a rank wait in a heap; the pair with the lowest
rank, the leftmost of equals, is joined, and its neighbours in a linked list give up to two new
pairs. Every merge takes one symbol away, so the count is the bytes less the merges. A worker
remembers the counts of short pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import bound_batches
from .kernels import PIECE, pieces

# Fixed value: how byte-level tokenizers of this family cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class is the same in every Unicode version of the last ten years: Latin to Cyrillic,
#: Thai, punctuation, kana, the first Han block, Hangul. Other texts are cut by the library itself.
_SETTLED = regex.compile(r"[\x00-՗ก-ฺ‐-⁯ぁ-ゖァ-ヺ一-龥가-힣]*+")
#: A place between two pre-tokens for sure: after the first of these letters.
_APART = regex.compile(r"[A-Za-z] [A-Za-z]")
#: Pre-tokens that a worker remembers before it starts anew, and their length at most.
REMEMBERED, SHORT = 1_000_000, 64


def byte_letters() -> list[str]:
    """How byte-level models spell each byte: a printable one is itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many of ``symbols`` are left when no adjacent pair has a rank any more."""
    n = len(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    symbols = list(symbols)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been joined otherwise
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heappush(heap, (r, i, a + b, symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heappush(heap, (r, h, symbols[h], a + b))
    return left


class TokenCounter(dict):
    """Counts tokens of texts; as a dictionary, the counts of short pre-tokens."""

    def __init__(self, file: str) -> None:
        from tokenizers import pre_tokenizers

        super().__init__()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        known = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        known &= cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        if not known or any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{file} is no plain byte-level byte-pair tokenizer")
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.cut = regex.compile(PATTERN).findall
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        names = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None

    def __missing__(self, word: str) -> int:
        letters = self.letters
        n = count_symbols([letters[b] for b in word.encode("utf-8", "surrogatepass")], self.ranks)
        if len(word) <= SHORT:
            self[word] = n
        return n

    def _segment(self, text: str) -> int:
        total, at = 0, 0
        while at < len(text):
            m = _APART.search(text, at + PIECE) if len(text) - at > 2 * PIECE else None
            end = m.start() + 1 if m else len(text)
            part = text if end - at == len(text) else text[at:end]
            if _SETTLED.fullmatch(part):
                words = self.cut(part)
            else:
                words = [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            total += sum(map(self.__getitem__, words))
            at = end
        return total

    def count(self, text: str) -> int:
        """Tokens of ``text``, with no tokens added around it."""
        if len(self) > REMEMBERED:
            self.clear()
        if self.added is None:
            return self._segment(text)
        segments = self.added.split(text)
        return len(segments) - 1 + sum(map(self._segment, segments))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``tokenizer`` is the file of a byte-level byte-pair tokenizer, on every machine. Null texts are empty and
    have no token; equal rows give equal rows; a null doc_id is kept; an empty table gives an empty
    result. Whole texts count, cut into parts of about 1M characters where a boundary is certain;
    ``over_limit`` says whether there are more than ``limit`` tokens. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    doc_id = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text")
                n = np.asarray([counter.count(t) if t else 0 for t in texts.to_pylist()], np.int64)
                size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
