"""Chat formatting with offset-aligned loss masks.

Turns are rendered between control strings; control strings inside texts are escaped by a reversible
rule. A conversation is rendered whole and encoded once, with the offsets of its tokens; the sorted
spans of the assistant texts are intersected with the sorted token spans by binary search.

A conversation is cut between turns only where it crosses a partition or a segment's size, so a
conversation of any length, or one that holds a third of all rows, is spread over tasks and needs a
bounded memory. A control string is a token of its own, so tokens never cross turns and the segments'
tokens are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, store, width

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
#: A segment ends after the turn that brings it to so many characters.
SEGMENT_CHARS = 1 << 20
SEGMENTS = "conv_id long, part int, segment int, n_turns long, text string, ids binary, token_starts binary, token_ends binary, loss binary"


def escape(text: str) -> str:
    """One backslash more between ``<`` and ``|``: no control string is left."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray]:
    """The text of a conversation and the spans of the loss role's texts, as an array of (start, end)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), np.asarray(spans, np.int64).reshape(-1, 2)


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: for each token the last span that starts at or before it is looked up."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(spans[:, 0], starts, "right") - 1
    return (k >= 0) & (ends <= spans[np.maximum(k, 0), 1]) & (ends > starts)


class Encoder:
    """The tokenizer with the control strings as tokens, and offsets that cover every character."""

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            at = np.asarray(e.offsets, np.int64).reshape(-1, 2)
            out.append((np.asarray(e.ids, np.uint32), at[:, 0], at[:, 1]))
        return out


def format_conversations(rows: DataFrame, tokenizer: str, loss_role: str = "assistant", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of formatted conversations, of ``rows`` with conv_id, turn, role, text.

    Rows go by turn (null first), then role and text, so ties and repeated rows have a defined order
    and all count. Null roles and texts are empty; a null conv_id is a conversation of its own.
    Other columns are ignored; an empty table gives no segments. Columns: conv_id, part and segment
    (order within the conversation), n_turns, text, ids (little-endian 32-bit), token_starts and
    token_ends (32-bit character offsets in the segment's text), loss (a byte for each token).
    """
    spark = rows.sparkSession
    bound_batches(spark)
    key = ["conv_id", "turn", "role", "text"]
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartitionByRange(width(spark), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, out = Encoder(tokenizer), TaskContext.get().partitionId(), []
        conv, held, chars, segment, size = None, [], 0, 0, 0
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 4]

        def end() -> None:
            nonlocal held, chars, segment
            out.append((conv, part, segment, len(held), *render(held, loss_role)))
            held, chars, segment = [], 0, segment + 1

        def give() -> pa.RecordBatch:
            rows = []
            for row, (ids, a, b) in zip(out, encoder.batch([r[4] for r in out]), strict=True):
                mask = loss_mask(row[5], a, b)
                rows.append((*row[:5], ids.tobytes(), a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), mask.astype(np.uint8).tobytes()))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for c, _, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and c != conv:
                    size += chars
                    end()
                    segment = 0
                elif not held and c != conv:
                    segment = 0
                conv = c
                held.append((role, text))
                chars += len(text)
                if chars >= segment_chars:
                    size += chars
                    end()
                if size >= 1 << 20:
                    size = 0
                    if out:
                        yield give()
        if held:
            end()
        if out:
            yield give()

    return turns.mapInArrow(run, SEGMENTS)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped, each character once even where several tokens share it."""
    parts, done = [], -1
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        a = max(a, done)
        if b > a:
            parts.append((a, b))
            done = b
    runs: list[list[int]] = []
    for a, b in parts:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return "".join(unescape(text[a:b]) for a, b in runs)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its segments.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.
    The segments of a conversation are streamed in order through running digests; a digest is
    sequential, so this last step alone needs a conversation's segments in one task.
    """
    spark = segments.sparkSession
    s = store(segments, "segments").repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", "part", "segment")
    out_schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in out_schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        started, conv, out = False, None, []
        turns_hash = loss_hash = None
        counts = [0] * 5

        def end() -> None:
            if started:
                out.append((conv, counts[0], turns_hash.hexdigest(), counts[1], loss_hash.hexdigest(), counts[2], counts[3], counts[4]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "text", "token_starts", "token_ends", "loss")]
            for conv_id, text, *spans, loss_bytes in zip(*columns, strict=True):
                if not started or conv_id != conv:
                    end()
                    started, conv, counts = True, conv_id, [0] * 5
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                turns = parse(text)
                for role, said in turns:
                    turns_hash.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in spans)
                mask = np.frombuffer(loss_bytes, np.uint8).astype(bool)
                loss = masked_text(text, a, b, mask)
                loss_hash.update(loss.encode("utf-8", "surrogatepass"))
                for k, v in enumerate((len(turns), len(loss), len(text), len(mask), int(mask.sum()))):
                    counts[k] += v
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return s.mapInArrow(run, out_schema)
