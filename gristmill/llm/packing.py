"""Variable-capacity best-fit packing.

Documents are cut into pieces of at most the longest permitted length, pieces are dealt into shards
of a bounded number by a hash, and each shard is packed on its own, largest piece first:

* a piece goes to the open bin that it fills best (least room left, then the oldest);
* if none has room, the bin size is opened whose cost per token it can expect to hold is least,
  counting the smaller pieces that are still to come as possible filling;
* at the end every bin is cut down to the shortest permitted length that holds its contents.

Shards differ in nothing but their pieces, so the loss over packing all at once is under one partly
filled bin a shard and length.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, store, width, word_count

LENGTHS = (1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
OUT = "doc_id long, piece long, start long, length long, bin_id long, capacity long, offset long"


def bin_cost(capacity: int) -> float:
    """Cost of training on one sequence: its tokens, attention that grows with their square, a fixed part."""
    return 32 + capacity + capacity * capacity / 65536


def pack(lengths: np.ndarray, sizes: Sequence[int], cost: Callable[[int], float] = bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, given in falling order, and the final capacity of each bin."""
    sizes = sorted(sizes)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    cap: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    after = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0]))
    falling = -lengths
    for i in range(n):
        x = int(lengths[i])
        k = bisect.bisect_left(room, (x, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            best = None
            for c in sizes:
                if c >= x:
                    rest = c - x
                    j = max(i + 1, int(np.searchsorted(falling, -rest, "left")))
                    got = x + min(rest, int(after[j]) if j < n else 0)
                    price = cost(c) / max(got, 1)
                    if best is None or price < best[0]:
                        best = (price, c)
            b, left = len(cap), best[1]
            cap.append(left)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += x
        left -= x
        if left > 0:
            bisect.insort(room, (left, b))
    final = np.asarray([next(c for c in sizes if c >= f) for f in fill], np.int64)
    return bins, offsets, final


def pack_documents(docs: DataFrame, sizes: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES, size=None) -> DataFrame:
    """Packed pieces of all ``docs`` (doc_id, text), which may have further columns.

    A document's size is ``size`` (a column; its words by default) plus one for its end, so null and
    empty texts have size 1 and are packed too. Returns doc_id, piece (from 0), start (in the
    document), length, bin_id, capacity (final length of the bin), offset (in the bin). Every token of
    every row is in one place; repeated rows are packed each; a null id is kept. The result depends on
    the rows alone, not on their order or files. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    longest = max(sizes)
    sized = docs.select("doc_id", ((word_count() if size is None else size) + 1).alias("size"))
    # Rows alike in id and size are counted, then numbered: their shards differ, whatever files they were in.
    sized = store(sized.groupBy("doc_id", "size").agg(F.count("*").alias("rows")), "sizes")
    total = sized.agg(F.sum(F.col("rows") * F.ceil(F.col("size") / longest))).first()[0] or 0
    pieces = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("twin"))
    pieces = pieces.select("doc_id", "size", "twin", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(longest).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "twin", F.col("piece").cast("long").alias("piece"), "start", F.least(F.lit(longest), F.col("size") - F.col("start")).cast("long").alias("length"))
    shards = max(1, -(-int(total) // shard_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "twin"), F.lit(shards)).cast("long")
    dealt = pieces.withColumn("shard", deal)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(g["length"].to_numpy(), sizes)
        out = g[["doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = bins + (int(key[0]) << 32)
        out["capacity"] = final[bins]
        out["offset"] = offsets
        return out.convert_dtypes()

    return dealt.repartition(max(width(docs.sparkSession), 1), "shard").groupBy("shard").applyInPandas(run, OUT)


def bins_of(packed: DataFrame) -> DataFrame:
    """``bin_id, capacity, used, pieces`` of each bin."""
    return packed.groupBy("bin_id").agg(F.max("capacity").alias("capacity"), F.sum("length").alias("used"), F.count("*").alias("pieces"))
