"""Best-fit packing of documents into sequences of a fixed length, improved by a swap-based local search.

Documents are tokenised where they are read; only (document, piece, length) moves on. Pieces that fill a sequence
keep one to themselves. The others are dealt by a hash of their identity to shards of about SHARD_PIECES, so no key
of the corpus can crowd a shard, and each shard is packed by itself: best fit in decreasing order first, then
exchanges between underfull bins. A shard wastes at most about one bin in its thousands.

Null text counts as empty (the end id alone); an empty table gives no rows; repeated rows are packed each; texts of
any length are cut into pieces, none is dropped; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, tokens

SEQUENCE, END_ID, SHARD_PIECES = 1024, 2, 8192
#: Givers in turn that the local search tries in vain before it ends: bounds its time, not the pieces.
PATIENCE = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, own_sequence long"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions): largest first, each into the open bin it fills best."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set if a bin has a gap of g
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := gap - n:
            by_gap[left].append(b)
            open_gaps |= 1 << left
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empty underfull bins: move a document, or exchange one or two for one, whenever that raises the sum of squared fills.

    The emptiest bin gives, fuller bins take, always by the exchange that fills one best. Every step raises the sum
    of squared fills, so the search ends; it ends sooner when the bins are as few as the total allows, or when
    patience givers in turn could not be emptied.
    """
    if not bins:
        return bins
    size = np.array(sizes, np.int64)
    at = np.empty(len(sizes), np.int64)
    for b, held in enumerate(bins):
        at[held] = b
    fill = np.bincount(at, weights=size, minlength=len(bins)).astype(np.int64)
    left, least, stuck = len(bins), -(-int(size.sum()) // capacity), 0
    aside = np.zeros(len(bins), bool)
    while left > least and stuck < patience:
        giver = int(np.argmin(np.where((fill == 0) | aside, capacity + 1, fill)))
        if aside[giver] or not 0 < fill[giver] < capacity:
            break
        step = _step(size, at, fill, giver, capacity)
        if step is None:
            aside[giver] = True
            stuck += 1
            continue
        out, back, taker = step
        moved = int(size[out].sum() - size[back].sum())
        at[out], at[back] = taker, giver
        fill[giver] -= moved
        fill[taker] += moved
        if not fill[giver]:
            left, stuck = left - 1, 0
    new: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(at.tolist()):
        new[b].append(i)
    return [b for b in new if b]


def _step(size: np.ndarray, at: np.ndarray, fill: np.ndarray, giver: int, capacity: int) -> tuple[list[int], list[int], int] | None:
    """The best step for the giver: (documents that leave it, documents it gets back, the bin that takes)."""
    mine = np.flatnonzero(at == giver)
    mine = mine[np.argsort(-size[mine], kind="stable")]
    room = capacity - fill
    room[giver] = 0
    room[fill == 0] = 0
    for i in mine:  # a move, into the bin it fills best
        left = np.where(room >= size[i], room - size[i], capacity)
        taker = int(np.argmin(left))
        if left[taker] < capacity:
            return [int(i)], [], taker
    held = np.flatnonzero((room[at] > 0) & (fill[at] >= fill[giver]))
    if not len(held):
        return None
    other, free = size[held], room[at[held]]
    singles = [[int(i)] for i in mine]
    pairs = [[int(mine[x]), int(mine[y])] for x in range(min(len(mine), 24)) for y in range(x)]
    for outs in (singles, pairs):  # one for one, then two for one
        best = (0, None, None)
        for out in outs:
            gain = size[out].sum() - other
            gain[gain > free] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (int(gain[k]), out, int(held[k]))
        if best[1]:
            return best[1], [best[2]], int(at[best[2]])
    return None


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first one may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID, kept: int | None = None) -> DataFrame:
    """One row for each piece with its ids' checksum; a piece that fills a sequence has a number for it, below 0. kept bounds a worker's cache."""
    end = np.array([end_id], "<u4").tobytes()

    @common.task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.PieceEncoder(path, tokens.as_bytes, b"".join, kept=kept)
        own = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    full = None
                    if length == capacity:
                        own += 1
                        full = -own
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), full))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "own_sequence"])

    return common.id_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, kept: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut_up = common.materialize(pieces_of(docs, path, capacity, end_id, kept), "pieces")
    rest = cut_up.where("own_sequence is null").drop("own_sequence")
    shards = max(1, -(-rest.count() // shard_pieces))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sizes = rows["length"].tolist()
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        rows["sequence_id"], rows["offset"] = (int(rows["shard"].iloc[0]) << 32) + sequence, offset
        return rows.drop(columns="shard")

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(lambda r: shard(r[["doc_id", "piece", "start", "length", "ids_crc32", "shard"]]), out)
    full = cut_up.where("own_sequence is not null").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("own_sequence").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
