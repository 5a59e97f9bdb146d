"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document is tokenised once, in the task that reads it.  Whole windows are
cut off its front, and the rest is cut into pieces of at most a quarter window.
The pieces of consecutive documents form a group of about ``group_windows``
windows, and largest differencing merges the two partial partitions with the
widest spread, heaviest part against lightest, until one partition into
near-equal windows is left.  The window count starts at the total over the
capacity and rises for as long as a window exceeds the capacity.

Nothing is shuffled: a window never crosses an input partition, so a lost task
is simply run again.  A task holds one group (``group_windows`` windows and the
document that filled it), however large the table is.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, padded_length long"
)


def karmarkar_karp(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """Window of each item in a k-way largest-differencing partition, and the largest load.

    A partial partition is a vector of k loads, heaviest first.  The two with the
    widest spread (first load less last) are merged, one of them reversed, so that
    opposing imbalances cancel.  Ties go to the partial made first, so reruns agree.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64), 0
    loads: list[np.ndarray | None] = []
    made: list[tuple[int, int, np.ndarray] | None] = []
    heap = []
    for i, size in enumerate(sizes):
        first = np.zeros(k, dtype=np.int64)
        first[0] = size
        loads.append(first)
        made.append(None)
        heap.append((-size if k > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        loads[a] = loads[b] = None
        loads.append(both)
        made.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(loads) - 1))
    root = heap[0][1]
    window = np.zeros(n, dtype=np.int64)
    slots: dict[int, np.ndarray] = {root: np.arange(k)}
    for node in range(root, -1, -1):
        labels = slots.pop(node, None)
        if labels is None:
            continue
        if made[node] is None:
            window[node] = labels[0]
            continue
        a, b, order = made[node]
        for child, place in ((a, order), (b, k - 1 - order)):
            below = np.empty(k, dtype=np.int64)
            below[place] = labels
            slots[child] = below
    return window, int(loads[root][0])


def pack_pieces(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity`` for all items; more windows whenever one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, most = karmarkar_karp(sizes, k)
        if most <= capacity:
            return window, k
        k += max(1, k // 256)


def cuts(rest: int, capacity: int, fine: bool) -> list[int]:
    """Piece sizes of a document's rest: at most a quarter window each.

    In a ``fine`` document the last quarter is halved down to single ids; these
    crumbs come last in the differencing and level the windows.
    """
    quarter = max(1, capacity // 4)
    out = [quarter] * (rest // quarter)
    last = rest % quarter
    while fine and last > 1:
        out.append(last - last // 2)
        last //= 2
    if last:
        out.append(last)
    return out


class Encoder:
    """Ids of the byte-level vocabulary; the ranks file is the fast path.

    ``tokenizers`` and ``tiktoken`` give the same ids for this vocabulary (a test
    holds them together); a text that the second cannot take goes to the first.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            added = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), dtype="<u4")
            except BaseException as e:  # the native code panics on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    end_id: int = 0,
    group_windows: int = 256,
    fine_every: int = 4,
) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``.  Cases: null or empty text is the end id
    alone; repeated rows are packed each for itself; a null doc_id stays null; an
    empty table gives no rows; further columns are ignored.  A sequence is padded to
    ``capacity`` unless its length is a power of two (``padded_length``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks, pattern)
        made = TaskContext.get().partitionId() << 36
        seen = 0
        whole: list[tuple] = []
        pieces: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, waiting
            rows = list(whole)
            sizes = [p[2] for p in pieces]
            window, k = pack_pieces(sizes, capacity) if sizes else (np.zeros(0, dtype=np.int64), 0)
            load = np.bincount(window, weights=sizes, minlength=k).astype(np.int64) if sizes else np.zeros(0, dtype=np.int64)
            used = np.flatnonzero(load)
            name = {int(w): made + i for i, w in enumerate(used)}
            made += len(used)
            filled = np.zeros(k, dtype=np.int64)
            for (doc, start, length, crc, total), w in zip(pieces, window.tolist(), strict=True):
                size = int(load[w])
                padded = size if size & (size - 1) == 0 else capacity
                rows.append((doc, start, length, crc, total, name[w], int(filled[w]), size, padded))
                filled[w] += length
            whole.clear()
            pieces.clear()
            waiting = 0
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                total, start = len(ids), 0
                raw = memoryview(ids.tobytes())
                while total - start >= capacity:
                    whole.append((doc, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), total, made, 0, capacity, capacity))
                    made += 1
                    start += capacity
                for size in cuts(total - start, capacity, seen % fine_every == 0):
                    pieces.append((doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), total))
                    waiting += size
                    start += size
                seen += 1
                if waiting >= group_windows * capacity or len(whole) >= 16 * group_windows:
                    yield flush()
        if whole or pieces:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
