"""Exact n-gram Jaccard join in the metric space of shingle sets.

1. Equal sets are one class; the join works on classes, so copies are never paired.
2. First regions: two sets of similarity t or more share a shingle of their prefixes
   (the first ``n - ceil(t*n) + 1`` shingles in one order for all; here rare ones first)
   and their sizes differ by no more than 1/t.  The classes of close size that share a
   prefix shingle are a region, named after the least of them, so every linked pair
   meets in some region.  (Of pivots drawn from all sets nearly every set has distance 1,
   where the triangle inequality says nothing.)
3. Every set has a parity sketch, one bit for each of about n cells of the hash range.
   The bits in which two sketches differ are at most the symmetric difference, so a
   set leaves a region where each other one is farther than a link allows; shingles
   are fetched for what stays.  Rows of large regions meet by size for that, in tasks
   of few rows: chance brings many together that share one shingle and nothing else.
4. A region of more than ``FEW`` sets is divided by pivots.  With e the join's distance,
   a set within e of a pivot links to it and goes to the cell of its nearest pivot; by
   the triangle inequality a partner of it is within 2e of that pivot, so a set from e
   to 2e away visits the cell, and one farther away does not.  Sets beyond e of all
   pivots are the rest, a region of its own.  What a cell's pivot links is one component
   and is not paired again: left to try are visitors against insiders, and of these only
   distances that differ by e at most.  Cells and the rest are divided again in the same
   way, until they hold few sets, which are compared directly.
5. This runs within one task for a region that fits in it, and level by level over all
   tasks for a larger one.  What pivots do not divide is dealt into pairs of blocks.
6. Links are written as stars and their components found by ``connected_components``.

Shingles are 64-bit hashes; everything else is exact for every size and skew.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop, materialize, small_batches, with_least

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: kinds of a region's rows: linked to its pivot; to be paired; from another cell
INSIDER, HOME, VISITOR = 0, 1, 2
REST = -1  #: the part of a region that no pivot reaches
FEW = 16  #: sets that are compared directly
PIVOTS = 8  #: pivots that divide a region
BLOCKS = 32  #: a part of a region in more blocks is not pruned by sketches


class _Words(dict):
    """64-bit hashes of words; emptied when 131,072 are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_words = _Words()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text, A-Z lower-cased.

    Fewer than ``k`` words are one shingle; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(k, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ ids[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(shared, a, b, percent: int):
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` in common link."""
    return 100 * shared >= percent * (a + b - shared)


def frequent_shingles(docs: DataFrame, k: int, rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in two or more of about ``rows`` sampled documents, sorted, and their counts.

    At most ``most`` of them, the most frequent.  They only order prefixes: any order
    gives the same links, so the sample bounds work, not results.
    """
    n = docs.count()
    share = min(1.0, rows / n) if n else 1.0
    sample = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id", "key", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), k) for x in batch.column(0)]
            if sets:
                found, n_docs = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n_docs.astype(np.int64))], names=["shingle", "n"])

    counted = sample.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.col("n").desc(), "shingle").limit(most).toArrow()
    shingles, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def prefix(shingles: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(t*n) + 1`` shingles by sampled frequency, then hash."""
    n = len(shingles)
    p = n + (-percent * n) // 100 + 1
    if not len(frequent):
        return shingles[:p]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, often))[:p]]


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of the least power of two >= n cells (64 at least): whether it holds an odd number."""
    bits = max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Packed parity sketches (a row each) with ``width`` bytes: the parities of neighbouring cells add up."""
    while bits.shape[1] > width:
        cells = np.unpackbits(bits, axis=1)
        bits = np.packbits(cells[:, 0::2] ^ cells[:, 1::2], axis=1)
    return bits


def within_reach(sizes: np.ndarray, parities: list[bytes], percent: int) -> np.ndarray:
    """Whether each set of a region has another one of a size to link with that its parity sketch does not rule out.

    Sets meet those of at least their size only, at the width of the smaller one's
    sketch: larger sets keep what their longer sketches tell of each other.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order].astype(np.int64)
    widths = np.array([len(parities[i]) for i in order])
    ends = np.searchsorted(percent * ordered, 100 * ordered, side="right")
    near = np.zeros(len(sizes), dtype=bool)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        start, end = int(own[0]), int(ends[own[-1]])
        if end - start < 2:
            continue
        met = [np.flatnonzero(widths[start:end] == w) + start for w in np.unique(widths[start:end]).tolist()]
        table = np.concatenate([folded(np.frombuffer(b"".join(parities[order[j]] for j in at), dtype=np.uint8).reshape(len(at), -1), width) for at in met])
        table = np.ascontiguousarray(table).view(np.uint64)
        for i in own.tolist():
            to = int(ends[i])
            apart = np.bitwise_count(table[i + 1 - start : to - start] ^ table[i - start]).sum(axis=1, dtype=np.int64)
            hit = apart * (100 + percent) <= (ordered[i + 1 : to] + ordered[i]) * (100 - percent)
            if hit.any():
                near[i] = True
                near[i + 1 : to] |= hit
    out = np.zeros(len(sizes), dtype=bool)
    out[order] = near
    return out


def by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, the first column off, region by region."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for region, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if region != now and held:
                yield held
                held = []
            now = region
            held.append(tuple(row))
    if held:
        yield held


def deal_sizes(members: DataFrame, percent: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of crowded regions (pivot, cid, n), dealt so that all whose sizes may link meet; and rows not dealt.

    The first has ``part`` and ``pair``: a row is in the part of its size and in those up
    to the largest size that it may link with, and a part of more than ``most_rows`` is
    dealt into pairs of blocks.  Parts of more than ``BLOCKS`` blocks are not dealt: there
    the sketches would be as many bytes as the shingles.
    """
    step = math.log(100 / percent) if percent < 100 else 1.0
    low, high = (F.floor(F.log(n) / step) for n in (F.col("n").cast("double"), F.lit(100.0) * F.col("n") / percent))
    parts = members.withColumn("part", F.explode(F.sequence(low, high)))
    count = F.count("*")
    sizes = parts.groupBy("pivot", "part").agg(F.when(count > most_rows, F.ceil(2 * count / most_rows)).otherwise(1).alias("blocks"))
    met = parts.join(sizes, ["pivot", "part"])
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = met.where(F.col("blocks") <= BLOCKS).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.where("blocks = 1 or own <> other")  # a block meets itself in each of its pairs
    pair = F.least("own", "other") * BLOCKS + F.greatest("own", "other")
    return dealt.select("pivot", "cid", "n", "part", pair.alias("pair")), met.where(F.col("blocks") > BLOCKS).select("pivot", "cid", "n")


def prune_regions(rows: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, n) of those ``rows`` (pivot, cid, n, part, pair, parity) that may link in their region.

    A region's rows of one part and pair are held at once.  (Those whose hashes agree are
    held together, which leaves in more.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "cid", "n"]
        out: list[tuple] = []
        for group in by_region(batches):
            near = within_reach(np.array([g[2] for g in group]), [g[3] for g in group], percent)
            out += [g[:3] for g, stays in zip(group, near.tolist(), strict=True) if stays]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    held = F.xxhash64("pivot", "part", "pair").alias("held")
    return rows.select(held, "pivot", "cid", "n", "parity").repartition("held").sortWithinPartitions("held").mapInArrow(run, "pivot long, cid long, n long")


def pairs_of(kinds: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all linked pairs of a region but those of two insiders or two visitors."""
    sizes = np.array([len(s) for s in sets])
    m = len(sets)
    if m == 2:
        if kinds[0] == kinds[1] != HOME or 100 * sizes.min() < percent * sizes.max():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = linked(shared, sizes[0], sizes[1], percent)
        return np.arange(1 if hit else 0), np.arange(1, 2 if hit else 1)
    tokens, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    used = often[column] > 1
    row, column = row[used], column[used]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    dense = np.unique(column, return_inverse=True)[1] if len(column) else column
    shared = np.zeros((m, m), dtype=np.float32)
    width = max(256, min(8192, (1 << 23) // m))
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        a, b = np.searchsorted(dense, [at, at + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[row[a:b], dense[a:b] - at] = 1
        shared += part @ part.T
    hit = np.triu(linked(shared.astype(np.int64), sizes[:, None], sizes[None, :], percent), 1)
    same = (kinds[:, None] == kinds[None, :]) & (kinds[:, None] != HOME)
    return np.nonzero(hit & ~same)


def distances(sets: list[np.ndarray], pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric difference and union of a pivot with each set: their quotient is the distance."""
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, tokens), len(pivot) - 1)
    shared = np.add.reduceat((pivot[at] == tokens).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    union = sizes + len(pivot) - shared
    return union - shared, union


def reach(apart: np.ndarray, union: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether distances are within the join's, and within twice that."""
    return 100 * apart <= (100 - percent) * union, 100 * apart <= 2 * (100 - percent) * union


def places(kind: int, linked: list[bool], near: list[bool], apart: list[float], one: bool) -> list[tuple[int, int, float]]:
    """(cell, kind, distance to its pivot) of a set, from its distances to the pivots of its region.

    ``one``: the region's sets but for its visitors are one component already, so a
    visitor that links with a pivot is done.
    """
    if one and kind == VISITOR and any(linked):
        return []
    if one and kind == INSIDER:
        visits = []
    else:
        visits = [(c, VISITOR, apart[c]) for c in range(len(near)) if near[c] and not linked[c]]
    if kind == VISITOR:
        return [*visits, (REST, VISITOR, -1.0)]
    if not any(linked):
        return [*visits, (REST, kind, -1.0)]
    home = min((c for c in range(len(linked)) if linked[c]), key=lambda c: (apart[c], c))
    # of two sets with unlike homes the one of the lower cell visits
    return [(home, INSIDER, apart[home]), *[v for v in visits if v[0] > home]]


def worth_it(kinds: np.ndarray) -> bool:
    """Whether a region has a pair left to try."""
    homes, insiders = (kinds == HOME).sum(), (kinds == INSIDER).sum()
    return len(kinds) > 1 and bool(homes or (insiders and insiders < len(kinds)))


def in_window(kinds: np.ndarray, far: np.ndarray, percent: int) -> np.ndarray:
    """Rows of a cell whose distance to the pivot differs from that of some possible partner by the join's at most."""
    step = (100 - percent) / 100 + 1e-9
    insider = kinds == INSIDER
    if (far < 0).any() or insider.all() or not insider.any():
        return np.ones(len(kinds), dtype=bool)
    return np.where(insider, far >= far[~insider].min() - step, far <= far[insider].max() + step)


def region_links(kinds: np.ndarray, sets: list[np.ndarray], percent: int, far: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges (as indices) that connect all linked sets of a region which one task holds.

    Pairs of two insiders, who are connected already, and of two visitors, who meet
    elsewhere, are left out.
    """
    a: list[int] = []
    b: list[int] = []
    far = np.full(len(sets), -1.0) if far is None else far
    todo = [(np.arange(len(sets)), kinds, far)]
    while todo:
        at, kind, far = todo.pop()
        stays = in_window(kind, far, percent)
        at, kind = at[stays], kind[stays]
        if not worth_it(kind):
            continue
        if len(at) <= FEW:
            x, y = pairs_of(kind, [sets[i] for i in at], percent)
            a += at[x].tolist()
            b += at[y].tolist()
            continue
        one = not (kind == HOME).any()
        can = np.flatnonzero(kind == (INSIDER if one else HOME))
        own = [sets[i] for i in at]
        # far pivots divide best: each next one is the farthest from those before
        least, next_ = np.full(len(at), np.inf), int(can[0])
        pivots, linked, near, apart = [], [], [], []
        while len(pivots) < PIVOTS and len(pivots) < len(can):
            pivots.append(next_)
            difference, union = distances(own, own[next_])
            within, twice = reach(difference, union, percent)
            linked.append(within.tolist())
            near.append(twice.tolist())
            apart.append((difference / union).tolist())
            least = np.minimum(least, difference / union)
            next_ = int(can[np.argmax(least[can])])
            if least[next_] == 0:
                break
        cells: dict[int, list[tuple[int, int, float]]] = {}
        for i, (kind_i, *by) in enumerate(zip(kind.tolist(), zip(*linked, strict=True), zip(*near, strict=True), zip(*apart, strict=True), strict=True)):
            for c, hit in enumerate(by[0]):
                if hit and pivots[c] != i:
                    a.append(int(at[i]))
                    b.append(int(at[pivots[c]]))
            for c, what, d in places(kind_i, *by, one):
                cells.setdefault(c, []).append((i, what, d))
        parts = [tuple(np.array(x) for x in zip(*rows, strict=True)) for rows in cells.values()]
        if 2 * sum(len(index) ** 2 for index, _, _ in parts) <= len(at) ** 2:
            todo += [(at[index], what, d) for index, what, d in parts]
        else:  # pivots do not divide it: compared directly
            x, y = pairs_of(kind, own, percent)
            a += at[x].tolist()
            b += at[y].tolist()
    return a, b


def stars(a: list[int], b: list[int], ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each linked member to the least id of its part of the region."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(int(ids[i]), int(ids[find(i)])) for i in {*a, *b} if find(i) != i]


def join_regions(rows: DataFrame, percent: int) -> DataFrame:
    """Star edges (a, b) of the regions in ``rows`` (region, cid, kind, far, shingles), each of which fits in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]
        edges: list[tuple[int, int]] = []
        for held in by_region(batches):
            one = {x[0]: x for x in held}  # repeated rows of one class
            group = [one[c] for c in sorted(one)]
            kinds = np.array([x[1] for x in group])
            if worth_it(kinds):
                sets = [np.frombuffer(x[3], dtype=np.uint64) for x in group]
                edges += stars(*region_links(kinds, sets, percent, np.array([x[2] for x in group])), np.array([x[0] for x in group]))
            if len(edges) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=names)
                edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=names)

    return rows.select("region", "cid", "kind", "far", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")


def divide_regions(rows: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Regions too large for a task, divided by pivots over all tasks; written.

    Rows (region, cid, kind, far, shingles, pivots): a row for each cell that the set is
    in; ``pivots`` are the classes that the set links with, given once.  Pivots are the
    first of shares of each region by hash, so a region's rows meet them wherever they are.
    """
    one = F.max((F.col("kind") == HOME).cast("int")) == 0
    kinds = rows.groupBy("region").agg(one.alias("one"))
    can = rows.select("region", "cid", "kind").join(kinds, "region").where(F.col("kind") == F.when(F.col("one"), INSIDER).otherwise(HOME))
    # the first by hash of each of PIVOTS shares: minima are combined before they are shuffled
    first = F.min(F.struct(F.xxhash64("cid").alias("hash"), "cid")).alias("first")
    chosen = can.groupBy("region", "one", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS)).alias("share")).agg(first).select("region", "one", F.col("first.cid").alias("cid"))
    pivots = rows.where(F.col("kind") != VISITOR).join(chosen, ["region", "cid"]).groupBy("region").agg(F.first("one").alias("one"), F.array_sort(F.collect_set(F.struct("cid", "shingles"))).alias("centres"))
    pivots, pivots_path = materialize(pivots, "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "cid", "kind", "far", "shingles", "pivots"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            out: list[tuple] = []
            for region, cid, kind, raw, one, centres in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                difference, union = distances([np.frombuffer(c["shingles"], dtype=np.uint64) for c in centres], own)
                linked, near = reach(difference, union, percent)
                links = [c["cid"] for c, hit in zip(centres, linked, strict=True) if hit and c["cid"] != cid]
                cells = places(kind, linked.tolist(), near.tolist(), (difference / union).tolist(), one)
                for i, (c, what, d) in enumerate(cells or [(REST, VISITOR, -2.0)]):
                    name = f"{region}/{'rest' if c == REST else centres[c]['cid']}"
                    out.append((name, cid, what, d, raw, [] if i else links) if cells else (f"{region}/done", cid, what, d, b"", links))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    met = rows.join(pivots, "region").select("region", "cid", "kind", "shingles", "one", "centres")
    cells = materialize(met.mapInArrow(run, "region string, cid long, kind int, far double, shingles binary, pivots array<long>"), "cells")
    drop(rows.sparkSession, pivots_path)
    return cells


def in_windows(cells: DataFrame, percent: int) -> DataFrame:
    """``in_window`` for regions over all tasks, without those that have no pair left to try."""
    insider, step = F.col("kind") == INSIDER, (100 - percent) / 100 + 1e-9
    of = cells.groupBy("region").agg(
        F.max(F.when(insider, F.col("far"))).alias("_out"), F.min(F.when(~insider, F.col("far"))).alias("_in"), (F.min("far") < 0).alias("_open"),
        F.count_if(F.col("kind") == HOME).alias("_homes"), F.count_if(insider).alias("_insiders"), F.count_if(F.col("kind") == VISITOR).alias("_visitors"),
    )
    of = of.where("(_homes > 0 and _homes + _visitors > 1) or (_insiders > 0 and _visitors > 0)").withColumnRenamed("region", "_region")
    met = cells.where("far > -2").join(of, F.col("region") == F.col("_region"))
    stays = F.col("_open") | F.when(insider, F.col("far") >= F.col("_in") - step).otherwise(F.col("far") <= F.col("_out") + step)
    return met.where(F.coalesce(stays, F.lit(True))).select("region", "cid", "kind", "far", "shingles")


def deal_blocks(rows: DataFrame, sizes: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Regions that no pivot divides, as pairs of blocks (each with itself, too)."""
    blocks = F.greatest(F.ceil(2 * F.col("rows") / most_rows), F.ceil(2 * F.col("bytes") / most_bytes)).cast("int")
    some = rows.join(sizes.select("region", blocks.alias("blocks")), "region")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = some.withColumn("own", own).withColumn("other", other)
    name = F.concat_ws("#", "region", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(name.alias("region"), "cid", "kind", F.lit(-1.0).alias("far"), "shingles")


def jaccard_components(
    docs: DataFrame,
    k: int = 3,
    percent: int = 90,
    sample_rows: int = 20_000,
    most_frequent: int = 1 << 19,
    most_rows: int = 256,
    most_bytes: int = 1 << 24,
    depth: int = 3,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Rows link when ``100 * intersection >= percent * union`` of their shingle sets;
    component_id is the least doc_id that links reach.  Cases: null, empty and blank
    texts have no set and link with nothing; rows with equal sets link, whatever their
    doc_id; rows with a null doc_id take part and have a null component_id only where
    no doc_id is reachable; an empty table gives no rows; further columns are ignored.
    """
    with small_batches(docs.sparkSession):
        text = F.col("text").cast("string")
        return _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")), k, percent, sample_rows, most_frequent, most_rows, most_bytes, depth)


def _components(docs: DataFrame, k: int, percent: int, sample_rows: int, most_frequent: int, most_rows: int, most_bytes: int, depth: int) -> DataFrame:
    """All steps of ``jaccard_components`` that run Python are written before it returns."""
    spark = docs.sparkSession
    hints = spark.sparkContext.broadcast(frequent_shingles(docs, k, sample_rows, most_frequent))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = hints.value
        for batch in batches:
            sizes, digests, firsts, parities = [], [], [], []
            for x in batch.column(1):
                found = shingle_set(x.as_py(), k)
                sizes.append(len(found))
                digests.append(set_digest(found) if len(found) else None)
                firsts.append(prefix(found, percent, frequent, counts).view(np.int64) if len(found) else None)
                parities.append(parity(found) if len(found) else None)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "digest", "prefix", "parity"])

    sets, sets_path = materialize(docs.mapInArrow(describe, "doc_id long, key long, n long, digest binary, prefix array<long>, parity binary"), "sets")
    # a class is found again by one of its rows: the least doc_id, and the hash of that row's text
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("one")
    grouped = sets.where("n > 0").groupBy("digest").agg(one, F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    classes, classes_path = materialize(grouped.select("digest", F.col("one.doc_id").alias("least"), "one.key", "n", "prefix", "parity").withColumn("cid", F.monotonically_increasing_id()), "classes")
    # runs of close sizes among the classes that share a prefix shingle
    order = Window.partitionBy("shingle").orderBy("n", "cid")
    gap = F.coalesce((100 * F.lag("n").over(order) < percent * F.col("n")).cast("int"), F.lit(0))
    runs = classes.select("cid", "n", F.explode("prefix").alias("shingle")).withColumn("gap", gap).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy("shingle", "run")
    members = runs.withColumn("pivot", F.min("cid").over(group)).withColumn("among", F.count("*").over(group)).where("among > 1").select("pivot", "cid", "n").distinct()
    members, met_path = materialize(members, "members")
    crowded, crowded_path = materialize(members.groupBy("pivot").count().where(F.col("count") > most_rows).select("pivot"), "crowded")
    dealt = members.withColumns({"part": F.lit(0).cast("long"), "pair": F.lit(0).cast("long")})
    whole = None
    if not crowded.isEmpty():
        by_size, whole = deal_sizes(members.join(crowded, "pivot", "left_semi"), percent, most_rows)
        dealt = dealt.join(crowded, "pivot", "left_anti").unionByName(by_size)
    kept = prune_regions(dealt.join(classes.select("cid", "parity"), "cid"), percent)
    members, members_path = materialize(kept if whole is None else kept.unionByName(whole).distinct(), "members")
    drop(spark, crowded_path)
    drop(spark, met_path)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, pivots = [], [], []
            for text, digest, cid, regions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingle_set(text, k)
                if set_digest(found) == digest:  # else another row of that doc_id
                    ids.append(cid)
                    raws.append(found.tobytes())
                    pivots.append(regions)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(pivots, pa.list_(pa.int64()))], names=["cid", "shingles", "pivots"])

    wanted = members.groupBy("cid").agg(F.collect_list("pivot").alias("pivots")).join(classes.select("cid", "digest", "least", F.col("key").alias("of")), "cid")
    texts = docs.join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "digest", "cid", "pivots")
    # rows alike in id and text are one row's work: those classes are few, and only their texts are compared
    alike, alike_path = materialize(sets.where("n > 0").groupBy("doc_id", "key", "digest").agg(F.count("*").alias("rows")).where("rows > 1").select("digest").distinct(), "alike")
    if not alike.isEmpty():
        texts = texts.join(alike, "digest", "left_anti").unionByName(texts.join(alike, "digest", "left_semi").dropDuplicates(["cid"])).select(*texts.columns)
    rows = texts.mapInArrow(fetch, "cid long, shingles binary, pivots array<long>")
    rows = rows.select(F.explode(F.col("pivots").cast("array<string>")).alias("region"), "cid", F.lit(HOME).alias("kind"), F.lit(-1.0).alias("far"), "shingles")

    sizes = members.groupBy(F.col("pivot").cast("string").alias("region")).agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("bytes"))
    too_large = (F.col("rows") > most_rows) | (F.col("bytes") > most_bytes) & (F.col("rows") > 2)
    large, large_path = materialize(sizes.where(too_large), "large")
    temporary = [sets_path, members_path, large_path, alike_path]
    links: list[DataFrame] = []

    def join(small: DataFrame) -> None:
        edges, path = materialize(join_regions(small, percent).distinct(), "links")
        links.append(edges)
        temporary.append(path)

    if large.isEmpty():
        join(rows)
    else:
        rows, rows_path = materialize(rows, "regions")
        temporary.append(rows_path)
        join(rows.join(large, "region", "left_anti"))
        left = rows.join(large, "region", "left_semi")
        for level in range(depth + 1):
            if level == depth:
                join(deal_blocks(left, large, 4 * most_rows, 4 * most_bytes))
                break
            cells, cells_path = divide_regions(left, percent)
            links.append(cells.select(F.col("cid").alias("a"), F.explode("pivots").alias("b")))
            cells = in_windows(cells, percent)
            sizes = cells.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.length("shingles")).alias("bytes"))
            large, large_path = materialize(sizes.where(too_large), "large")
            temporary += [cells_path, large_path]
            join(cells.join(large.select("region"), "region", "left_anti"))
            if large.isEmpty():
                break
            left = cells.join(large.select("region"), "region", "left_semi")
    edges = functools.reduce(DataFrame.unionByName, links)
    parts = connected_components(edges, "jaccard")
    tied = classes.join(parts, F.col("cid") == F.col("node")).select("digest", "least", "component")
    named = with_least(tied, "component", "least", "digest", classes.count())
    named, named_path = materialize(named.select(F.col("digest").alias("d"), F.col("low").alias("name")), "named")
    own = classes.select("digest", "least").join(named, F.col("digest") == F.col("d"), "left").select(F.col("digest").alias("d"), F.coalesce("name", "least").alias("component"))
    found = sets.select("doc_id", "n", "digest").join(own, F.col("digest") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    found, _ = materialize(found, "components")
    drop(spark, classes_path, named_path, *temporary)
    return found
