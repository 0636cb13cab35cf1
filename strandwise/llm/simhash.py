"""Near-duplicates by SimHash with a segment-popcount embedding.

A 64-bit fingerprint is mapped to 32 counts, the bits set in each two-bit segment.  The Manhattan distance of two
such vectors is never above the Hamming distance of the fingerprints, so it serves as a lower bound.  Of the two
halves (16 counts each) of vectors within distance 4, one half is within 2; two lattice points within 2 share a
point within 1 of both.  Every fingerprint is therefore entered in the grid cells within 1 of each of its halves,
fingerprints meet in equal cells, and the exact Hamming distance is taken there.

Cells of more than LARGE fingerprints are dealt once more before they are compared, by five blocks of the fingerprint's
bits: four differences leave one block equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_first, materialize, row_key, word_chunks
from .components import components

SEGMENTS_A_HALF = 16
LARGE = 1 << 13
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and bits
_POWERS = 3 ** np.arange(SEGMENTS_A_HALF, dtype=np.int64)
_HALF = 3**SEGMENTS_A_HALF


def simhash(data: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text over its shingles of ``width`` words, repeats included."""
    votes, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks(data):
        words = tail + words
        if len(words) >= width:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            line = b" ".join(words)
            digest = xxhash.xxh64_intdigest
            hashes = np.array(
                [digest(line[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=False)], np.uint64
            )
            for i in range(0, len(hashes), 1 << 14):
                part = hashes[i : i + (1 << 14)]
                votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - width + 1 :] if width > 1 else []
        tail = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)) * (2 * votes > total).astype(np.uint64)).sum())


def _fingerprint_kernel(width: int, seed: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash((t.as_py() or "").encode(), width, seed) for t in batch.column(1)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed)], ["doc_id", "key", "fp"])

    return kernel


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp) per document; fp is the fingerprint as a signed long, key the row's key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("key"))
    return rows.mapInArrow(_fingerprint_kernel(width, seed), "doc_id long, key long, fp long")


def cells_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells within Manhattan distance 1 of both halves: (cell, index of the fingerprint)."""
    bits = prints.view(np.uint64)
    counts = np.stack([np.bitwise_count(bits >> np.uint64(2 * s) & np.uint64(3)) for s in range(2 * SEGMENTS_A_HALF)], 1).astype(np.int64)
    cells, owners = [], []
    for half in range(2):
        own = counts[:, half * SEGMENTS_A_HALF : (half + 1) * SEGMENTS_A_HALF]
        base = own @ _POWERS + half * _HALF
        cells.append(base)
        owners.append(np.arange(len(bits)))
        for step, inside in ((1, own < 2), (-1, own > 0)):
            row, segment = np.nonzero(inside)
            cells.append(base[row] + step * _POWERS[segment])
            owners.append(row)
    return np.concatenate(cells), np.concatenate(owners)


def _cell_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(prints), 4096):
            part = prints[i : i + 4096]
            cells, owners = cells_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(part[owners])], ["cell", "fp"])


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; parents point at smaller positions and are fully compressed."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def link_cells(cells: np.ndarray, prints: np.ndarray, distance: int, lags: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell.  ``cells`` is sorted.  Every pair of a cell is compared
    unless it is joined already; no list of pairs is built.

    Cells of more than ``lags`` rows are mostly one group of near copies: what the first lags have joined to the
    largest set is not compared again, only what is outside it, with all of the cell.
    """
    bits = prints.view(np.uint64)
    parent = np.arange(len(cells))
    left = np.arange(len(cells) - 1)
    for lag in range(1, lags + 1):
        left = left[: np.searchsorted(left, len(cells) - lag)]
        left = left[cells[left] == cells[left + lag]]
        if not len(left):
            break
        open_ = left[parent[left] != parent[left + lag]]
        near = open_[np.bitwise_count(bits[open_] ^ bits[open_ + lag]) <= distance]
        if len(near):
            _hook(parent, near, near + lag)
    for cell in np.unique(cells[left]) if len(left) else ():
        a, b = np.searchsorted(cells, [cell, cell + 1])
        roots, sizes = np.unique(parent[a:b], return_counts=True)
        for i in np.nonzero(parent[a:b] != roots[sizes.argmax()])[0] + a:
            near = np.nonzero((np.bitwise_count(bits[a:b] ^ bits[i]) <= distance) & (parent[a:b] != parent[i]))[0] + a
            if len(near):
                _hook(parent, near, np.full(len(near), i))
    hung = np.nonzero(parent != np.arange(len(cells)))[0]
    return prints[hung], prints[parent[hung]]


def blocks_of(cells: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What large cells are dealt by: (hash of the cell and one block of bits, fingerprint)."""
    bits, keys = prints.view(np.uint64), []
    for i, (first, n) in enumerate(_BLOCKS):
        x = cells.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (bits >> np.uint64(first) & np.uint64((1 << n) - 1)) * np.uint64(8) + np.uint64(i)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append((x ^ (x >> np.uint64(27))).view(np.int64))
    return np.concatenate(keys), np.tile(prints, len(_BLOCKS))


def _link_kernel(distance: int, large: int | None, chunk: int = 1 << 19):
    """Links (kind 0: a, b) inside the cells of rows sorted by cell; cells of more than ``large`` rows are passed on
    instead (kind 1: block, fingerprint), however long they are."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def solve(cells: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if large is not None and len(cells) > large:
            starts = np.nonzero(np.diff(cells, prepend=cells[0] - 1))[0]
            sizes = np.diff(np.concatenate((starts, [len(cells)])))
            over = np.repeat(sizes > large, sizes)
            if over.any():
                yield from defer(cells[over], prints[over])
                cells, prints = cells[~over], prints[~over]
        if len(cells):
            a, b = link_cells(cells, prints, distance)
            if len(a):
                yield batch(0, a, b)

    def defer(cells: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(cells), 1 << 14):
            yield batch(1, *blocks_of(cells[i : i + (1 << 14)], prints[i : i + (1 << 14)]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, full, passing = 0, chunk, None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, full, passing
            if not held:
                return
            cells, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            if passing is not None:  # the rest of a cell whose first rows were passed on
                more = int(np.searchsorted(cells, passing, "right"))
                yield from defer(cells[:more], prints[:more])
                cells, prints = cells[more:], prints[more:]
                passing = passing if not len(cells) else None
            if len(cells):
                end = len(cells) if last else int(np.searchsorted(cells, cells[-1]))
                yield from solve(cells[:end], prints[:end])
                if large is not None and len(cells) - end > large:
                    passing = cells[-1]
                    yield from defer(cells[end:], prints[end:])
                    end = len(cells)
                cells, prints = cells[end:], prints[end:]
            held, size = [(cells, prints)], len(cells)
            full = max(chunk, 2 * size)

        for rows in batches:
            held.append(tuple(rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            size += len(rows)
            if size >= full:
                yield from flush(False)
        yield from flush(True)

    return kernel


def links(prints: DataFrame, distance: int = 4, large: int = LARGE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect exactly those that are linked, directly or not."""
    if distance > 4:
        raise ValueError("cells within 1 of each half, and five blocks, find distances up to 4")
    schema = "kind int, a long, b long"
    entered = prints.select("fp").mapInArrow(_cell_kernel, "cell long, fp long")
    dealt = entered.repartition("cell").sortWithinPartitions("cell", "fp")
    met = materialize(dealt.mapInArrow(_link_kernel(distance, large), schema), "links")
    found = met.where("kind = 0")
    passed = met.where("kind = 1").select("a", "b")
    if not passed.isEmpty():
        again = passed.distinct().repartition("a").sortWithinPartitions("a", "b")
        found = found.unionByName(again.mapInArrow(_link_kernel(distance, None), schema))
    return found.select("a", "b").where("a <> b").distinct()


def _rooted(docs: DataFrame, width: int, seed: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and of each distinct one (fp, least_id, root), root naming its component."""
    prints = materialize(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    linked = components(links(distinct, distance), "a", "b")
    return prints, distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id among all documents reachable through fingerprints that differ in at most
    ``distance`` bits.  Null, empty and blank texts have fingerprint zero, which links like any other.  Texts of
    fewer than ``width`` words hash as one shingle.  Repeated rows give repeated rows; a null doc_id keeps its row
    and is never a component's id unless the component has no other.  An empty table gives no rows.

    Copies meet once as one distinct fingerprint, so groups of copies cost nothing beyond the aggregate.
    """
    prints, rooted = _rooted(docs, width, seed, distance)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each component of near-duplicates, all columns kept: the row with the smallest doc_id
    (null ids last), and of rows that repeat both id and text any one."""
    prints, rooted = _rooted(docs, width, seed, distance)
    return keep_first(docs, prints.join(rooted.select("fp", "root"), "fp").select("doc_id", "key", "root"))
