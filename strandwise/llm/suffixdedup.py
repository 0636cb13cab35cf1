"""Removal of repeated substrings by a hash-compared suffix sort.

Of every string of ``LENGTH`` bytes that occurs more than once, all occurrences but the first (by doc_id, then
position) are removed.  The strings are the suffixes of all texts cut to LENGTH bytes, and equal ones are neighbours
in their sorted order.  Suffixes are compared through prefix polynomial hashes: a binary search finds the common
extension of two in logarithmic time, a mergesort uses it, and neighbours that hash alike are verified byte by byte.

Sorting every suffix of a corpus together would move each text a hundred times.  Instead

1. each suffix is dealt by its anchor, the K-gram of least hash among those it holds, so equal suffixes meet; a run
   of successive suffixes with one anchor travels as one row of some 20 bytes for 33 bytes of text.  Of equal runs
   that one task reads together only the first travels.  K-grams that anchor too many runs anchor nothing that
   another K-gram can, so no key is hot;
2. only runs whose anchor occurs elsewhere too send their bytes, and those are sorted: first whole runs, so that each
   text that is repeated is sorted once, then the suffixes of those runs that differ;
3. spans are gathered by document and cut out.

Nothing is removed because hashes agree: wherever the sort finds two strings equal, their bytes are compared.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH = 100
K = 36
SLICE = 1 << 18  # positions in one slice; they fit the low bits of a packed hash
CHUNK = 1 << 14  # runs that are sorted together, but for those of one anchor
_LOW = np.uint64(SLICE - 1)
_TOP = np.uint64(1 << 63)
_TABLE = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPANS = "kind int, doc_id long, sub long, start long, end long, h long, r int, o int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Polynomial:
    """Prefix polynomial hashes modulo 2^64 over randomised bytes; the hash of any substring takes two lookups."""

    def __init__(self) -> None:
        self._up, self._down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self._up[: len(data)], out=out[1:])
        return out

    def grams(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        return (prefixes[size:] - prefixes[:-size]) * self._down[: len(prefixes) - size]

    def spans(self, prefixes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (prefixes[start + size] - prefixes[start]) * self._down[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Heavy:
    """The hashes of K-grams that anchor too many runs, with a table of their leading bits in front."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> np.ndarray:
        near = np.nonzero(self.table[(grams >> np.uint64(42)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.hashes, grams[near]), max(0, len(self.hashes) - 1))
        return near[self.hashes[at] == grams[near]] if len(near) else near


def runs_of(data: np.ndarray, ends: np.ndarray, poly: Polynomial, heavy: Heavy | None) -> tuple[np.ndarray, ...]:
    """Runs of one slice: (anchor hash, first suffix, number of suffixes, anchor - first suffix).

    ``ends`` are the ends of the pieces of text that make up the slice; no suffix of LENGTH crosses one.
    """
    grams = _mix(poly.grams(poly.prefixes(data), K))
    packed = (grams >> np.uint64(1) & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    if heavy is not None:
        packed[heavy.places(grams)] |= _TOP
    starts = np.concatenate(([0], ends[:-1]))
    first = np.concatenate([np.arange(a, max(a, b - LENGTH + 1)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    anchor = (_least(packed, LENGTH - K + 1)[first] & _LOW).astype(np.int64)
    cuts = np.nonzero(np.diff(anchor, prepend=-1))[0]
    at = anchor[cuts]
    size = np.diff(np.concatenate((cuts, [len(anchor)])))
    return grams[at], first[cuts], size, at - first[cuts]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, piece ends, doc_id and sub of each piece, offset of each piece in its text) in slices of up to SLICE
    bytes.  Pieces of a long text overlap by LENGTH - 1 bytes, so each suffix is in one."""
    data: list[bytes] = []
    ids, subs, offsets, size = [], [], [], 0

    def flush():
        ends = np.cumsum([len(x) for x in data])
        return np.frombuffer(b"".join(data), np.uint8), ends, *(np.array(x, np.int64) for x in (ids, subs, offsets))

    step = SLICE // 2
    for doc_id, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw = (text.as_py() or "").encode()
        for a in range(0, len(raw) - LENGTH + 1, step):
            piece = raw[a : a + step + LENGTH - 1]
            if size + len(piece) > SLICE:
                yield flush()
                data, ids, subs, offsets, size = [], [], [], [], 0
            data.append(piece)
            ids.append(doc_id)
            subs.append(sub)
            offsets.append(a)
            size += len(piece)
    if data:
        yield flush()


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(columns[0])) + b"".join(c.tobytes() for c in columns))


def _unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


_RUN = ("<u8", "<i8", "<i8", "<u4", "u1", "u1")
_LOCAL = ("<i8", "<i8", "<u4", "u1")
_DEALT = (("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()))


def _first_of_equal(keys: list[np.ndarray], *place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys and ``place`` (doc, sub, position); returns the order, which rows are first of their keys, and which
    repeat an earlier one.  A row with the first's own place is the same place, read twice, and does neither."""
    order = np.lexsort((*place[::-1], *keys[::-1]))
    n = len(order)
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    later = np.logical_or.reduce([p[order] != p[order][lead] for p in place])
    return order, fresh, later


def _repeated(h: np.ndarray) -> np.ndarray:
    """Rows whose value occurs more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    mask = np.zeros(len(h), bool)
    mask[order[1:]] |= same
    mask[order[:-1]] |= same
    return mask


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, equal where all columns are."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), np.int64)
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _chunks(h: np.ndarray) -> Iterator[slice]:
    """Parts of a sorted array of some CHUNK rows that cut no run of equal values."""
    cuts = np.concatenate((np.nonzero(np.diff(h))[0] + 1, [len(h)]))
    at = 0
    while at < len(h):
        end = int(cuts[np.searchsorted(cuts, min(at + CHUNK, len(h)))])
        yield slice(at, end)
        at = end


def equal_runs(data: np.ndarray, begin: np.ndarray, h: np.ndarray, r: np.ndarray, o: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which runs are not equal to an earlier one, and which repeat one of another place, by sorting whole runs."""
    group = _numbered(h, r, o)  # equal runs have equal anchors at one offset, and equal lengths
    first, gone = np.ones(len(h), bool), np.zeros(len(h), bool)
    some = np.nonzero(_repeated(group))[0]
    some = some[np.argsort(group[some], kind="stable")]
    if len(some):
        order, label = SuffixSorter(data).classes(begin[some], group[some], r[some] + LENGTH - 1)
        at = some[order]
        by, fresh, later = _first_of_equal([label], *(p[at] for p in place))
        first[at[by[~fresh]]] = False
        gone[at[by[later]]] = True
    return first, gone


def _heavy_kernel(least: int, part: int):
    """Counts of anchors: those that a flush holds ``least`` times, and one in ``part`` of the others for all."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= least
            # another one in each flush, and the same one when a task is run again
            drawn = ~often & (_mix(values ^ _mix(values[:1] + np.uint64(len(values)))) % np.uint64(part) == 0)
            values, n = np.concatenate((values[often], values[drawn])), np.concatenate((n[often], n[drawn] * part))
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for batch in batches:
            for data, ends, *_ in _slices(batch):
                held.append(runs_of(data, ends, poly, None)[0])
                size += len(held[-1])
                if size >= 1 << 18:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return kernel


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _DEALT, strict=True)], [n for n, _ in _DEALT])


def _gathered(texts: list[np.ndarray], begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some runs in a row, and where each begins."""
    at = np.cumsum(size) - size
    return np.concatenate([t[a : a + n] for t, a, n in zip(texts, begin.tolist(), size.tolist(), strict=True)]), at


def _run_kernel(heavy: np.ndarray, bits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, shunned = Polynomial(), Heavy(heavy)
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, doc, sub, at, r, o, begin, source = (np.concatenate(x) for x in zip(*held, strict=True))
            again = np.nonzero(_repeated(h))[0]
            again = again[np.argsort(h[again], kind="stable")]
            stay, gone = np.ones(len(h), bool), np.zeros(len(h), bool)
            for part in _chunks(h[again]):
                i = again[part]
                data, start = _gathered([texts[k] for k in source[i].tolist()], begin[i], r[i] + LENGTH - 1)
                stay[i], gone[i] = equal_runs(data, start, h[i], r[i], o[i], [doc[i], sub[i], at[i]])
            gone, stay = np.nonzero(gone)[0], np.nonzero(stay)[0]
            stay = stay[np.argsort(h[stay])]
            bucket = (h[stay] >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.concatenate((np.nonzero(np.diff(bucket, prepend=-1))[0], [len(bucket)]))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                i = stay[a:b]
                rows.append((int(bucket[a]), 0, _pack(h[i], doc[i], sub[i], at[i].astype("<u4"), r[i].astype("u1"), o[i].astype("u1"))))
            for a in range(0, len(gone), 1 << 16):
                i = gone[a : a + (1 << 16)]
                rows.append((int(h[i[0]] >> np.uint64(64 - bits)), 1, _pack(doc[i], sub[i], at[i].astype("<u4"), r[i].astype("u1"))))
            return _dealt_batch(rows)

        for batch in batches:
            for data, ends, ids, subs, offsets in _slices(batch):
                h, first, r, o = runs_of(data, ends, poly, shunned)
                h = _mix(h)  # anchors are least hashes: mixed again, their leading bits are even
                piece = np.searchsorted(ends, first, "right")
                start = np.concatenate(([0], ends[:-1]))[piece]
                held.append((h, ids[piece], subs[piece], first - start + offsets[piece], r, o, first, np.full(len(h), len(texts))))
                texts.append(data)
                size += len(h)
                if size >= 1 << 18:
                    yield flush()
                    held, texts, size = [], [], 0
        if size:
            yield flush()

    return kernel


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """The (kind, data) rows of each bucket; rows come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            if bucket.as_py() != now:
                if rows:
                    yield rows
                now, rows = bucket.as_py(), []
            rows.append((kind.as_py(), data.as_py()))
    if rows:
        yield rows


def _span_batch(kind: int, doc, sub, start, end, h=None, r=None, o=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int64)
    columns = [np.full(n, kind), doc, sub, start, end, zero if h is None else h.view(np.int64), zero if r is None else r, zero if o is None else o]
    fields = [x.split() for x in _SPANS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int32 if t == "int" else np.int64)) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _meet_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tasks found repeated (kind 0), and the runs whose anchor is that of another run, too (kind 1)."""
    for rows in _by_bucket(batches):
        parts = [_unpack(d, _RUN) for kind, d in rows if kind == 0]
        for kind, d in rows:
            if kind == 1:
                doc, sub, at, r, _ = _unpack(d, _LOCAL)
                yield _span_batch(0, doc, sub, at.astype(np.int64), at.astype(np.int64) + r + LENGTH - 1)
        if not parts:
            continue
        h, doc, sub, at, r, o, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        again = np.nonzero(_repeated(h))[0]
        for a in range(0, len(again), 1 << 16):
            i = again[a : a + (1 << 16)]
            start = at[i].astype(np.int64)
            yield _span_batch(1, doc[i], sub[i], start, start + r[i] + LENGTH - 1, h[i], r[i], o[i])


def _context_kernel(bits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                yield from one(batch.slice(a, 256))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = batch.column(3)
        field = {n: asked.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("h", "start", "r", "o")}
        count = np.diff(asked.offsets.to_numpy())
        texts = [np.frombuffer((t.as_py() or "").encode(), np.uint8) for t in batch.column(2)]
        owner = np.repeat(np.arange(len(texts)), count)
        h = field["h"].view(np.uint64)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.concatenate((np.nonzero(np.diff(bucket[order], prepend=-1))[0], [len(order)]))
        doc, sub = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            i = order[a:b]
            data, _ = _gathered([texts[k] for k in owner[i].tolist()], field["start"][i], field["r"][i].astype(np.int64) + LENGTH - 1)
            rows.append((int(bucket[i[0]]), 2, _pack(h[i], doc[owner[i]], sub[owner[i]], field["start"][i].astype("<u4"), field["r"][i].astype("u1"), field["o"][i].astype("u1"), data)))
        if rows:
            yield _dealt_batch(rows)

    return kernel


class SuffixSorter:
    """Mergesort of suffixes, cut to LENGTH bytes or to ``size``, inside groups; all groups are merged at once."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.poly = data, Polynomial()
        self.prefixes = self.poly.prefixes(data)

    def extension(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to ``size``, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), size - 1
        equal = self.poly.spans(self.prefixes, a, size) == self.poly.spans(self.prefixes, b, size)
        low[equal] = size[equal]
        open_ = np.nonzero(~equal)[0]
        while len(open_):
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.poly.spans(self.prefixes, a[open_], mid) == self.poly.spans(self.prefixes, b[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def less(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        shared = self.extension(a, b, size)
        x = self.data[np.minimum(a + shared, len(self.data) - 1)]
        y = self.data[np.minimum(b + shared, len(self.data) - 1)]
        return np.where(shared == size, or_equal, x < y)

    def sort(self, suffix: np.ndarray, group: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """Order of the suffixes by group, then content.  ``group`` is sorted, and ``size`` is that of a group."""
        size = np.full(len(suffix), LENGTH) if size is None else size
        order = np.arange(len(suffix))
        begins = np.nonzero(np.diff(group, prepend=-1))[0]
        length = np.diff(np.concatenate((begins, [len(group)])))
        begin, full = np.repeat(begins, length), np.repeat(length, length)
        width = 1
        while len(length) and width < length.max():
            here = np.nonzero(full > width)[0]
            inside = here - begin[here]
            pair = inside // (2 * width) * (2 * width)
            left = inside - pair < width
            mine = np.where(left, pair, pair + width)
            other = np.where(left, pair + width, pair)
            other_end = np.minimum(other + width, full[here])
            low, high = np.minimum(other, full[here]), other_end.copy()
            # a left suffix goes behind the right ones that are less, a right one behind the left ones not greater
            open_ = np.nonzero(low < high)[0]
            while len(open_):
                mid = (low[open_] + high[open_]) // 2
                behind = self.less(suffix[order[begin[here[open_]] + mid]], suffix[order[here[open_]]], size[here[open_]], ~left[open_])
                low[open_] = np.where(behind, mid + 1, low[open_])
                high[open_] = np.where(behind, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            rank = begin[here] + pair + (inside - mine) + (low - np.minimum(other, full[here]))
            merged = order.copy()
            merged[rank] = order[here]
            order = merged
            width *= 2
        return order

    def classes(self, suffix: np.ndarray, group: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order and the number of each place's class of equal strings, verified byte by byte."""
        size = np.full(len(suffix), LENGTH) if size is None else size
        order = self.sort(suffix, group, size)
        a, b, n = suffix[order[:-1]], suffix[order[1:]], size[order[1:]]
        same = group[order[1:]] == group[order[:-1]]
        at = np.nonzero(same)[0]
        same[at] = self.poly.spans(self.prefixes, a[at], n[at]) == self.poly.spans(self.prefixes, b[at], n[at])
        at = np.nonzero(same)[0]
        reach, last = np.arange(size.max(initial=0)), len(self.data) - 1
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            x, y = (self.data[np.minimum(z[part][:, None] + reach, last)] for z in (a, b))
            if not ((x == y) | (reach >= n[part][:, None])).all():  # a collision: sort the bytes themselves
                return self._plain(suffix, group, size)
        return order, np.cumsum(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)

    def _plain(self, suffix: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [(int(g), self.data[s : s + n].tobytes()) for g, s, n in zip(group, suffix, size, strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        fresh = [i == 0 or keys[order[i]] != keys[order[i - 1]] for i in range(len(order))]
        return np.array(order, np.int64), np.cumsum(fresh)


def _resolve_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches):
        parts = [_unpack(d, _RUN) for _, d in rows]
        h, doc, sub, at, r, o, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, r, o = at.astype(np.int64), r.astype(np.int64), o.astype(np.int64)
        begin = np.cumsum(r + LENGTH - 1) - (r + LENGTH - 1)
        by = np.argsort(h, kind="stable")
        for part in _chunks(h[by]):
            i = by[part]
            text, start = _gathered([data] * len(i), begin[i], r[i] + LENGTH - 1)
            yield from _resolved(text, start, h[i], [doc[i], sub[i], at[i]], r[i], o[i])


def _resolved(data: np.ndarray, begin: np.ndarray, h: np.ndarray, place: list[np.ndarray], r: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The spans of what repeats in some runs that hold all runs of their anchors: whole runs first, then the suffixes
    of those that are left."""
    first, again = equal_runs(data, begin, h, r, o, place)
    doc, sub, at = place
    if again.any():
        yield _span_batch(0, doc[again], sub[again], at[again], at[again] + r[again] + LENGTH - 1)
    left = np.nonzero(first)[0]
    left = left[_repeated(h[left])]
    if not len(left):
        return
    begin, h, doc, sub, at, r, o = (x[left] for x in (begin, h, doc, sub, at, r, o))
    run = np.repeat(np.arange(len(h)), r)
    step = np.arange(len(run)) - np.repeat(np.cumsum(r) - r, r)
    anchor = np.unique(h, return_inverse=True)[1]
    # equal strings hold their anchor at one offset
    group = anchor[run] * 128 + o[run] - step
    some = np.nonzero(_repeated(group))[0]
    some = some[np.argsort(group[some], kind="stable")]
    if not len(some):
        return
    suffix = begin[run[some]] + step[some]
    order, label = SuffixSorter(data).classes(suffix, group[some])
    where = some[order]
    by, _, later = _first_of_equal([label], doc[run[where]], sub[run[where]], at[run[where]] + step[where])
    gone = np.zeros(len(run), bool)
    gone[where[by[later]]] = True
    # successive strings of one run make one span
    edge = np.diff(gone.astype(np.int8), prepend=0)
    starts = np.nonzero((edge == 1) | (gone & (step == 0)))[0]
    ends = np.nonzero(gone & np.concatenate((~gone[1:] | (step[1:] == 0), [True])))[0]
    yield _span_batch(0, doc[run[starts]], sub[run[starts]], at[run[starts]] + step[starts], at[run[ends]] + step[ends] + LENGTH)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], s[1:] > e[:-1]))
    cuts = np.nonzero(fresh)[0]
    return s[cuts], e[np.concatenate((cuts[1:], [len(s)])) - 1]


def _cut_kernel(with_text: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
            for text, starts, ends in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw = (text.as_py() or "").encode()
                s, e = (np.array(x.as_py() or [], np.int64) for x in (starts, ends))
                if len(s):
                    s, e = merge_spans(s, np.minimum(e, len(raw)))
                rest = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(len(s))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string()), pa.array(kept if with_text else [None] * len(batch), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return kernel


def _with_sub(rows: DataFrame) -> DataFrame:
    """Adds ``sub``, which tells rows apart that share a doc_id but not a text: a hash of the text, 0 for other rows."""
    key = F.xxhash64("text")
    shared = rows.groupBy("doc_id").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).where("_a <> _b").select("doc_id", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("sub"), "text")
    return rows.join(shared, "doc_id", "left").select("doc_id", F.when(F.col("_shared"), key).otherwise(0).alias("sub"), "text")


def repeated_spans(rows: DataFrame, bucket_bytes: int = 4 << 20) -> tuple[DataFrame, ...]:
    """(kind 0, doc_id, sub, start, end) tables of byte ranges of ``rows`` (doc_id, sub, text), made of strings that
    occur earlier."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (total // bucket_bytes).bit_length())
    # a task has some 256 MB of text, or a share of a small input, and works on one bucket at a time
    tasks = min(1 << bits, max(3 * rows.sparkSession.sparkContext.defaultParallelism, total >> 28))
    # at most 2^20 anchors can hold this share of all runs, so the list of heavy ones has a bound
    often = max(256, total // 33 >> 20)
    counted = rows.mapInArrow(_heavy_kernel(3, 16), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    heavy = np.sort(np.array([r.h for r in counted.select("h").collect()], np.int64).view(np.uint64))
    dealt = rows.mapInArrow(_run_kernel(heavy, bits), "bucket int, kind int, data binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    met = materialize(dealt.mapInArrow(_meet_kernel, _SPANS), "runs")
    asked = met.where("kind = 1").groupBy("doc_id", "sub").agg(F.collect_list(F.struct("h", "start", "r", "o")).alias("asked"))
    context = rows.join(asked, ["doc_id", "sub"]).select("doc_id", "sub", "text", "asked").mapInArrow(_context_kernel(bits), "bucket int, kind int, data binary")
    sorted_ = materialize(context.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve_kernel, _SPANS), "suffixes")
    return met, sorted_


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs`` (doc_id, text; other columns are
    ignored): every byte covered by a string of 100 bytes that also starts earlier, in a smaller doc_id or before it in
    the same text, is removed.  ``kept`` holds what is left if ``with_text``, else null.

    Null texts are empty; texts shorter than 100 bytes lose nothing.  Rows with a null doc_id have no place in the
    order: they lose nothing, and nothing is removed for them.  A row that repeats an id and its text is the same
    document, returned as often as it occurs; different texts under one id are documents of their own, in the order of
    a hash of the text.  An empty table gives no rows.
    """
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _with_sub(all_.where("doc_id is not null"))
    parts = repeated_spans(rows)
    spans = parts[0].where("kind = 0").unionByName(parts[1]).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, ["doc_id", "sub"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    none = F.array().cast("array<bigint>")
    joined = joined.unionByName(all_.where("doc_id is null").select("doc_id", "text", none.alias("starts"), none.alias("ends")))
    return joined.mapInArrow(_cut_kernel(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
