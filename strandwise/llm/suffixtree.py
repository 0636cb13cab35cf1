"""Language-model scoring with a probabilistic suffix tree over words.

A state is a context of 1 to ``depth`` words.  A context s is retained if its next words diverge from those of its
longest proper suffix s': the sum of c(s,a)/n(s) * ln((c(s,a)/n(s)) / (c(s',a)/n(s'))) over the words a that followed
s at least ``least`` times reaches ``divergence``.  The next-word distribution of a state is smoothed towards its
longest retained suffix: p(a|s) = (c(s,a) + alpha * p(a|suffix)) / (n(s) + alpha), down to the unigram model, and each
word is scored in the longest retained state that ends before it.  Nothing else bounds the model: it holds every
context of the corpus that passes the test, and no table of it reaches the driver or is broadcast.

Texts are packed into slices of some 2^20 tokens, kept in a table.  For each length the slices ask for their distinct (context, next
word) pairs, with the counts of their own training texts; requests meet in buckets by the hash of the context, where
counts are added up and the test is made, and the answers return to the slices.  So a pair is counted, tested and
looked up in one round trip, repeated text costs one row a slice, and a slice never needs the model, only the answers.

Two rules keep longer contexts few, and neither changes the model.  A context that occurs fewer than ``least`` times
has no next word that counts.  The extensions of a context that is always followed by the same word are followed by
that word as well, so none of them diverges.

A context with more than 1/2^17 of all tokens is dealt by its next words instead, and its test is added up from the
parts; there are at most 2^17 of these at each length, so their list has a bound.  Words and contexts are told apart by
64-bit hashes.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, discard, materialize

SLICE = 1 << 20  # tokens of a slice
#: A slice is some MB, so few of them are in an Arrow batch.
FEW = BLOBS | {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
BUCKET = 1 << 21  # tokens of the corpus for each bucket
HEAVY_PARTS = 17  # contexts of more than 1/2^17 of all tokens are heavy
PIECE = 1 << 20  # bytes of a long text that are split into words at once
LEAST_HEAVY = 1 << 16
_RUN = 1 << 14  # integers put together at once

_END, _BEGIN = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" begin"))  # no word holds a blank
_ODD = np.uint64(0x9E3779B97F4A7C15)
TRAINS, HELD_OUT, NO_ID = 1, 2, 4
_ROWS = "slice long, bucket int, data binary"
_ANSWERS = "slice long, bucket int, key long, value double, data binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, each as planes of its bytes, without the planes that are all zero."""
    parts = [struct.pack("<B", len(columns))]
    for c in columns:
        wide = np.ascontiguousarray(c).astype("<u8", copy=False)
        width = max(1, (int(wide.max()).bit_length() + 7) // 8) if len(wide) else 1
        parts += [struct.pack("<IB", len(wide), width), np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _joined(planes: np.ndarray) -> np.ndarray:
    """Integers from the planes of their bytes, lowest first."""
    width, n = planes.shape
    if width > 3 and (n < _RUN or width == 8):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = planes.T
        return wide.reshape(-1).view("<u8")
    # whole runs at a time, which is faster than byte by byte
    out = planes[0].astype("<u8")
    room = np.empty(min(n, _RUN), "<u8")
    for at in range(0, n if width > 1 else 0, _RUN):
        part = out[at : at + _RUN]
        byte = room[: len(part)]
        for k in range(1, width):
            np.copyto(byte, planes[k, at : at + _RUN])
            byte <<= np.uint64(8 * k)
            part |= byte
    return out


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1
    for _ in range(raw[0]):
        n, width = struct.unpack_from("<IB", raw, at)
        out.append(_joined(np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n)))
        at += 5 + n * width
    return out


def _order(x: np.ndarray) -> np.ndarray:
    """The order that sorts 64-bit keys, by one sort of keys and places packed into one word where they fit."""
    bits = max(1, len(x).bit_length())
    x = x.astype(np.uint64, copy=False)
    place, room = np.arange(len(x), dtype=np.uint64), np.uint64(bits)
    whole = not len(x) or int(x.max()) < 1 << (64 - bits)
    packed = np.sort((x << room if whole else x >> room << room) | place)
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if not whole and (x[order[1:]] < x[order[:-1]]).any():  # keys that differ in their last bits only
        return np.argsort(x, kind="stable")
    return order


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of each place's value."""
    order = _order(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[order[1:]] != x[order[:-1]]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    return x[first], first, number


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (A-Z in lower case, split at \\x20 and \\x09-\\x0D) and the index of each one's text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, owner = parts.flatten(), np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    words, owner = split_words(texts)
    coded = words.dictionary_encode()
    unique = coded.dictionary
    _, ends, data = unique.buffers()
    data, digest = data.to_pybytes() if data else b"", xxhash.xxh64_intdigest
    ends = np.frombuffer(ends, np.int32)[unique.offset : unique.offset + len(unique) + 1].tolist() if len(unique) else [0]
    hashes = np.array([digest(data[a:b]) for a, b in zip(ends, ends[1:])], np.uint64)
    return np.split(hashes[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(owner, np.arange(1, len(texts))))


def _cuts(text: str, size: int) -> Iterator[str]:
    """A text in runs of some ``size`` characters, cut where a word ends."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def held_out(fold: int = 0, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


@dataclass
class Slice:
    """Some texts, or pieces of long ones, as tokens; each piece begins with the tokens before it (``lead`` of them)
    and the last piece of a text has the end.

    ``words`` are hashes at first, then numbers, the frequent ones of the slice first.  ``grams[m - 2][j]`` is how often
    the m tokens that end at j occur in training; below 2 it may read 0.  ``kept[k - 1]`` says whether the k tokens before
    j are a retained state.  ``active`` are the places that ask at the next length, ``sure`` those whose next word follows
    from a shorter context.
    """

    row_id: np.ndarray
    doc_id: np.ndarray
    flags: np.ndarray  # TRAINS, HELD_OUT, NO_ID
    size: np.ndarray
    lead: np.ndarray
    words: np.ndarray
    counts: np.ndarray  # of the words in training, once they are known
    tokens: np.ndarray  # index into words
    grams: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    active: np.ndarray | None = None
    sure: np.ndarray | None = None

    def __post_init__(self) -> None:
        starts = np.cumsum(self.size) - self.size
        self.place = (np.arange(len(self.tokens)) - np.repeat(starts, self.size)).astype(np.int32)
        self.own = self.place >= np.repeat(self.lead.astype(np.int32), self.size)
        self.weight = self.own & np.repeat(self.flags & TRAINS == TRAINS, self.size)

    def to_bytes(self) -> bytes:
        bits = [np.packbits(x) for x in (*self.kept, *([self.active, self.sure] if self.active is not None else []))]
        shape = np.array([len(self.grams), len(bits)])
        return _pack(self.row_id, self.doc_id, self.flags, self.size, self.lead, self.words, self.counts, self.tokens, shape, *self.grams, *bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> Slice:
        columns = _unpack(data)
        row_id, doc_id, flags, size, lead, counts, tokens = (columns[i].view(np.int64) for i in (0, 1, 2, 3, 4, 6, 7))
        grams, bits = columns[8].tolist()
        found = cls(row_id, doc_id, flags, size, lead, columns[5], counts, tokens, [c.view(np.int64) for c in columns[9 : 9 + grams]])
        rest = [np.unpackbits(c.astype(np.uint8), count=len(tokens)).view(bool) for c in columns[9 + grams : 9 + grams + bits]]
        if rest:
            found.kept, found.active, found.sure = rest[:-2], rest[-2], rest[-1]
        return found

    def often(self, m: int, at: np.ndarray | None = None) -> np.ndarray:
        """How often the m tokens that end at some places, or at all, occur in training."""
        if m == 1:
            return self.counts[self.tokens if at is None else self.tokens[at]]
        return self.grams[m - 2] if at is None else self.grams[m - 2][at]

    def numbered(self, ids: np.ndarray, counts: np.ndarray, least: int) -> None:
        """Take in the numbers and counts of the words; then each token asks what follows the one before it."""
        end, begin = (np.nonzero(self.words == x)[0] for x in (_END, _BEGIN))
        counts[begin] = counts[end]  # a text that trains begins as often as it ends
        self.words, self.counts = ids.astype(np.uint64), counts
        self.sure = np.zeros(len(self.tokens), bool)
        self.active = self.place >= 1
        self.active[1:] &= self.often(1)[:-1] >= least


@dataclass
class Requests:
    """The distinct (context, next word) pairs of a slice, grouped by context, and in the order of their buckets."""

    at: np.ndarray  # the places that ask
    pair: np.ndarray  # the pair of each of them
    context: np.ndarray  # hash of each distinct context
    often: np.ndarray  # n(s) and n(s') of each distinct context
    often_suffix: np.ndarray
    owner: np.ndarray  # context of each pair
    word: np.ndarray  # next word of each pair, as an index into the words of the slice
    count: np.ndarray  # in the training texts of this slice
    count_suffix: np.ndarray  # c(s', a)
    order: np.ndarray
    bucket: np.ndarray  # of the pairs, in that order


def heavy_bound(total: int) -> int:
    return max(LEAST_HEAVY, total >> HEAVY_PARTS)


def requests(s: Slice, length: int, total: int, bits: int) -> Requests:
    at = np.nonzero(s.active)[0]
    if length == 1:
        before = s.tokens[at - 1]
        there = np.bincount(before, minlength=len(s.words)) > 0
        hashes = _mix(s.words[there] + np.uint64(1))
        rank = _order(hashes)
        number = np.zeros(len(s.words), np.int64)
        number[np.nonzero(there)[0][rank]] = np.arange(len(rank))
        context, owner, often = hashes[rank], number[before], s.counts[there][rank]
        often_suffix = np.full(len(context), total)
    else:
        hashes, words = np.zeros(len(at), np.uint64), s.words[s.tokens]
        for i in range(1, length + 1):
            hashes *= _ODD
            hashes += words[at - i]
            hashes += np.uint64(i)
            hashes = _mix(hashes)
        del words
        context, first, owner = _distinct(hashes)
        often, often_suffix = (s.often(m, at[first] - 1) for m in (length, length - 1))
    pairs, some, pair = _distinct(owner * len(s.words) + s.tokens[at])
    owner, word = pairs // max(1, len(s.words)), pairs % max(1, len(s.words))
    key = context[owner]
    spread = (often > heavy_bound(total))[owner]
    if spread.any():
        key[spread] = _mix(key[spread] ^ _mix(s.words[word[spread]] + _ODD))
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable") if spread.any() else np.arange(len(bucket))
    count = np.bincount(pair[s.weight[at]], minlength=len(pairs))
    return Requests(at, pair, context, often, often_suffix, owner, word, count, s.often(length, at[some]), order, bucket[order])


def _bounds(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate((np.nonzero(np.diff(bucket, prepend=-1))[0], [len(bucket)]))


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each occurs."""
    cuts = _bounds(owner)
    return owner[cuts[:-1]], np.diff(cuts)


def _batch(rows: list[tuple], schema: tuple) -> pa.RecordBatch:
    names, types = zip(*schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types, strict=True)], list(names))


_ROW_SCHEMA = (("slice", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()))
_ANSWER_SCHEMA = (("slice", pa.int64()), ("bucket", pa.int32()), ("key", pa.int64()), ("value", pa.float64()), ("data", pa.binary()))


def _asking(number: int, s: Slice, length: int, total: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The requests of a slice for one length, as a row for each bucket."""
    rows = []
    if length == 0:
        counts = np.bincount(s.tokens[s.weight], minlength=len(s.words))
        order = _order(s.words)
        bucket = (s.words[order] >> np.uint64(64 - bits)).astype(np.int64)
        for a, b in zip((cuts := _bounds(bucket)), cuts[1:]):
            i = order[a:b]
            rows.append((number, int(bucket[a]), _pack(np.diff(s.words[i], prepend=np.uint64(0)), counts[i])))
    else:
        r = requests(s, length, total, bits)
        heavy = r.often > heavy_bound(total)
        for a, b in zip((cuts := _bounds(r.bucket)), cuts[1:]):
            i = r.order[a:b]
            own, sizes = _runs(r.owner[i])
            names, index = np.unique(r.word[i], return_inverse=True)
            # n(s) is the sum of the pairs, but for heavy contexts; c(s', a) of a single word is that of the word
            suffix = s.counts[names] if length == 1 else r.count_suffix[i]
            often_suffix = np.zeros(0, np.int64) if length == 1 else r.often_suffix[own]
            steps = np.diff(r.context[own], prepend=np.uint64(0))
            rows.append((number, int(r.bucket[a]), _pack(steps, sizes, np.where(heavy[own], r.often[own], 0), often_suffix, index, s.words[names], r.count[i], suffix)))
    for i in range(0, len(rows), 16):
        yield _batch(rows[i : i + 16], _ROW_SCHEMA)


def _ask_kernel(length: int, total: int, bits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                yield from _asking(number, Slice.from_bytes(data.as_py()), length, total, bits)

    return kernel


def _encode_kernel(depth: int):
    """(row_id, doc_id, flags, text) to slices."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, int, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            tokens = np.concatenate([np.array([_END, _BEGIN]), *(h[4] for h in held)])
            words, _, index = _distinct(tokens)
            often = np.argsort(-np.bincount(index), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            row_id, doc_id, flags, lead = (np.array([h[i] for h in held], np.int64) for i in range(4))
            s = Slice(row_id, doc_id, flags, np.array([len(h[4]) for h in held]), lead, words[often], np.zeros(0, np.int64), rank[index[2:]])
            yield _batch([(number, -1, s.to_bytes())], _ROW_SCHEMA)
            number, held, size = number + 1, [], 0

        def units(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], bool, bool, str]]:
            for *row, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = list(_cuts(text or "", PIECE)) or [""]
                for i, part in enumerate(parts):
                    yield tuple(row), i == 0, i == len(parts) - 1, part

        def groups(batch: pa.RecordBatch) -> Iterator[list[tuple[tuple[int, int, int], bool, bool, str]]]:
            group, full = [], 0
            for unit in units(batch):
                group.append(unit)
                full += len(unit[3])
                if full >= 6 * PIECE:
                    yield group
                    group, full = [], 0
            if group:
                yield group

        before = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                for group in groups(batch.slice(at, 1024)):
                    for (row, first, last, _), words in zip(group, word_hashes(pa.array([u[3] for u in group], pa.string())), strict=True):
                        lead = np.array([_BEGIN]) if first else before
                        tokens = np.concatenate((lead, words, [_END] if last else np.zeros(0, np.uint64)))
                        before = tokens[-depth:] if depth else before
                        held.append((*row, len(lead), tokens))
                        size += len(tokens)
                        if size >= SLICE:
                            yield from flush()
        if held:
            yield from flush()

    return kernel


def _lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, with what it has freed given back to the system after each result: workers are kept between tasks, and
    an allocator that has seen large arrays freed keeps their memory.  Without glibc nothing is done."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for batch in kernel(batches):
            yield batch
            del batch
            if trim:
                trim(0)
                pa.default_memory_pool().release_unused()

    return lean


def _by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The (slice, bucket, data) rows of each value of a column; rows come sorted by it."""
    now, rows = None, []
    for batch in batches:
        data = batch.column(batch.schema.get_field_index("data"))
        for number, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), data, strict=True):
            key = (number, bucket)[column]
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append((number, bucket, blob.as_py()))
    if rows:
        yield now, rows


def _count_words(bucket: int, rows: list[tuple[int, int, bytes]], bits: int) -> pa.RecordBatch:
    parts = [_unpack(data) for _, _, data in rows]
    unique, _, index = _distinct(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
    counts = np.bincount(index, np.concatenate([p[1] for p in parts]).astype(np.float64), len(unique)).astype(np.int64)
    rank = np.empty(len(unique), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(unique))
    ids = (rank << bits) + bucket
    out = [(-1, bucket, int((counts > 0).sum()), float(counts.sum()), None)]
    at = 0
    for (number, _, _), p in zip(rows, parts, strict=True):
        i = index[at : at + len(p[0])]
        out.append((number, bucket, 0, 0.0, _pack(ids[i], counts[i])))
        at += len(p[0])
    return _batch(out, _ANSWER_SCHEMA)


def _words_kernel(bits: int):
    """Counts each word of a bucket and numbers them, the frequent ones first; slice -1 has the distinct known words
    and the tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches, 1):
            yield _count_words(bucket, rows, bits)

    return kernel


def _test_contexts(bucket: int, rows: list[tuple[int, int, bytes]], length: int, total: int, least: int, divergence: float) -> pa.RecordBatch:
    parts = [_unpack(data) for _, _, data in rows]
    sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
    contexts, _, owner = _distinct(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
    often, often_suffix = np.zeros(len(contexts)), np.full(len(contexts), float(total))
    often[owner] = np.concatenate([p[2] for p in parts])
    if length > 1:
        often_suffix[owner] = np.concatenate([p[3] for p in parts])
    # words are numbered inside the bucket, to sort pairs as one word
    ids, some, name = _distinct(np.concatenate([p[5] for p in parts]))
    shift = np.cumsum([0, *(len(p[5]) for p in parts)])
    word = name[np.concatenate([p[4].astype(np.int64) + a for p, a in zip(parts, shift)])]
    by = np.repeat(owner, sizes)
    _, head, pair = _distinct(by * max(1, len(ids)) + word)
    count = np.bincount(pair, np.concatenate([p[6] for p in parts]).astype(np.float64), len(head))
    suffix = np.concatenate([p[7] for p in parts])
    suffix = (suffix[some][word[head]] if length == 1 else suffix[head]).astype(np.float64)
    heavy = often > 0
    often = np.where(heavy, often, np.bincount(by[head], count, len(contexts)))
    good = np.nonzero(count >= least)[0]
    s = by[head[good]]
    share = count[good] / often[s]
    gaps = np.bincount(s, share * np.log(share * often_suffix[s] / suffix[good]), len(contexts))
    kept = (gaps >= divergence) & ~heavy
    out = [(-1, bucket, int(contexts[i].view(np.int64)), float(gaps[i]), None) for i in np.nonzero(heavy)[0]]
    at = start = 0
    for (number, _, _), p in zip(rows, parts, strict=True):
        own = kept[owner[start : start + len(p[1])]]
        out.append((number, bucket, 0, 0.0, _pack(count[pair[at : at + len(p[4])]].astype(np.int64), np.packbits(own))))
        at, start = at + len(p[4]), start + len(p[1])
    return _batch(out, _ANSWER_SCHEMA)


def _test_kernel(length: int, total: int, least: int, divergence: float):
    """Adds up the pairs of a bucket and tests its contexts; slice -1 has the parts of the heavy ones' sums."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches, 1):
            yield _test_contexts(bucket, rows, length, total, least, divergence)

    return kernel


def _take_answers(s: Slice, rows: list[tuple[int, int, bytes]], length: int, total: int, bits: int, least: int, heavy: np.ndarray) -> None:
    """Enter the answers of one length; rows are sorted by bucket, as the requests were."""
    answers = [_unpack(data) for _, _, data in rows]
    r = requests(s, length, total, bits)
    counts = np.zeros(len(r.word), np.int64)
    kept = np.zeros(len(r.context), bool)
    cuts = _bounds(r.bucket)
    for a, b, (c, bit) in zip(cuts[:-1], cuts[1:], answers, strict=True):
        i = r.order[a:b]
        counts[i] = c
        own = _runs(r.owner[i])[0]
        kept[own] |= np.unpackbits(bit.astype(np.uint8), count=len(own)).astype(bool)
    is_heavy = r.often > heavy_bound(total)
    kept[is_heavy] = np.isin(r.context[is_heavy], heavy)
    gram = np.zeros(len(s.tokens), np.int64)
    before = np.concatenate(([0], s.often(length)[:-1]))  # how often the context of each place occurs
    known = s.sure & (s.place >= length)
    gram[known] = before[known]
    gram[r.at] = counts[r.pair]
    state = np.zeros(len(s.tokens), bool)
    state[r.at] = kept[r.owner[r.pair]]
    s.sure |= s.active & (gram == before)
    s.grams.append(gram)
    s.kept.append(state)
    s.active = s.active & ~s.sure & (s.place > length)
    s.active[1:] &= gram[:-1] >= least


def log10_probability(s: Slice, total: int, distinct: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the unigram and of the model's probability of each token."""
    base = (s.often(1) + 0.1) / (total + 0.1 * (distinct + 1))
    p = base.copy()
    for k, state in enumerate(s.kept, 1):
        at = np.nonzero(state)[0]
        p[at] = (s.often(k + 1, at) + alpha * p[at]) / (s.often(k, at - 1) + alpha)
    return np.log10(base), np.log10(p)


_SCORES = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _enter_answers(number: int, rows: list[tuple[int, int, bytes]], length: int, depth: int, total: int, distinct: int, bits: int, least: int, alpha: float, heavy: np.ndarray) -> pa.RecordBatch:
    s = Slice.from_bytes(rows[0][2])
    if length == 0:
        answers, order = [_unpack(data) for _, _, data in rows[1:]], _order(s.words)
        found = np.empty((2, len(order)), np.int64)
        found[:, order] = [np.concatenate([a[i] for a in answers]) for i in (0, 1)]
        s.numbered(*found, least)
    else:
        _take_answers(s, rows[1:], length, total, bits, least, heavy)
    if length < depth:
        return _batch([(number, -1, s.to_bytes())], _ROW_SCHEMA)
    base, score = log10_probability(s, total, distinct, alpha)
    piece = np.repeat(np.arange(len(s.size)), s.size)
    sums = [np.bincount(piece, s.own * x, len(s.size)) for x in (np.ones(len(base)), s.often(1) > 0, base, score)]
    doc_id = pa.array(s.doc_id, mask=s.flags & NO_ID == NO_ID)
    columns = [pa.array(s.row_id), doc_id, pa.array(s.flags & HELD_OUT == HELD_OUT), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *(pa.array(x) for x in sums[2:])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCORES.split(", ")])


def _answer_kernel(length: int, depth: int, total: int, distinct: int, bits: int, least: int, alpha: float, heavy: np.ndarray):
    """Slices with the answers of one length to slices that have taken them in, or to scores after the last length."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_key(batches, 0):
            yield _enter_answers(number, rows, length, depth, total, distinct, bits, least, alpha, heavy)

    return kernel


def score(docs: DataFrame, depth: int = 5, least: int = 2, divergence: float = 0.2, alpha: float = 8.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text; other
    columns are ignored).

    ``depth`` is the most words of a context, ``least`` how often a next word must follow a context to count in its
    divergence test (2 or more), ``divergence`` (above 0) the test's bound in nats, ``alpha`` the weight of the suffix
    in smoothing.  The begin of a text may be the first symbol of a context.

    Null, empty and blank texts are the end token alone.  Rows that repeat a doc_id are each scored and count in
    training as often as they occur; rows with a null doc_id are scored and train nothing.  Without training tokens
    every word is as unseen as any other: both scores are 0.  An empty table gives no rows.
    """
    if least < 2 or divergence <= 0:
        raise ValueError("contexts are pruned by at least 2 occurrences and a divergence above 0")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (size // 6 // BUCKET).bit_length())
    # a task has some 256 MB of text, or a share of a small input, and a slice at least
    cores = spark.sparkContext.defaultParallelism
    tasks = max(min(3 * cores, max(cores, size // (3 * SLICE))), size >> 28)

    flags = F.when(F.col("doc_id").isNull(), NO_ID).when(held_out(), HELD_OUT).otherwise(TRAINS)
    placed = rows.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce("doc_id", F.lit(0).cast("long")), flags, "text")
    now = materialize(placed.mapInArrow(_lean(_encode_kernel(depth)), _ROWS), "slices", BLOBS)
    total = distinct = 0
    heavy = np.zeros(0, np.uint64)
    for length in range(depth + 1):
        asked = now.mapInArrow(_lean(_ask_kernel(length, total, bits)), _ROWS).repartition(min(tasks, 1 << bits), "bucket").sortWithinPartitions("bucket")
        answer = _words_kernel(bits) if length == 0 else _test_kernel(length, total, least, divergence)
        answers = materialize(asked.mapInArrow(_lean(answer), _ANSWERS), "answers", FEW)
        aside = answers.where("slice = -1")
        if length == 0:
            distinct, total = (int(x or 0) for x in aside.agg(F.sum("key"), F.sum("value")).first())
        else:
            over = aside.groupBy("key").agg(F.sum("value").alias("value")).where(F.col("value") >= divergence).select("key").collect()
            heavy = np.array([r.key for r in over], np.int64).view(np.uint64)
        met = now.unionByName(answers.where("slice >= 0").select("slice", "bucket", "data"))
        met = met.repartition(tasks, "slice").sortWithinPartitions("slice", "bucket")
        kernel = _answer_kernel(length, depth, total, distinct, bits, least, alpha, heavy)
        after = materialize(met.mapInArrow(_lean(kernel), _ROWS if length < depth else _SCORES), "slices", FEW)
        discard(now, answers)
        now = after
    # a long text has several pieces
    sums = now.groupBy("row_id", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    known = F.lit(total > 0)
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.when(known, F.col("base")).otherwise(0.0).alias("base_score"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"),
    )
