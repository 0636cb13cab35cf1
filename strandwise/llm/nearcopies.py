"""Near copies of texts: word shingles with a Jaccard index of at least 0.8, candidates by MinHash, the index itself exact.

A text is the set of its five-word shingles (of all its words, if they are fewer).  Equal sets meet by a hash of the
set.  Distinct sets are entered in BANDS buckets, each keyed by the least values of ROWS hash functions; two sets of
index j miss each other in all of them with probability (1 - j**ROWS)**BANDS, 7e-10 at 0.8 and less above.

Inside a bucket every set is compared with the bucket's hub, a random member, different from bucket to bucket, so a
group of near copies is joined without a list of its pairs.  Then all pairs of a bucket that are not joined yet are
compared, whatever the bucket's size: no link between candidates is left out.  A bitmap of each set bounds the index
from above, so only pairs that may reach 0.8 are looked up.

Members of a bucket stream past its hub, in salted shares where they are many; and in the second pass past the members
outside the bucket's largest group, so a task holds those only.
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

BANDS, ROWS = 40, 4
MANY, SALTS = 1 << 12, 16
_RNG = np.random.default_rng(42)
_XOR, _ODD = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of one text; of all words, if they are fewer."""
    words = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part)) for part in word_chunks(data))])
    if not len(words):
        return words
    n = min(width, len(words))
    runs = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(runs)])
    return np.unique(runs)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048, None] ^ _XOR) * _ODD).min(0))
    key = _BAND.copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
    return key.view(np.int64)


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _sketch_kernel(width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles((t.as_py() or "").encode(), width) for t in part.column(2)]
                ids, sizes = pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                keys = pa.array([buckets(s).tobytes() if len(s) else b"" for s in sets], pa.binary())
                bits = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, sizes, keys, bits], ["doc_id", "key", "set", "size", "buckets", "bits"])

    return kernel


def _entry_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            keys = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(own), part.column(1).take(own)], ["bucket", "set", "size"])


def _set_kernel(width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles((t.as_py() or "").encode(), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["set", "hashes"])

    return kernel


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _check_kernel(similarity: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            near = [jaccard(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= similarity for i in range(len(batch))]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return kernel


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """4096 bits, those of the set's shingles by their highest 12 bits."""
    bits = np.zeros(4096, np.uint8)
    bits[(hashes >> np.uint64(52)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def most_similar(one: np.ndarray, size: int, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An upper bound of the index of one set and others, by bitmaps: a bit that the other has not is a shingle that it
    has not."""
    both = np.minimum(size - np.bitwise_count(one & ~bits).sum(1, dtype=np.int64), sizes - np.bitwise_count(bits & ~one).sum(1, dtype=np.int64))
    return both / (size + sizes - both)


def _pair_batch(one: int, others: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(others, one)), pa.array(np.maximum(others, one))], ["a", "b"])


def _open_kernel(similarity: float):
    """Pairs of one bucket and salt that have different roots and may be similar by their bitmaps.  Rows come sorted: the
    members that are held first (late = 0), which are compared with each other and with all others, which stream by."""

    def pairs(held: list[np.ndarray], new: list[np.ndarray], among: bool) -> Iterator[pa.RecordBatch]:
        sets, sizes, roots, bits = new
        for i in range(len(held[0])):
            one, size, root = held[0][i], held[1][i], held[2][i]
            other = np.nonzero(roots > root if among else roots != root)[0]
            other = other[most_similar(held[3][i], size, bits[other], sizes[other]) >= similarity] if len(other) else other
            if len(other):
                yield _pair_batch(one, sets[other])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None

        def settle() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*waiting, strict=True)] if waiting else [*[np.zeros(0, np.int64)] * 3, np.zeros((0, 64), np.uint64)]

        for batch in batches:
            if not len(batch):
                continue
            bucket, salt, late, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            rest.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, 64))
            cuts = np.concatenate(([0], np.nonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0) | (np.diff(late) != 0))[0] + 1, [len(bucket)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = [r[a:b] for r in rest]
                if (bucket[a], salt[a]) != now:
                    if held is None and waiting:
                        held = settle()
                        yield from pairs(held, held, True)
                    now, waiting, held = (bucket[a], salt[a]), [], None
                if late[a] == 0:
                    waiting.append(part)
                    continue
                if held is None:
                    held = settle()
                    yield from pairs(held, held, True)
                yield from pairs(held, part, False)
        if held is None and waiting:
            held = settle()
            yield from pairs(held, held, True)

    return kernel


def _candidates(prints: DataFrame, placed: DataFrame, similarity: float) -> DataFrame:
    """The pairs of each bucket and salt of ``placed`` (bucket, salt, late, set, size, root) that differ in root and may be
    similar, of which one is not late."""
    bits = prints.groupBy("set").agg(F.first("bits").alias("bits"))
    dealt = placed.join(bits, "set").select("bucket", "salt", "late", "set", "size", "root", "bits")
    dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "late", "root", "set")
    return dealt.mapInArrow(_open_kernel(similarity), "a long, b long").distinct()


def _salted(members: DataFrame, many: DataFrame) -> DataFrame:
    """``members`` (bucket, set, ...) with a salt: those of buckets in ``many`` (bucket, n) are dealt in shares."""
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("set"), F.lit(SALTS))).otherwise(0).cast("int")
    return members.join(F.broadcast(many), "bucket", "left").withColumn("salt", salt).drop("n")


def _similar(docs: DataFrame, prints: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of sets whose index is at least ``similarity``."""
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    rows = prints.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("key").alias("_key"))
    texts = docs.select(row_key().alias("_key"), F.col("text").cast("string").alias("text")).join(rows, "_key").select("set", "text")
    sets = materialize(texts.mapInArrow(_set_kernel(width), "set long, hashes binary").dropDuplicates(["set"]), "sets")
    met = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    return materialize(met.select("a", "b", "x", "y").mapInArrow(_check_kernel(similarity), "a long, b long"), "similar")


def grouped(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, set) of all rows, and (set, root) of those sets that are linked to another."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    prints = materialize(rows.mapInArrow(_sketch_kernel(width), "doc_id long, key long, set long, size long, buckets binary, bits binary"), "sketches")
    distinct = prints.dropDuplicates(["set"]).select("set", "size", "buckets")
    entered = materialize(distinct.mapInArrow(_entry_kernel, "bucket long, set long, size long"), "buckets")
    # a bucket of one set has no pairs
    hubs = entered.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("set", "size"), F.xxhash64("bucket", "set")).alias("hub")).where("n > 1")
    hubs = materialize(hubs, "hubs")
    # entries are 40 a set: at most 4096 buckets hold more than this
    bound = max(MANY, (hubs.agg(F.sum("n")).first()[0] or 0) >> 12)
    many = hubs.where(F.col("n") > bound).select("bucket", "n")
    salts = F.when(F.col("n") > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    centres = hubs.select("bucket", "hub", F.explode(salts).alias("salt"))
    met = materialize(_salted(entered, many).join(centres, ["bucket", "salt"]).select("bucket", "salt", "set", "size", "hub"), "met")
    # each salt of a bucket holds the hub, to which the others are compared as they come
    starred = met.where(F.col("set") != F.col("hub.set")).select("bucket", "salt", F.lit(1).alias("late"), "set", "size", F.lit(1).cast("long").alias("root"))
    starred = starred.unionByName(centres.select("bucket", "salt", F.lit(0).alias("late"), "hub.set", "hub.size", F.lit(0).cast("long").alias("root")))
    first = materialize(_candidates(prints, starred, similarity), "first")
    found = _similar(docs, prints, first, similarity, width)
    roots = components(found, "a", "b").withColumnRenamed("node", "set")

    placed = met.select("bucket", "set", "size").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    open_ = groups.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")).where("roots > 1")
    late = (F.col("root") == F.col("largest")).cast("int")
    asked = placed.join(open_, "bucket").select("bucket", late.alias("late"), "set", "size", "root").join(F.broadcast(many), "bucket", "left")
    # the largest group of a large bucket is dealt in shares, each of which the others meet
    shares = F.when(F.col("n").isNull(), F.array(F.lit(0))).when(F.col("late") == 1, F.array(F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = materialize(asked.select("bucket", F.explode(shares).alias("salt"), "late", "set", "size", "root"), "open")
    rest = _candidates(prints, asked, similarity).join(first, ["a", "b"], "left_anti")
    more = _similar(docs, prints, rest, similarity, width)
    linked = components(found.unionByName(more), "a", "b").withColumnRenamed("node", "set")
    return prints.select("doc_id", "key", "set"), linked


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near copies, all columns kept: the row with the smallest doc_id (null ids
    last), and of rows that repeat both id and text any one.

    A group is all texts that are linked, directly or not, by pairs with a Jaccard index of ``similarity`` or more.
    Null, empty and blank texts are one group.  An empty table gives no rows.
    """
    prints, linked = grouped(docs, similarity, width)
    members = prints.join(linked, "set", "left").select("doc_id", "key", F.coalesce("root", "set").alias("root"))
    return keep_first(docs, members)
